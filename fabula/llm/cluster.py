"""How documents are dealt into blocks, and where intermediate tables go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.plans.storage import materialize, scratch, shared_dir

__all__ = ["BLOCK_BYTES", "LEAST_BLOCKS", "block_count", "block_of", "materialize", "scratch", "shared_dir"]

#: Text bytes that one block of documents aims at; a block is what one task holds.
BLOCK_BYTES = 8 << 20
#: Blocks at least, so that small inputs still use every core.
LEAST_BLOCKS = 48


def block_count(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for ``df`` by the bytes of its texts; one aggregate over the column."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-int(total) // block_bytes))


def block_of(n: int, *cols: str) -> Column:
    """A block number by the hash of ``cols``; even for any hot source or text as
    long as one of ``cols`` tells rows apart."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
