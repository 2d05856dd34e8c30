"""Questions from blocks of documents about the whole corpus, and the answers.

Every block of documents asks about many 64-bit keys (signatures, n-grams) and
gives a number with each. Keys go, as packed sorted arrays, to buckets by their
hash; a bucket combines what all blocks said about each of its keys and answers
each block in the order it asked. Compared with a row for each key this moves
about half the bytes, and no key is hot: a block names a key once, however often
its documents have it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fabula.llm import words as W

ASK = "bucket int, block int, keys binary, values binary"
ANSWER = "block int, bucket int, totals binary"
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part begins in sorted ``keys``; buckets share the range evenly."""
    edges = (np.arange(1, buckets, dtype=object) * (2**64 // buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def pack_keys(keys: np.ndarray, width: int = 8) -> bytes:
    """Keys by their first ``width`` bytes: all first bytes, then all second ones ... As the
    keys are sorted, the leading bytes hardly change and compress well that way."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_keys(data: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on by their bytes, all lowest ones first, as many as the largest
    needs: most are small, and bytes of a kind compress well side by side."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


def asked(block: int, keys: np.ndarray, values: np.ndarray, buckets: int, width: int = 8) -> pa.RecordBatch:
    """What one block asks: distinct sorted keys and a whole number from 0 on for each. With a ``width``
    below 8, keys with the same first bytes are taken for one; that must do no harm."""
    at = bucket_bounds(keys, buckets)
    rows = [(b, block, pack_keys(keys[s:e], width), pack_numbers(values[s:e])) for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]
    return pa.RecordBatch.from_pylist([dict(zip(_ASK.names, r, strict=True)) for r in rows], schema=_ASK)


def answer(asks: DataFrame, combine: Callable[[np.ndarray, np.ndarray, int], np.ndarray], width: int = 8) -> DataFrame:
    """Combines the values of equal keys over all blocks of a bucket.

    ``combine(key number of each entry, its value, how many keys)`` gives an array
    with one whole number for each key. A bucket's entries grow with the input divided by
    the number of buckets.
    """

    def one(table: pa.Table) -> pa.Table:
        W.release()
        rows = table.select(["block", "bucket", "keys", "values"]).to_pylist()
        keys = [unpack_keys(r["keys"], width) for r in rows]
        values = np.concatenate([unpack_numbers(r["values"]) for r in rows])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        per_entry = combine(back, values, len(distinct))[back]
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            out.append({"block": r["block"], "bucket": r["bucket"], "totals": pack_numbers(per_entry[at : at + len(k)])})
            at += len(k)
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())]))

    return asks.groupBy("bucket").applyInArrow(one, ANSWER)


def answered(answers: pa.Table) -> np.ndarray:
    """The numbers for a block's keys, in the order of its sorted keys."""
    rows = sorted(answers.select(["bucket", "totals"]).to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.uint64), *(unpack_numbers(r["totals"]) for r in rows)])
