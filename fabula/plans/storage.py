"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the session is local, a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_fabula_tables"):
        context._fabula_tables = "file://" + tempfile.mkdtemp(prefix="fabula-")
    return context._fabula_tables


#: Lets Spark remove an execution's shuffle files when it ends, not when the driver happens to
#: collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths of the tables written in each open scratch block of a thread.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized in the block are deleted when it ends. What reads them has
    to be written by then; without such a block they stay, as results still read them."""
    paths: list[str] = []
    before = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(before)
        for path in paths:
            remove(spark, path)


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Writes ``df`` and reads it back: its lineage ends there and survives lost executors,
    and its shuffle files go. A ``kept`` table outlives the innermost scratch block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _written.get()[:-1] if kept else _written.get()
    if blocks:
        blocks[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
