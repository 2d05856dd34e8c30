"""Sinks: replacing what belongs to a scope, and upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def replace_scope(rows: DataFrame, path: str, scope: str, cleared: list | None = None) -> None:
    """Writes ``rows`` in place of what the table at ``path`` has of the same scopes, and leaves
    nothing of the scopes in ``cleared`` that have no new rows; other scopes stay as they
    are. The table is partitioned by ``scope``."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)
    if cleared:
        new = {r[0] for r in rows.where(rows[scope].isin(*cleared)).select(scope).distinct().collect()}
        at = spark._jvm.org.apache.hadoop.fs.Path
        files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for value in set(cleared) - new:
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
            files.delete(at(f"{path}/{scope}={name}"), True)


def read_scope(spark: SparkSession, path: str, scope: str, *values) -> DataFrame:
    """Rows of some scopes; only their folders are read."""
    table = spark.read.parquet(path)
    return table.where(table[scope].isin(*values)) if values else table


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The table with ``rows`` in place of any with the same keys."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)
