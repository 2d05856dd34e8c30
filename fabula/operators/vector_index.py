"""Stored vectors with an index of inverted lists.

Points (project, id, vector and any payload columns) lie in lists: each in that of the centroid
it is most similar to. A list of a project is a scope of a store (sources/snapshots.py), so an
update rewrites the lists that it touches, all in one step. A search looks into the lists nearest to
each query and ranks what it finds there by the exact cosine. How many lists that takes for a wanted recall
is measured, not assumed (``probes_for``): vectors without any structure need many.

Centroids are fitted on a sample of at most SAMPLE_ROWS points, chosen by the hash of their ids; every
point is indexed. Vectors are taken as of the index's length, shorter ones filled with zeros, longer
ones cut. Null vectors are stored and never found; a vector of zeros has cosine 0 with any.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from fabula.plans.storage import materialize
from fabula.sources import snapshots
from fabula.sources.files import Files

#: Points that centroids are fitted on, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 20_000, 10
#: Points of a list that a task compares at once; longer lists are several tasks.
PART_ROWS = 20_000


def matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """Rows of ``length`` numbers; nulls are zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), length))
    out[row[place < length], place[place < length]] = flat[place < length]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def fit_centroids(points: DataFrame, lists: int, vector_col: str = "vector", id_col: str = "id", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``lists`` centroids of length 1, by rounds of nearest centroid and mean over a sample."""
    total = points.where(F.col(vector_col).isNotNull()).count()
    share = min(1.0, sample_rows / max(1, total))
    picked = points.where(F.col(vector_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = picked.orderBy(F.xxhash64(id_col)).limit(sample_rows).select(vector_col).toArrow().column(0)
    if not len(rows):
        raise ValueError("no vectors to fit on")
    length = int(pc.max(pc.list_value_length(rows)).as_py())
    x = unit(matrix(rows, length))
    centre = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        filled = np.bincount(nearest, minlength=len(centre)) > 0
        centre = np.where(filled[:, None], unit(sums), centre)
    return centre


@dataclass
class VectorIndex:
    spark: SparkSession
    store: str
    centroids: np.ndarray

    @classmethod
    def create(cls, spark: SparkSession, store: str, points: DataFrame, lists: int) -> VectorIndex:
        """A new index of ``points`` (project, id, vector, ...)."""
        centroids = fit_centroids(points, lists)
        if not Files(spark, store).put_new(f"{store}/centroids.json", json.dumps(centroids.tolist())):
            raise FileExistsError(store)
        index = cls(spark, store, centroids)
        snapshots.commit(spark, store, {"points": index._placed(points)}, "list")
        return index

    @classmethod
    def open(cls, spark: SparkSession, store: str) -> VectorIndex:
        return cls(spark, store, np.array(json.loads(Files(spark, store).read(f"{store}/centroids.json"))))

    def points(self) -> DataFrame:
        return snapshots.snapshot(self.spark, self.store).table("points")

    def _nearest(self, df: DataFrame, many: int, out: str) -> DataFrame:
        """Adds the numbers of the ``many`` nearest centroids to rows with a ``vector``."""
        centroids = self.centroids
        many = min(many, len(centroids))
        at = df.columns.index("vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = unit(matrix(batch.column(at), centroids.shape[1])) @ centroids.T
                best = np.argsort(-score, axis=1, kind="stable")[:, :many].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * many, pa.int32()), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))]))

    def _placed(self, points: DataFrame) -> DataFrame:
        found = self._nearest(points.withColumn("project", F.coalesce(F.col("project").cast("string"), F.lit(""))), 1, "_lists")
        return found.withColumn("list", F.concat_ws("/", "project", F.col("_lists")[0].cast("string"))).drop("_lists")

    def upsert(self, points: DataFrame) -> int:
        """Puts ``points`` in place of those of the same project and id. Lists that had one of these
        or get one are rewritten, others aren't read but for their ids."""
        new = materialize(self._placed(points).dropDuplicates(["project", "id"]), "new-points")
        known = self.points()
        ids = new.select("project", "id")
        had = known.select("project", "id", "list").join(ids, ["project", "id"], "left_semi").select("list")
        touched = materialize(had.union(new.select("list")).distinct(), "touched-lists")
        rest = known.join(touched, "list", "left_semi").join(ids, ["project", "id"], "left_anti")
        return snapshots.commit(self.spark, self.store, {"points": rest.unionByName(new, allowMissingColumns=True)}, "list", touched)

    def delete(self, condition) -> int:
        """Removes the points for which ``condition`` is true; only their lists are rewritten."""
        known = self.points()
        touched = materialize(known.where(condition).select("list").distinct(), "touched-lists")
        rest = known.join(touched, "list", "left_semi").where(~F.coalesce(condition, F.lit(False)))
        return snapshots.commit(self.spark, self.store, {"points": rest}, "list", touched)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, **allowed: list) -> DataFrame:
        """query_id, rank, id and score: for each query (query_id, project, vector) the best ``k`` points
        of its project in the ``probes`` nearest lists, ties by id. ``allowed`` limits payload
        columns to some values."""
        points = self.points().where("vector is not null")
        for c, values in allowed.items():
            if values:
                points = points.where(F.col(c).isin(*values))
        asked = self._nearest(queries.select("query_id", F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"), "vector").where("vector is not null"), probes, "_lists")
        asked = asked.withColumn("_list", F.explode("_lists")).select("query_id", "vector", F.concat_ws("/", "project", F.col("_list").cast("string")).alias("list"))
        parts = points.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        place = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
        left = points.join(parts, "list").select("list", place, "id", "vector")
        right = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")
        length = self.centroids.shape[1]
        out = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", points.schema["id"].dataType), StructField("score", DoubleType())])
        schema = to_arrow_schema(out)

        def compare(p: pa.Table, q: pa.Table) -> pa.Table:
            if not len(p) or not len(q):
                return schema.empty_table()
            p = p.take(pc.sort_indices(p, [("id", "ascending")]))
            x = unit(matrix(p.column("vector"), length))
            found = []
            for at in range(0, len(q), 256):
                part = q.slice(at, 256)
                score = unit(matrix(part.column("vector"), length)) @ x.T
                best = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(best)), best.shape[1])
                found.append(pa.table([part.column("query_id").take(pa.array(row)), p.column("id").take(pa.array(best.ravel())), pa.array(score[row, best.ravel()])], schema=schema))
            return pa.concat_tables(found)

        found = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(compare, out)
        order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")
        return found.withColumn("rank", F.row_number().over(order).cast(IntegerType())).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def recall(self, queries: DataFrame, k: int = 10, probes: int = 8) -> float:
        """The share of the exact best ``k`` of all queries that a search finds."""
        exact = self.search(queries, k, len(self.centroids)).select("query_id", "id")
        exact = materialize(exact, "exact-neighbours")
        both = self.search(queries, k, probes).select("query_id", "id").join(exact, ["query_id", "id"], "left_semi")
        return both.count() / max(1, exact.count())

    def probes_for(self, queries: DataFrame, k: int = 10, recall: float = 0.9) -> int:
        """The least number of lists with at least that recall on these queries; all lists find
        everything. Give a sample of the queries to come."""
        low, high = 1, len(self.centroids)
        while low < high:
            middle = (low + high) // 2
            if self.recall(queries, k, middle) >= recall:
                high = middle
            else:
                low = middle + 1
        return low
