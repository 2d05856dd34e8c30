"""Hash embeddings and vector search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import text as T

DIMENSIONS = 256
#: Texts that a task embeds at once where only their scores stay.
TEXTS_AT_ONCE = 256


def _embeddings(tokens: pa.Array, dimensions: int) -> np.ndarray:
    """A row of length 1 for each list of tokens, or of zeros."""
    known = tokens.flatten().dictionary_encode()
    words = known.dictionary.to_pylist()
    digests = [hashlib.sha256(t.encode()).digest() for t in words]
    cell = np.array([int.from_bytes(d[:4], "big") % dimensions for d in digests], np.int64)
    weight = np.array([(1 if d[4] % 2 == 0 else -1) * math.log1p(len(t)) for d, t in zip(digests, words, strict=True)], np.float64)
    token = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
    sums = np.bincount(row * dimensions + cell[token], weight[token], len(tokens) * dimensions).astype(np.float64).reshape(-1, dimensions)
    norm = np.sqrt((sums * sums).sum(1))
    sums /= np.where(norm > 0, norm, 1)[:, None]
    return sums


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Embeddings of length 1, or all zeros: each token adds the logarithm of its length plus
    one, with a sign, to the dimension that its SHA-256 names. A row is embedded where it
    is; within a batch each distinct token is hashed once."""

    @F.arrow_udf("array<double>")
    def embed(tokens: pa.Array) -> pa.Array:
        sums = _embeddings(tokens, dimensions)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * dimensions, pa.int32()), pa.array(sums.ravel()))

    return embed(T.embedding_tokens(text))


def hash_score(text: Column, vector: np.ndarray) -> Column:
    """The cosine of each text's embedding with one of length 1; only the number leaves Python."""

    @F.arrow_udf("double")
    def score(tokens: pa.Array) -> pa.Array:
        parts = [_embeddings(tokens.slice(at, TEXTS_AT_ONCE), len(vector)) @ vector for at in range(0, len(tokens), TEXTS_AT_ONCE)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score(T.embedding_tokens(text))


def hash_features(rows: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Embeddings as rows (id, dim, weight), those that aren't 0."""
    dense = rows.select(id_col, hash_embedding(F.col(text_col), dimensions).alias("v"))
    return dense.select(id_col, F.posexplode("v").alias("dim", "weight")).where("weight <> 0").select(id_col, F.col("dim").cast("long").alias("dim"), "weight")


def clamp_limit(limit: float | None) -> int:
    """Whole results asked for: 10 if not a number, at least 1 and at most 50."""
    if limit is None or math.isnan(limit):
        return 10
    return int(min(50, max(1, math.floor(limit))))


def search_text(rows: DataFrame, query: str, id_col: str, text_col: str = "text", limit: float | None = 10, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of the texts most similar to ``query``. Scores are made where the rows are,
    and only the best of each task move."""
    one = rows.sparkSession.createDataFrame([(query,)], "text string")
    q = np.array(one.select(hash_embedding(F.col("text"), dimensions).alias("v")).first().v)
    scored = rows.select(id_col, hash_score(F.col(text_col), q).alias("score"))
    # a score of 0 becomes null, not a filter: that would be evaluated below the one Arrow function, with another
    best = scored.select(id_col, F.nullif("score", F.lit(0.0)).alias("score"))
    top = best.orderBy(F.round("score", 9).desc_nulls_last(), id_col).limit(clamp_limit(limit))
    return top.where("score IS NOT NULL")


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


def search_vectors(points: DataFrame, query: list[float], limit: float | None = 10, vector_col: str = "embedding", id_col: str = "vec_id", **allowed: list) -> DataFrame:
    """Exact top k by cosine among the points whose columns have one of the ``allowed``
    values; an empty list allows all."""
    for c, values in allowed.items():
        if values:
            points = points.where(F.col(c).isin(*values))
    q = F.array(*[F.lit(float(x)) for x in query])
    return points.select(id_col, *allowed, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(clamp_limit(limit))


def upsert(points: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Points with those of ``new`` in place of any of the same id."""
    return points.join(new.select(id_col), id_col, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(points: DataFrame, **values: list) -> DataFrame:
    """Points without those whose columns all have one of the given values; a column with an
    empty list is no condition, and without any condition nothing is deleted."""
    hit = None
    for c, allowed in values.items():
        if allowed:
            one = F.coalesce(F.col(c).isin(*allowed), F.lit(False))
            hit = one if hit is None else hit & one
    return points if hit is None else points.where(~hit)
