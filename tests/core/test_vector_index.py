import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.operators.vector_index import VectorIndex, fit_centroids
from fabula.sources import snapshots

SCHEMA = "project string, id bigint, vector array<float>, kind string"


def rows(n, seed, project="p", groups=12):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, 16))
    return [(project, i, (centre[i % groups] + 0.3 * r.normal(size=16)).tolist(), f"k{i % 3}") for i in range(n)]


def exact(points, q, k):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1)
    pad = lambda v: (list(v) + [0.0] * 16)[:16]
    scored = sorted((-round(float(unit(pad(v)) @ unit(pad(q))), 12), i) for _, i, v, _ in points if v is not None)
    return [i for _, i in scored[:k]]


def test_finds_what_the_exact_search_finds_and_lists_stay_apart(spark, tmp_path, monkeypatch):
    points = [*rows(600, 1), *[("q", i, v, k) for _, i, v, k in rows(50, 2)], ("p", 900, None, "k0"), ("p", 901, [0.0] * 16, "k0"), ("p", 902, [1.0], "k0")]
    index = VectorIndex.create(spark, str(tmp_path / "v"), spark.createDataFrame(points, SCHEMA), 12)
    queries = spark.createDataFrame([(i, "p", v) for _, i, v, _ in rows(600, 1) if i % 50 == 0], "query_id bigint, project string, vector array<float>")
    own = [p for p in points if p[0] == "p"]

    def found(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: r["rank"]):
            out.setdefault(r.query_id, []).append(r.id)
        return out

    want = {i: exact(own, v, 10) for _, i, v, _ in rows(600, 1) if i % 50 == 0}
    assert found(index.search(queries, 10, 99)) == want
    monkeypatch.setattr("fabula.operators.vector_index.PART_ROWS", 7)
    assert found(index.search(queries, 10, 99)) == want
    few = index.probes_for(queries, 10, 0.9)
    assert few < 12 and index.recall(queries, 10, few) >= 0.9
    assert {i for x in found(index.search(queries, 5, 99, kind=["k1"])).values() for i in x} <= {i for _, i, _, k in own if k == "k1"}
    again = VectorIndex.open(spark, str(tmp_path / "v"))
    assert found(again.search(queries, 10, 99)) == want
    with pytest.raises(FileExistsError):
        VectorIndex.create(spark, str(tmp_path / "v"), spark.createDataFrame(points, SCHEMA), 2)


def test_updates_touch_only_their_lists(spark, tmp_path):
    store = str(tmp_path / "v")
    points = rows(300, 3)
    index = VectorIndex.create(spark, store, spark.createDataFrame(points, SCHEMA), 12)
    before = {r.id: r.list for r in index.points().collect()}
    moved = [("p", 0, [-x for x in points[0][2]], "new"), ("p", 1000, points[1][2], "new"), ("other", 0, points[2][2], "new")]
    index.upsert(spark.createDataFrame(moved, SCHEMA))
    after = index.points()
    assert after.count() == 302 and after.where("kind = 'new'").count() == 3
    last = snapshots.snapshot(spark, store).commits[-1]
    written = {r.list for r in spark.read.parquet(f"{store}/{last['folder']}/points").select("list").distinct().collect()}
    now = {(r.project, r.id): r.list for r in after.collect()}
    assert written <= {before[0], now["p", 0], now["p", 1000], now["other", 0]} and now["p", 0] != before[0]
    index.delete((F.col("kind") == "new") & (F.col("project") == "p"))
    assert {(r.project, r.id) for r in index.points().collect()} == {("p", i) for i in range(1, 300)} | {("other", 0)}
    index.delete(F.col("project") == "other")
    assert index.points().count() == 299 and index.points().where("project = 'other'").count() == 0


def test_centroids_of_few_points(spark):
    df = spark.createDataFrame(rows(5, 4) + [("p", 9, None, "x")], SCHEMA)
    assert fit_centroids(df, 50).shape == (5, 16)
    with pytest.raises(ValueError):
        fit_centroids(df.where("vector is null"), 4)
