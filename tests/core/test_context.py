import json
import random
import time

import pytest

from pyspark.sql import functions as F

from fabula.operators import graph as G
from fabula.operators import scenes as S
from fabula.operators import vectors as V
from fabula.operators.components import components
from fabula.operators.extraction import RuleProvider, extract_facts, fact_values, retry_delay, unwrap_json, valid_facts, with_retry, with_timeout
from fabula.sources.tables import read_scope, replace_scope, upsert

TEXT = "Джон разговаривает с Майклом возле фонтана."
LABELS = [(1, "Джон Смит", True), (1, "Джон", False), (2, "Джон Блэк", True), (2, "Джон", False), (3, "Фонтан", True)]


def test_entities_of_a_scene(spark):
    texts = spark.createDataFrame([(7, TEXT)], "doc_id bigint, text string")
    got = S.resolve_mentions(S.entity_matches(texts, spark.createDataFrame(LABELS, "entity_id bigint, label string, is_name boolean"))).collect()
    assert {(r.entity_id, r.status, r.score) for r in got} == {(1, "ambiguous", 1.05), (2, "ambiguous", 1.05), (3, "resolved", 0.92)}
    known = spark.createDataFrame([(7, "Джон"), (7, "Фонтан")], "doc_id bigint, label string")
    assert [r.mention for r in S.create_suggestions(texts, known).collect()] == ["Майклом"]


def test_validation(spark):
    rows = [(1, "style", True, 0.9), (1, "location", True, 0.86), (1, "character", True, 0.84), (2, "character", False, 0.55), (2, "location", True, 0.8), (3, "style", False, 0.2)]
    got = {r.asset_id: (r.score, r.all_passed, r.recommendation) for r in S.validate(spark.createDataFrame(rows, "asset_id int, type string, passed boolean, score double")).collect()}
    assert got == {1: (0.87, True, "approve"), 2: (0.68, False, "inpaint"), 3: (0.2, False, "regenerate")}


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "old square Mara walks"), (2, "unrelated words here"), (3, "")], "id bigint, text string")
    f = V.hash_features(docs, "id", "text")
    length = f.where("id = 1").agg(F.sum(F.col("weight") * F.col("weight"))).first()[0]
    assert abs(length - 1) < 1e-9 and f.where("id = 3").count() == 0
    found = V.search_text(docs.union(spark.createDataFrame([(4, None)], docs.schema)), "old square Mara", "id").collect()
    assert found[0].id == 1 and found[0].score > 0
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 1.0, 5.0], "b")], "vec_id int, embedding array<double>, label string")
    top = V.search_vectors(points, [1.0, 0.0], 50).collect()
    assert [r.vec_id for r in top] == [1, 3, 2] and top[2].score == 0.0
    assert [r.vec_id for r in V.search_vectors(points, [1.0, 0.0], 1, label=["b"]).collect()] == [3]
    assert [V.clamp_limit(x) for x in (None, float("nan"), 0, 2.9, 500)] == [10, 10, 1, 2, 50]


def test_graph(spark):
    nodes = spark.createDataFrame([(k, "X", k) for k in "abcde"], "key string, label string, name string")
    raw = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d"), ("a", "R", "missing")], "source string, type string, target string")
    edges = G.edges(nodes, raw)
    assert edges.count() == 3
    more = G.nodes(nodes, spark.createDataFrame([("a", "X", "z", 5)], "key string, label string, name string, age int"))
    assert more.where("key = 'a'").first().asDict() == {"key": "a", "label": "X", "name": "z", "age": 5} and more.count() == 5
    weighted = spark.createDataFrame([("a", "R", "b", 2), ("a", "R", "b", 7)], "source string, type string, target string, weight int")
    assert [tuple(r) for r in G.edges(nodes, weighted).collect()] == [("a", "R", "b", 7)]
    near = G.neighbourhood(edges, spark.createDataFrame([("a",)], "key string")).collect()
    assert sorted(r.key for r in near) == ["a", "b", "c"]
    parents = spark.createDataFrame([(1, "City", None), (2, "Park", 1), (3, "Fountain", 2), (4, "x", 5), (5, "y", 4)], "id int, name string, parent_id int")
    paths = {r.id: r.path for r in G.ancestry(parents).collect()}
    deep = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(100)], "id int, name string, parent_id int")
    assert {r.id: r.path for r in G.ancestry(deep).collect()}[99] == [f"n{i}" for i in range(100)]
    assert paths[3] == ["City", "Park", "Fountain"] and paths[1] == ["City"] and len(paths[4]) <= 2


def test_components_of_strings(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x"), ("z", "y")], "a string, b string")
    assert {r.node: r.root for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y", "z": "y"}


def test_extraction(spark):
    chunks = spark.createDataFrame([("c1", 4, "Anna Karenina met Alexei Vronsky."), ("c2", 4, "nothing")], "chunk_id string, doc_id bigint, text string")
    assert sorted(r.entity_name for r in extract_facts(chunks, RuleProvider()).collect()) == ["Alexei Vronsky", "Anna Karenina"]
    assert unwrap_json('x ```json\n[1]\n``` y') == [1] and unwrap_json("no") is None
    good = {"type": "CHARACTER_AGE", "entityName": " N ", "value": {"summary": "s"}, "confidence": 1, "quote": "q"}
    assert valid_facts(json.dumps({"facts": [good]}), "character") == [("CHARACTER_AGE", "N", "s", 1.0, "q", None, '{"summary":"s"}')] and valid_facts("{}", "timeline") == []
    event = {"type": "TIMELINE_EVENT", "entityName": "e", "value": {"title": "t", "absoluteDate": "2020-01-01T00:00:00Z", "characterNames": [" a "]}, "confidence": 0.5}
    assert valid_facts(json.dumps({"facts": [event]}), "timeline")[0][6] == '{"title":"t","absoluteDate":"2020-01-01T00:00:00Z","characterNames":["a"]}'
    bad = [good | {"confidence": 2}, good | {"x": 1}, good | {"type": "TIMELINE_EVENT"}, good | {"value": {}}, good | {"value": {"summary": "s", "y": 1}}, good | {"value": {"summary": "s", "candidateNames": [""]}}, 5]
    for x in bad:
        with pytest.raises(ValueError):
            valid_facts(json.dumps({"facts": [good, x]}), "character")
    with pytest.raises(ValueError):
        valid_facts(json.dumps({"facts": [event | {"value": {"title": "t", "absoluteDate": "2020-01-01"}}]}), "timeline")
    values = spark.createDataFrame([('{"title":"t","characterNames":["a",1]}',)], "v string").select(fact_values(F.col("v"), "timeline").alias("x")).first().x
    assert values.title == "t" and values.characterNames == ["a"] and values.description is None and values.locationNames == []
    with pytest.raises(TimeoutError):
        with_timeout(lambda: time.sleep(1), 0.05)

    class Broken:
        def complete(self, text, family):
            return "no json"

    rows = extract_facts(chunks, Broken(), attempts=1).collect()
    assert len(rows) == 2 and all(r.error.startswith("ValueError") and r.type is None for r in rows)
    both = extract_facts(spark.createDataFrame([("c1", 4, "Anna Karenina in Moscow")], "chunk_id string, doc_id bigint, text string"), RuleProvider(), ("character", "location")).collect()
    assert {(r.family, r.entity_name) for r in both} == {("character", "Anna Karenina"), ("location", "Moscow")}
    assert [retry_delay(n) for n in (1, 2, 3, 4, 9)] == [250, 500, 1000, 2000, 2000]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert with_retry(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3


def test_replacing_a_scope(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_scope(spark.createDataFrame([(1, "a"), (2, "b")], "scope int, v string"), path, "scope")
    replace_scope(spark.createDataFrame([(2, "c")], "scope int, v string"), path, "scope")
    assert {(r.scope, r.v) for r in read_scope(spark, path, "scope").collect()} == {(1, "a"), (2, "c")}
    assert read_scope(spark, path, "scope", 2).count() == 1
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in upsert(old, spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "z"), (3, "n")}


def test_stars_over_many_partitions(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(260)] + [(9, 9), (3, 1), (1, 2)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {x.node: x.root for x in made} == {n: find(n) for n in root}


def test_context_of_seeds_is_that_of_their_neighbourhoods(spark, monkeypatch):
    """Hubs, leaves, loops, and edges whose ends both are two edges away; blocks of two links."""
    monkeypatch.setattr(G, "LINKS_AT_ONCE", 2)
    links = [("a", "h"), ("h", "x"), ("h", "y"), ("x", "y"), ("a", "b"), ("b", "z"), ("z", "x"), ("y", "y"), ("z", "far"), ("far", "q"), *((f"l{i}", "h") for i in range(9)), ("h", "gone"), ("q", "q")]
    edges = spark.createDataFrame([(s, t, k) for s, k in links for t in ("R", "S") if t == "R" or s < k], "source string, type string, target string")
    nodes = spark.createDataFrame([(k, "N" if k < "m" else "M", k.upper()) for k in {x for link in links for x in link} - {"gone"}], "key string, label string, name string")
    seeds = spark.createDataFrame([("a",), ("q",), ("l3",), ("alone",)], "key string")
    near = G.neighbourhood(edges, seeds)
    reach = {}
    for s in ("a", "q", "l3", "alone"):
        one = {s} | {y for x, y in links if x == s} | {x for x, y in links if y == s}
        reach[s] = one | {y for x, y in links if x in one} | {x for x, y in links if y in one}
    assert sorted(map(tuple, near.collect())) == sorted((s, k) for s, ks in reach.items() for k in ks)
    for most in ((20, 30), (3, 4)):
        assert sorted(map(tuple, G.seed_context(seeds, nodes, edges, *most).collect())) == sorted(map(tuple, G.context_lines(near, nodes, edges, *most).collect()))


def test_a_hub_of_a_neighbourhood_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "LINKS_AT_ONCE", 100)
    monkeypatch.setattr(G, "PAIRS_AT_ONCE", 5000)
    edges = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("source"), F.lit("hub").alias("target"))
    made = G.neighbourhood(edges, edges.where("substr(source, -2) = '00'").select(F.col("source").alias("key")))
    parts = [n for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(parts) == 9 * 1001 + 0 and len(parts) > 2 and max(parts) < sum(parts) / 2


def test_objects_are_listed_once_for_scenes_of_the_same_locations(spark):
    scenes = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "scene string")
    happens = spark.createDataFrame([("s1", "l1"), ("s1", "l2"), ("s2", "l2"), ("s2", "l1"), ("s3", "l3")], "scene string, location string")
    located = spark.createDataFrame([("o2", "l1"), ("o1", "l2"), ("o1", "l1"), ("o9", "l9")], "object string, location string")
    appears = spark.createDataFrame([("c2", "s1"), ("c1", "s1"), ("c1", "s1"), ("c1", "s4")], "character string, scene string")
    made = G.scene_entities(scenes, appears, happens, located)
    assert {tuple(map(str, r)) for r in made.collect()} == {("s1", "['c1', 'c2']", "['l1', 'l2']", "['o1', 'o2']"), ("s2", "[]", "['l1', 'l2']", "['o1', 'o2']"), ("s3", "[]", "['l3']", "[]"), ("s4", "['c1']", "[]", "[]")}
    last = made._jdf.queryExecution().optimizedPlan().toString().split("Join")
    assert "location_ids" in last[1].splitlines()[0]  # lists of objects are in the last join only, by locations


def test_extraction_and_scores_go_by_portions(spark):
    """A batch is several portions: each text has its facts, and the score that a whole batch gives it."""
    from fabula.operators.extraction import CHUNKS_AT_ONCE

    chunks = spark.createDataFrame([(f"c{i}", i, f"Anna Karenina met No{chr(97 + i % 26)}body Else in Moscow") for i in range(600)], "chunk_id string, doc_id bigint, text string").coalesce(1)
    assert max(CHUNKS_AT_ONCE, V.TEXTS_AT_ONCE) < 600 and extract_facts(chunks, RuleProvider()).count() == 1200
    v = V.np.arange(256) / 256
    one = [r[0] for r in chunks.select(V.hash_score(F.col("text"), v)).collect()]
    whole = [V.np.dot(r[0], v) for r in chunks.select(V.hash_embedding(F.col("text"))).collect()]
    assert V.np.allclose(one, whole)
