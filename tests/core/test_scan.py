import json
import random

from pyspark.sql.types import LongType

from fabula.operators import entities as E
from fabula.operators import scan as S


def facts(n, seed, roots=("hot",) * 8 + ("a", "b", None)):
    r = random.Random(seed)
    kinds = ["CHARACTER_MENTION"] * 6 + ["CHARACTER_AGE", "CHARACTER_APPEARANCE", "CHARACTER_PERSONALITY"] + ["CHARACTER_PLOT_CHANGE"] * (seed % 2)
    return [(r.choice(roots), r.randrange(30), i, r.choice(kinds), r.choice([None, None, None, "", "h1", "h2"]), r.choice([None, "", "x", " X ", "y"]), r.choice([0.2, 0.5, 0.9])) for i in range(n)]


def one_by_one(rows):
    """The rule as it reads, entity after entity."""
    out, of = {}, {}
    for root, _, i, kind, hint, said, sure in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        value = " ".join((said or "").lower().split())
        s = of.get(root)
        told = kind in ("CHARACTER_AGE", "CHARACTER_APPEARANCE", "CHARACTER_PERSONALITY") and value
        if s is None:
            of[root] = s = {"n": 1}
        elif kind == "CHARACTER_PLOT_CHANGE" or (hint and s.get("hint") and s["hint"] != hint) or (told and s.get(kind) and s[kind] != value and (kind == "CHARACTER_AGE" or sure >= 0.5)):
            of[root] = s = {"n": s["n"] + 1}
        if hint:
            s["hint"] = hint
        if told:
            s[kind] = value
        out[i] = s["n"]
    return out


def test_versions_of_one_entity_in_many_ranges(spark):
    for seed in (1, 2):
        rows = facts(900, seed)
        df = spark.createDataFrame(rows, "root string, chapter_index int, id int, type string, timeline_hint string, summary string, confidence double").repartition(4)
        want = one_by_one(rows)
        assert max(want.values()) > 20
        for ranges in (1, 7, 60):
            made = E.version_segments(df, ranges=ranges)
            assert {r.id: r.version for r in made.collect()} == want


def test_no_range_has_most_of_a_hot_entity(spark):
    rows = facts(3000, 3)
    df = spark.createDataFrame(rows, "root string, chapter_index int, id int, type string, timeline_hint string, summary string, confidence double").repartition(4)
    sizes = [r["count"] for r in df.repartitionByRange(12, "root", "chapter_index", "id").withColumn("p", S.F.spark_partition_id()).groupBy("p").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 600


def test_summaries_do_what_their_rows_do():
    """For any state to begin with, and whatever way rows are divided."""
    r = random.Random(4)
    machine = S.Resets(E._character_reads)
    for n in range(300):
        rows = [x[3:] for x in facts(r.randrange(1, 12), n)]
        state = machine.start()
        for row in [x[3:] for x in facts(r.randrange(6), n + 1000)]:
            machine.step(state, row)
        want = json.loads(json.dumps(state))
        for row in rows:
            machine.step(want, row)
        cut = r.randrange(1, len(rows) + 1)
        got = state
        for part in (rows[:cut], rows[cut:]):
            if part:
                got = machine.apply(got, json.loads(json.dumps(machine.summary(part))))
        assert got == want


def test_an_empty_table_and_keys_of_other_types(spark):
    empty = spark.createDataFrame([], "k date, o int")
    assert S.segmented_scan(empty, "k", ["o"], ["o"], S.Previous(), "x", LongType()).count() == 0
    rows = spark.sql("SELECT date'2020-01-01' + CAST(id % 2 AS INT) AS k, id AS o FROM range(20)")
    got = S.segmented_scan(rows, "k", ["o"], ["o"], S.Previous(), "x", LongType(), 6).collect()
    assert {r.o: r.x for r in got} == {i: i - 2 if i > 1 else None for i in range(20)}


def test_only_the_first_key_of_a_range_is_replayed(spark, monkeypatch):
    """The others are done where their range is read, and are not dealt again."""
    kept, write = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: (kept.append(write(df, name)), kept[-1])[1])
    rows = spark.range(3000).selectExpr("CAST(id % 300 AS STRING) AS k", "id AS o", "CASE WHEN id % 5 > 0 THEN id END AS v")
    made = S.segmented_scan(rows, "k", ["o"], ["v"], S.Previous(), "x", LongType(), 6)
    assert {r.o: r.x for r in made.collect()} == {o: o - 300 if o >= 300 and o % 5 else None for o in range(3000)}
    assert kept[0].where("__open").count() <= 60
