from pyspark.sql import functions as F

from fabula.operators import entities as E
from fabula.operators import timeline as L

FACT = "scope string, id string, type string, entity_name string, candidate_names array<string>, chapter_index bigint, confidence double, timeline_hint string, summary string, parent_name string, era string"


def fact(id, kind, name, summary="s", chapter=1, candidates=(), confidence=0.9, hint=None, parent=None, era=None):  # noqa: A002
    return ("p", id, kind, name, list(candidates), chapter, confidence, hint, summary, parent, era)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def test_aliases_become_one_character(spark):
    out = E.merge_characters(table(spark, fact("f1", "CHARACTER_MENTION", "John", candidates=["Johnny", "Mr. Smith"]), fact("f2", "CHARACTER_ALIAS", "Johnny", candidates=["John"])))
    rows = out["characters"].collect()
    assert [(r.canonical_name, r.aliases) for r in rows] == [("John", ["Johnny", "Mr. Smith"])]


def test_versions_split_at_changes(spark):
    rows = [fact("f1", "CHARACTER_AGE", "Mira", "child", 1), fact("f2", "CHARACTER_APPEARANCE", "Mira", "short hair", 1), fact("f3", "CHARACTER_AGE", "Mira", "adult", 8), fact("f4", "CHARACTER_APPEARANCE", "Mira", "silver hair", 8)]
    got = E.merge_characters(table(spark, *rows))["versions"].orderBy("version").collect()
    assert [(r.version, r.age, r.appearance) for r in got] == [(1, "child", "short hair"), (2, "adult", "silver hair")]
    assert got[0].source_fact_ids == ["f1", "f2"] and (got[1].start_chapter, got[1].end_chapter) == (8, 8)


def test_a_new_segment_forgets_what_was_said(spark):
    rows = [fact("f1", "CHARACTER_AGE", "A", "a"), fact("f2", "CHARACTER_PLOT_CHANGE", "A"), fact("f3", "CHARACTER_AGE", "A", "b")]
    got = E.version_segments(E.entity_groups(table(spark, *rows))).orderBy("id").collect()
    assert [r.version for r in got] == [1, 2, 2]


def test_conflicts(spark):
    out = E.merge_characters(table(spark, fact("f1", "CHARACTER_APPEARANCE", "Ada", "blue eyes"), fact("f2", "CHARACTER_APPEARANCE", "Ada", "green eyes")))["attribute_conflicts"].collect()
    assert len(out) == 1 and [x.fact_id for x in out[0].facts] == ["f1", "f2"]


def test_locations_parents_and_duplicates(spark):
    tree = E.merge_locations(table(spark, fact("f1", "LOCATION_MENTION", "Old City"), fact("f2", "LOCATION_MENTION", "Park", parent="Old City"), fact("f3", "LOCATION_MENTION", "Fountain", parent="Park")))
    rows = {r.canonical_name: r for r in tree["locations"].collect()}
    assert len(rows) == 3 and rows["Park"].parent_root == rows["Old City"].root and rows["Fountain"].parent_root == rows["Park"].root
    twins = E.merge_locations(table(spark, fact("f1", "LOCATION_MENTION", "Old Park"), fact("f2", "LOCATION_MENTION", "The Old Park")))
    assert twins["locations"].count() == 2 and twins["possible_duplicates"].count() == 1


EVENT = "scope string, id string, chapter_index bigint, created_at timestamp, title string, description string, hint string, anchor_title string, absolute_date date, confidence double"


def test_relative_order(spark):
    rows = [("p", "f1", 4, None, "Mara reigns", None, None, None, None, 0.5), ("p", "f2", 5, None, "Childhood scene", None, "childhood", None, None, 0.5), ("p", "f3", 4, None, "Mara returns", None, "next_day", "Mara reigns", None, 0.5)]
    got = L.assign_order(L.merge_events(L.planned_events(spark.createDataFrame(rows, EVENT)))).collect()
    assert {r.title: r.relative_order for r in got} == {"Mara reigns": 4000, "Mara returns": 4011, "Childhood scene": -994996}


def test_duplicate_events_have_the_running_pairwise_mean(spark):
    rows = [("p", f"f{i}", 1, None, t, d, None, None, None, c) for i, (t, d, c) in enumerate([("A b", None, 0.9), ("a  B", "x", 0.5), ("A B", "y", 0.1)])]
    [r] = L.merge_events(L.planned_events(spark.createDataFrame(rows, EVENT))).collect()
    assert r.confidence == 0.4 and r.title == "A b" and r.description == "x" and r.source_fact_ids == ["f0", "f1", "f2"]


def test_markers(spark):
    from pyspark.sql import functions as F

    from fabula.functions import text as T

    texts = ["In childhood", "the next day", "через год", "before", "afterwards", "soon", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(T.classify_marker(F.col("x"))).collect()
    assert [r[0] for r in got] == ["childhood", "next_day", "year_later", "before", "after", "unknown", None, None]


def test_decomposed_and_composed_spellings_are_one_name(spark):
    import unicodedata

    from fabula.functions import text as T

    forms = ["Zoë", "José Ñandú", "Йога", "ﬁne", "Ｎｏｉｒ", "Å", "á̧", "½ x", "…"]
    rows = [(f, unicodedata.normalize("NFD", f)) for f in forms]
    got = spark.createDataFrame(rows, "a string, b string").select("a", T.unicode_normalize(E.F.col("a")), T.unicode_normalize(E.F.col("b")), T.unicode_normalize(E.F.col("b"), "NFKC"), T.unicode_normalize(E.F.col("a"), "NFKC")).collect()
    for r in got:
        n, k = unicodedata.normalize("NFC", r[0]), unicodedata.normalize("NFKC", r[0])
        assert tuple(r)[1:] == (n, n, k, k)
    names = ["Zoë", unicodedata.normalize("NFD", "Mr. Zoë"), "Other"]
    facts = spark.createDataFrame([("s", i, "CHARACTER_AGE", n, [], 1, 0.5, None, n) for i, n in enumerate(names)], "scope string, id int, type string, entity_name string, candidate_names array<string>, chapter_index int, confidence double, timeline_hint string, summary string")
    assert E.entity_groups(facts).select("root").distinct().count() == 2
    found = E.attribute_conflicts(facts.withColumn("root", E.F.lit("r")).where("id < 2").withColumn("summary", E.F.regexp_replace("summary", "Mr. ", "")))
    assert found.count() == 0


def test_names_that_facts_repeat_are_normalized_once(spark):
    """Each pair of names once, however many facts have it; facts without a name or scope stay."""
    from fabula.functions import text as T

    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        @F.udf("string")
        def tell(x):
            seen.add(1)
            return x

        return tell(T.normalize_text(name))

    rows = [("s", i, f"N{i % 3}", ["n0"] if i % 3 == 2 else []) for i in range(300)] + [("s", 300, None, None), (None, 301, "n1", [" "]), ("t", 302, "n2", None)]
    got = {r.id: r.root for r in E.entity_groups(spark.createDataFrame(rows, "scope string, id int, entity_name string, candidate_names array<string>"), counted).collect()}
    assert len(got) == 303 and {got[i] for i in range(300) if i % 3 != 1} == {"s\x1fn0"} and got[1] == "s\x1fn1" and got[302] == "t\x1fn2"
    assert got[300] == "s" and got[301] == "n1" and seen.value < 60


def test_events_of_one_scope_are_numbered_by_many_tasks(spark):
    import datetime

    from pyspark.sql import functions as F

    day = lambda n: datetime.datetime(2024, 1, 1 + n) if n else None
    rows = [("a" if i % 10 == 9 else "hot", f"f{i:04}", i * 7 % 5, day(i * 11 % 3), None) for i in range(1200)] + [("z", "f", 1, None, 7), (None, "n1", 2, None, None), (None, "n2", 1, None, None)]
    df = spark.createDataFrame(rows, "scope string, id string, chapter_index int, created_at timestamp, seq int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = L.planned_events(df)
        got = {(r.scope, r.id): (r.seq, r.relative_order) for r in made.collect()}
        tasks = [r["count"] for r in made.where("scope = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for scope in ("a", "hot", "z", None):
        mine = sorted((r for r in rows if r[0] == scope), key=lambda r: (r[2], r[3] or datetime.datetime.min, r[1]))
        want |= {(scope, r[1]): (i, r[2] * 1000 + i) for i, r in enumerate(mine)}
    assert got == want and made.schema["seq"].dataType.simpleString() == "int"
    assert len(tasks) > 1 and max(tasks) < 800


def test_titles_and_names_are_normalized_once(spark):
    """What is left to do for every event has no Python in it, and finds the same."""
    titled = spark.createDataFrame([("p", f"f{i}", 1, None, t, None, None, None, None, 0.5) for i, t in enumerate(["A b", "a  B", None, None])], EVENT)
    merged = L.merge_events(L.planned_events(titled))
    assert sorted(map(len, (r.source_fact_ids for r in merged.collect()))) == [2, 2]
    people = spark.createDataFrame([("s", "p1", 1, "Anna"), ("t", "p2", 1, "Anna")], "scope string, entity_id string, rank int, name string")
    events = spark.createDataFrame([("s", 1, ["?", " anna", "ANNA", None]), ("t", 2, ["anna"]), ("u", 3, ["anna"])], "scope string, id int, names array<string>")
    found = L.resolve_names(events, L.name_index(people), "names")
    assert {(r.id, r.entity_id, r.position) for r in found.collect()} == {(1, "p1", 1), (2, "p2", 0)}
    for df in (merged, found):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
