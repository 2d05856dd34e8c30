import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fabula.functions import prompts as P
from fabula.functions import text as T
from fabula.operators import entities as E
from fabula.operators import timeline as L
from fabula.operators import vectors as V
from fabula.operators import views
from fabula.sources import books as B
from fabula.sources.tables import read_scope, replace_scope

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = "fact_families typed_json json_safe partial_update name_lookup optional_chain location_conflicts timeline_view graph_context chapter_ranges chunk_book event_merge version_match_top1 prompt_lookup entity_resolution".split()


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in names) for r in df.collect())
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(__spark_entry__.oracle_sql()[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names and got and got == sorted(tuple(str(plain(r[i])) for i in at) for r in rel.fetchall())


def test_typed_values_ignore_other_types(spark):
    rows = [('{"a":"x","l":["p",1,null,"q"]}',), ('{"a":1,"l":"p"}',), ("[]",), ("no json",), (None,), ('{"a":null}',)]
    v = E.typed_values(F.col("j"), ("a",), ("l",))
    got = [(r.v.a, r.v.l) for r in spark.createDataFrame(rows, "j string").coalesce(1).select(v.alias("v")).collect()]
    assert got == [("x", ["p", "q"])] + [(None, [])] * 5
    safe = spark.createDataFrame(rows, "j string").coalesce(1)
    assert [r[0] for r in safe.select(E.safe_json(F.col("j"))).collect()][-1] == "{}"
    assert [r[0] for r in safe.select(E.safe_json(F.col("j"), True)).collect()][-1] == '{"a":null}'


def test_later_names_replace_earlier_ones(spark):
    people = spark.createDataFrame([("s", "p1", 1, "Anna"), ("s", "p2", 2, " ANNA "), ("s", "p1", 1, "Anya"), ("t", "p3", 1, "Anna")], "scope string, entity_id string, rank int, name string")
    events = spark.createDataFrame([("s", 1, ["anya", "Anna", "anna", "?"]), ("t", 2, ["Anya"])], "scope string, id int, names array<string>")
    got = {(r.id, r.entity_id, r.position) for r in L.resolve_names(events, L.name_index(people), "names").collect()}
    assert got == {(1, "p1", 0), (1, "p2", 1)}


def test_explicit_nulls_and_last_versions(spark):
    rows = spark.createDataFrame([("a", 1, "x", "y"), ("a", 2, "x", "y"), ("b", 1, "x", "y")], "k string, version int, u string, v string")
    patches = spark.createDataFrame([("a", "new", None, ["v"])], "k string, u string, v string, clear array<string>")
    got = sorted(map(tuple, E.patch_last_version(rows, patches, "k", "clear").collect()), key=str)
    assert got == [("a", 1, "x", "y"), ("a", 2, "new", None), ("b", 1, "x", "y")]


def test_views(spark):
    rows = spark.createDataFrame([(1, "émile"), (2, "Zoe"), (3, "Eva"), (4, "eva")], "id int, name string")
    assert [r.name for r in views.by_name(rows).collect()] == ["émile", "Eva", "eva", "Zoe"] or [r.name for r in views.by_name(rows).collect()] == ["Eva", "eva", "émile", "Zoe"]
    bad = views.checked(rows, short=F.length("name") < 4, known=F.col("name") == "Eva").where("id = 1").first()
    assert bad.errors == ["short", "known"]
    points = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, label string")
    assert [r.id for r in V.deleted(points, label=["a"]).orderBy("id").collect()] == [2, 3] and V.deleted(points, label=[]).count() == 3


def test_dates_titles_and_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(F.unix_seconds(T.parse_absolute_date(F.lit("1970-01-01T01:00:00+01:00")))) == 0 and one(T.parse_absolute_date(F.lit("soon"))) is None
    assert one(T.scene_title(F.lit("x " * 60))) == ("x " * 60).strip()[:77] + "..."
    assert one(P.answer_text(F.lit('{"output":[{"content":[{"text":"a"},{"image":1}]},{"x":1},{"content":[{"text":"b"}]}]}'))) == "ab"
    assert one(P.answer_text(F.lit('{"choices":[{"message":{"content":"c"}}]}'))) == "c"
    text = "é plain"
    assert one(T.unicode_normalize(F.lit(text))) == "é plain" and one(T.unicode_normalize(F.lit("ascii"))) == "ascii" and one(T.unicode_normalize(F.lit(None).cast("string"))) is None


def test_scopes_without_new_rows_are_cleared(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "scope string, v string")
    replace_scope(rows(("a", "1"), ("b:c", "2"), ("d", "3")), path, "scope")
    replace_scope(rows(("a", "9")), path, "scope", ["a", "b:c"])
    assert {tuple(r) for r in read_scope(spark, path, "scope").select("scope", "v").collect()} == {("a", "9"), ("d", "3")}


def test_files_are_stored_by_content_and_metadata_overrides(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.TXT"):
        (tmp_path / "in" / name).write_text("Same  text")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "content")
    stored = B.save_originals(files, f"file://{tmp_path}/out").collect()
    assert len(stored) == 2 and len({r.stored for r in stored}) == 1 and re.fullmatch(r".*/[0-9a-f]{64}\.txt", stored[0].stored)
    assert len(list((tmp_path / "out").iterdir())) == 1
    path = files.where("path like '%a.txt'").first().path
    given = spark.createDataFrame([(path, "T", None, "en")], "path string, title string, author string, language string")
    made = {r.path: (r.text, r.title, r.language) for r in B.read_books(spark, str(tmp_path / "in"), metadata=given).collect()}
    assert made[path] == ("Same text", "T", "en") and len(made) == 2
