from pyspark.sql import functions as F

from fabula.functions import prompts as P
from fabula.operators import scenes as S


def test_templates_and_answers(spark):
    df = spark.createDataFrame([("$1 a\\b", None)], "x string, y string")
    out = df.select(P.render("{{ x }}-{{y}}-{{ z }}", x=F.col("x"), y=F.col("y")), P.lines(F.col("x"), F.col("y"), F.lit(""), F.lit("end"))).first()
    assert out[0] == "$1 a\\b-{{y}}-{{ z }}" and out[1] == "$1 a\\b\nend"
    answers = ["x ```json\n[1]\n```", " [2] "]
    assert [r[0] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(P.unwrap_json(F.col("a"))).collect()] == ["[1]", "[2]"]
    responses = ['{"output_text": "a"}', '{"choices": [{"message": {"content": "b"}}]}', '{"output": [{"content": [{"text": "c"}]}]}', "{}"]
    assert [r[0] for r in spark.createDataFrame([(a,) for a in responses], "a string").select(P.answer_text(F.col("a"))).collect()] == ["a", "b", "c", None]


def test_values_are_never_rendered(spark):
    df = spark.createDataFrame([("{{ b }}", "x", "{{ a }} {{ b }}{{a}} {{ c }}"), ("1", None, None), ("2", "y", "")], "a string, b string, t string")
    rows = P.render_rows(F.col("t"), F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")))
    got = df.select(P.render("{{ a }} {{ b }}{{a}} {{ c }}", a=F.col("a"), b=F.col("b")).alias("x"), rows.alias("y"), P.render_rows(F.col("t"), F.lit(None).cast("map<string,string>")).alias("z")).collect()
    assert got[0].x == got[0].y == "{{ b }} x{{ b }} {{ c }}" and got[0].z == "{{ a }} {{ b }}{{a}} {{ c }}"
    assert got[1].x == "1 {{ b }}1 {{ c }}" and got[1].y is None and got[2].y == ""


def test_styles_and_approval(spark):
    requests = spark.createDataFrame([(1, "in the style of Noir City"), (2, "plain")], "id int, text string")
    presets = spark.createDataFrame([(2, "city", "city"), (1, "noir", "noir")], "rank int, style string, trigger string")
    requests = requests.union(spark.createDataFrame([(3, " В  Стиле ＮＯＩＲ"), (4, "style of")], "id int, text string"))
    got = {r.id: (r.style, r.subject, r.avoided) for r in P.abstract_styles(requests, presets).collect()}
    assert got == {1: ("noir", "Noir City", ["noir"]), 2: (None, "plain", ["plain"]), 3: ("noir", "ＮＯＩＲ", ["noir"]), 4: (None, "style of", ["style of"])}
    assets = spark.createDataFrame([(1, "PENDING", "DRAFT"), (2, "PENDING", "DRAFT"), (3, "PENDING", "DRAFT")], "asset_id int, status string, type string")
    decided = spark.createDataFrame([(1, "APPROVED"), (2, "REJECTED")], "asset_id int, status string")
    assert {r.asset_id: (r.status, r.type) for r in S.approve(assets, decided).collect()} == {1: ("APPROVED", "REFERENCE"), 2: ("REJECTED", "GENERATED"), 3: ("PENDING", "DRAFT")}
    ids = spark.createDataFrame([("p", 2, 1, "a3"), ("p", 2, 2, "a1"), ("p", 1, 1, "a1"), ("p", 1, 2, "a2"), ("p", 3, 1, "primary")], "scope string, rank int, position int, id string")
    assert S.analysis_ids(ids).first().ids == ["a1", "a2", "a3", "primary"]
