import random
import zlib

from fabula.llm import langid as L

SYLLABLES = {"en": "the ing th er on an re ha wh ough", "de": "sch ein ung ver keit ü ä ch tz st", "fr": "eau eux é è oi ment ç que an ai", "es": "ción ñ rr ll os ado mente ue ía ja", "xx": "zq kx jj wv qz xk vv zz qq kk"}


def make(lang, r, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus():
    r = random.Random(4)
    return [(i, make(lang, r, r.randrange(4, 120)), lang, "clash") for i in range(400) for lang in [r.choice(list(SYLLABLES))]]


def test_held_out_texts_are_recognised(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = L.identify(df).collect()
    lang = {i: x for i, _, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.95 * len(test)


def test_labels_of_held_out_rows_and_sources_are_not_used(spark):
    rows = corpus()
    shown = [(i, t, x, s) if zlib.crc32(str(i).encode()) % 4 != 2 else (i, t, "es", "other") for i, t, x, s in rows]
    schema = "doc_id bigint, text string, lang string, source string"
    a = {(r.doc_id, r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(rows, schema)).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(shown, schema).repartition(7)).collect()}


def test_columns_of_the_results_names_are_replaced(spark):
    df = spark.createDataFrame([(i, t, x, "clash", "clash") for i, t, x, _ in corpus()], "doc_id bigint, text string, lang string, score string, lang_pred string")
    model = L.fit_hierarchy(df.select("doc_id", "text", "lang"))
    made = L.predict_language(df, model)
    assert made.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and made.where("score >= 0 and lang_pred <> 'clash'").count() == 400
    kept = L.predict_language(df, model, lang_col="a", score_col="b").where("score = 'clash' and lang_pred = 'clash'")
    assert kept.count() == 400


def test_undetermined_empty_and_repeated(spark):
    rows = [(r[0], r[1], r[2]) for r in corpus()] + [(900, None, "en"), (901, "", "en"), (902, "123 !? \n", "en"), (903, "日本", None), (903, "日本", None), (None, "the thing", None), (904, "é", None), (905, "the " * 100_000, None)]
    schema = "doc_id bigint, text string, lang string"
    got = {}
    for r in L.identify(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[900] == got[901] == got[902] == [("und", 0.0)]
    assert len(got[903]) == 2 and got[903][0][0] != "und" and got[904][0][0] != "und" and got[None][0][0] == got[905][0][0] == "en"
    empty = spark.createDataFrame([], schema)
    assert L.identify(empty).count() == 0
    one = spark.createDataFrame([(1, "abc", None), (2, "abc", None)], schema)
    assert {r.lang_pred for r in L.identify(one).collect()} == {"und"}
    single = spark.createDataFrame([(i, "abc def", "en") for i in range(8)], schema)
    assert {(r.lang_pred, r.score) for r in L.identify(single).collect()} == {("en", 1.0)}
