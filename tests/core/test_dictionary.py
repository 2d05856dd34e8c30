import random

from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import dictionary as D
from fabula.operators import scenes as S


def test_stems_equal_those_of_columns(spark):
    words = ["домами", "книгами", "книга", "abcdами", "лес", "ёлками", "word", "фонтана", "фонтан", "майклом", "а", "зданиями5", "бегущего"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem_token(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: D.stem(w) for w in words}


def brute(texts, labels):
    """Whole phrases between blanks, else stems of single words."""
    out = set()
    for i, t in texts.items():
        stems = {D.stem(w) for w in t.split(" ")}
        for n, label in labels:
            if f" {label} " in f" {t} ":
                out.add((i, n, True))
            elif " " not in label and D.stem(label) in stems:
                out.add((i, n, False))
    return out


def test_equals_brute_force_in_any_blocks(spark):
    r = random.Random(2)
    vocabulary = ["дом", "дома", "домами", "лесами", "лес", "a", "b", "a-b", "c1", "abcd", "abcdами", "фонтана", "фонтан"]
    texts = {i: " ".join(r.choices(vocabulary, k=r.randrange(1, 12))) for i in range(150)}
    labels = list(enumerate(sorted({" ".join(r.choices(vocabulary, k=k)) for k in (1, 1, 1, 2, 2, 3, 4) for _ in range(8)})))
    df = spark.createDataFrame([*texts.items(), (900, None), (901, ""), (902, "?!")], "id bigint, text string")
    lab = spark.createDataFrame(labels, "number bigint, l string")
    want = brute(texts, labels)
    assert {x[2] for x in want} == {True, False}
    for chars in (10**6, 40, 1):
        assert {tuple(x) for x in D.find_labels(df, lab, "id", "text", chars).collect()} == want
    assert D.find_labels(df, lab.where("false"), "id", "text").count() == 0


def test_a_label_of_a_thousand_words(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    texts = spark.createDataFrame([(1, f"so {long.upper()}. end"), (2, long[:-1]), (3, "w1 w2")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, long, True), (8, "W1, w2", False), (9, "W1, w2", True)], "entity_id bigint, label string, is_name boolean")
    got = {(r.doc_id, r.entity_id, r.score) for r in S.entity_matches(texts, labels).collect()}
    assert got == {(1, 7, 1.0), (1, 8, 1.05), (1, 9, 1.0), (2, 8, 1.05), (2, 9, 1.0), (3, 8, 1.05), (3, 9, 1.0)}
