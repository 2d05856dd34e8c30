import random
import re

import corpus_pipeline
from fabula.llm.pieces import Vocabulary, decode_ids

SYLLABLES = {"en": "the ing th er on an re ha wh ough", "de": "sch ein ung ver keit ü ä ch tz st"}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_work_on_what_was_kept(spark, tmp_path):
    r = random.Random(7)

    def prose(lang, n):
        return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randrange(1, 5))) for _ in range(n))

    rows, passages = [], [prose("en", 40) for _ in range(3)]
    for i in range(80):
        lang = r.choice(["en", "de"])
        rows.append((i, prose(lang, 80), lang, "s", 0))
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[4][1] + " tail words here", "en", "s", 0), (102, prose("en", 60) + " " + passages[0], "en", "s", 0)]
    rows += [(103, "12345 !!", "en", "s", 0), (104, None, None, None, None), (105, prose("en", 60) + " password=a9ce335683f9772ddc " + prose("en", 20), "en", "s", 0)]
    rows += [(3, rows[3][1], "en", "s", 0), (None, prose("en", 60), "en", "s", 0), (None, prose("de", 60), None, None, 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    v = Vocabulary.load()
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(decode_ids(v, x.ids) for x in made if x.doc_id is None) == sorted(t for i, t, *_ in rows[-2:])
    assert len(made) == 83
    out = {x.doc_id: decode_ids(v, x.ids) for x in made if x.doc_id is not None}
    text = {i: t for i, t, *_ in rows}
    assert set(out) == set(range(80)) | {105}
    assert all(out[i] == text[i] for i in range(80))
    assert out[105] == re.sub("password=\\w+", "password=[SECRET]", text[105])
    # what went as a near duplicate is one, and none stays
    similar = lambda a, b: 10 * len(shingles(a) & shingles(b)) >= 8 * len(shingles(a) | shingles(b))
    assert similar(text[100], text[3]) and similar(text[101], text[4])
    kept = sorted(out)
    assert not any(similar(text[a], text[b]) for i, a in enumerate(kept) for b in kept[:i])


def test_columns_of_any_names_are_kept_and_losses_counted(spark, tmp_path):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice(SYLLABLES["en"].split()) for _ in range(3)) for _ in range(n))
    texts = [prose(60) for _ in range(12)]
    names = "score lang_pred ids shard block component path node signatures findings decoded spans contaminated".split()
    rows = [(i, t, "en", "s", 0, *[f"{n}{i}" for n in names]) for i, t in enumerate([*texts, texts[0], None])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        assert all(x.score == f"score{x.doc_id}" and x.ids == f"ids{x.doc_id}" for x in made.collect())
    assert {x.doc_id for x in corpus_pipeline.tokenize(spark, docs, str(tmp_path)).collect()} == set(range(14))
    got = {x.stage: (x.rows_in, x.rows_left, x.rows_out) for x in corpus_pipeline.losses(spark, docs, str(tmp_path)).collect()}
    assert got == {"language_id": (14, 1, 13), "near_duplicates": (13, 1, 12), "decontamination": (12, 1, 11), "secrets": (11, 0, 11), "sentencepiece": (11, 0, 11)}


def test_empty_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, clean, other, third = prose(40), prose(60), prose(60), prose(60)
    dirty = clean + " " + passage
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def left(stage, rows):
        path = str(tmp_path / f"d{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).write.parquet(path)
        return sorted((x.doc_id or 0, x.text or "") for x in stage(spark, spark.read.parquet(path), str(tmp_path)).collect())

    assert left(corpus_pipeline.decontaminate, [(None, dirty), (None, clean), (7, dirty), (7, other)]) == sorted([(0, clean), (7, other)])
    rows = [(5, clean), (5, other), (None, clean), (None, third), (None, third), (9, None), (None, ""), (None, "")]
    assert left(corpus_pipeline.near_duplicates, rows) == sorted([(5, clean), (5, other), (0, third), (9, ""), (0, ""), (0, "")])
