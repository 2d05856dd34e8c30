"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage takes documents (doc_id, text, lang, source, n_chars and any other columns, of
any names) and judges each row by its own text, never by an id that may be null or repeated.
Defined cases for all: an empty table gives an empty one; repeated rows are judged alike;
extra columns are kept but by the last stage; what a stage needs besides is in columns of
names that begin with two underscores.

Stages set the session to fewer rows in an Arrow batch, as documents are long: a batch
is held by the JVM and by a Python worker, and all stages share the same workers.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.cluster import shared_dir
from fabula.llm.decontam import contamination
from fabula.llm.langid import fit_hierarchy, predict_language
from fabula.llm.ngram_join import PartEnum, jaccard_components
from fabula.llm.pieces import Vocabulary, encode
from fabula.llm.secrets import corpus_forest, redact
from fabula.llm.words import release
from fabula.plans.storage import materialize, remove, scratch

#: Below this a text has hardly any sign of the language predicted for it.
LEAST_LANGUAGE_SCORE = 0.3
#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
NEAR = PartEnum(words=5, num=80, den=100)


#: Documents in an Arrow batch.
BATCH_ROWS = 1000
#: Columns that tell rows apart within a stage.
KEY, SINGLE, PREDICTED, SCORE = "__row_key", "__single", "__language", "__language_score"


def _prepare(spark: SparkSession) -> None:
    """Fewer rows in a batch; and what the stage before left on the driver goes."""
    gc.collect()
    release()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null ones included, or hardly like any known language, go. A
    table without any language label has none to know, and all its rows go."""
    _prepare(spark)
    model = fit_hierarchy(docs.select("doc_id", "text", "lang"))
    known = predict_language(docs, model, lang_col=PREDICTED, score_col=SCORE)
    return known.where((F.col(PREDICTED) != "und") & (F.col(SCORE) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a hash of id and text; what is found about a text is told by it, as ids
    may be null or have several texts."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once; one
    without an id only where no other is. Texts without a shingle are like no other and stay."""
    _prepare(spark)
    rows = _keyed(docs)
    found = jaccard_components(rows.select("text", F.col(KEY).alias("doc_id")), NEAR)
    groups = found.groupBy(F.col("doc_id").alias(KEY)).agg(F.min("component_id").alias("component"), F.min("n_shingles").alias("n"))
    ids = rows.select(KEY, F.col("doc_id").alias("id")).distinct()
    # a text without a shingle has its own key as its component
    first = F.min(F.struct(F.col("id").isNull(), "id", KEY, "n"))[KEY]
    kept = groups.join(ids, KEY).groupBy("component").agg(first.alias(KEY), F.min("n").alias(SINGLE))
    out = rows.join(kept.select(KEY, SINGLE), KEY)
    out = out.withColumn(SINGLE, F.when(F.col(SINGLE) == 0, F.monotonically_increasing_id()))
    return out.dropDuplicates([KEY, SINGLE]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in benchmark passages go; null texts, and all
    texts where there are no passages, stay."""
    _prepare(spark)
    rows = _keyed(docs)
    found = contamination(rows.select("text", F.col(KEY).alias("doc_id")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(bad, KEY, "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; every document stays, null and
    empty texts as they are."""
    _prepare(spark)
    clean = redact(docs, corpus_forest(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the columns that tell documents apart; null for a null
    text."""
    _prepare(spark)
    rows = encode(docs, Vocabulary.load())
    return rows.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("sentencepiece", tokenize),
]

#: Training and similarity search can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again, and what a stage
    wrote besides goes with the table that it read."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


def losses(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(stage, reason, rows_in, rows_left, rows_out) of a run over ``docs``: how many rows left
    in each stage, and why."""
    reasons = {"language_id": "no letter, or like no known language", "near_duplicates": "a near duplicate stays", "decontamination": "a twentieth is in benchmark passages"}
    rows = []
    before = docs.count()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"losses-{name}")
        after = docs.count()
        rows.append((name, reasons.get(name, "none may leave"), before, before - after, after))
        before = after
    return spark.createDataFrame(rows, "stage string, reason string, rows_in bigint, rows_left bigint, rows_out bigint")
