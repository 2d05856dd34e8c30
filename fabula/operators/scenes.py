"""Scene context: entities named in a text, references, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.dictionary import find_labels
from fabula.plans.storage import materialize

MARGIN = 0.08


def entity_matches(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best match of each entity in each text. ``labels``: (entity_id, label, is_name), of any
    length. Whole phrases score 1, or 1.05 as an alias; one word of the same stem 0.92 or 0.97.
    Texts are read where they are; only hits travel."""
    lab = labels.withColumn("l", T.scene_text(F.col("label"))).where("l <> ''")
    lab = materialize(lab.select("entity_id", "label", "is_name", "l", F.monotonically_increasing_id().alias("row")), "labels")
    numbered = lab.groupBy("l").agg(F.min("row").alias("number"))
    numbered = materialize(numbered, "label-numbers")
    lab = lab.join(numbered, "l").select("entity_id", "label", "is_name", "number")
    hits = find_labels(texts, numbered, id_col, text_col).join(lab, "number")
    score = F.when(F.col("whole"), F.when(F.col("is_name"), 1.0).otherwise(1.05)).otherwise(F.when(F.col("is_name"), 0.92).otherwise(0.97))
    hits = hits.withColumn("score", score)
    best = F.max_by("label", F.struct("score", F.col("is_name"), "label"))
    return hits.groupBy(id_col, "entity_id").agg(F.max("score").alias("score"), best.alias("matched"))


def resolve_mentions(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Matches with ``status``: of those with the same mention the best is resolved, unless
    another is within the margin: then all of these are ambiguous."""
    mention = T.scene_text(F.col("matched"))
    w = Window.partitionBy(id_col, "mention")
    m = matches.withColumn("mention", mention).withColumn("_best", F.max("score").over(w))
    close = F.col("score") >= F.col("_best") - MARGIN
    n = F.sum(close.cast("int")).over(w)
    status = F.when(~close, "other").when(n > 1, "ambiguous").otherwise("resolved")
    return m.withColumn("status", status).drop("_best")


def create_suggestions(texts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mention): capitalized mentions of which some word's stem is in no resolved label;
    ``known``: (id, label)."""
    tokens = lambda c: F.split(T.scene_text(c), " ")
    mentions = texts.select(id_col, F.explode(T.capitalized_mentions(F.col(text_col))).alias("mention"))
    stems = mentions.select(id_col, "mention", F.explode(tokens(F.col("mention"))).alias("w")).where("w <> ''").withColumn("stem", T.stem_token(F.col("w")))
    have = known.select(id_col, F.explode(tokens(F.col("label"))).alias("w")).select(id_col, T.stem_token(F.col("w")).alias("stem")).distinct()
    return stems.join(have, [id_col, "stem"], "left_anti").select(id_col, "mention").distinct()


def missing_references(required: DataFrame, approved: DataFrame, *keys: str) -> DataFrame:
    """Required rows without an approved asset of the same keys."""
    return required.join(approved.select(*keys), list(keys), "left_anti")


def validate(checks: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Score, verdict and recommendation per asset from (type, passed, score)."""
    s = F.when(F.isnan("score") | F.col("score").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
    out = checks.withColumn("_s", s).groupBy(id_col).agg(
        (F.floor(F.avg("_s") * 100 + 0.5) / 100).alias("score"),
        F.bool_and("passed").alias("all_passed"),
        F.bool_or((F.col("type") == "character") & ~F.col("passed")).alias("character_failed"),
    )
    advice = F.when((F.col("score") >= 0.82) & F.col("all_passed"), "approve").when(F.col("score") < 0.45, "regenerate").when(F.col("character_failed"), "inpaint").otherwise("manual_review")
    return out.withColumn("recommendation", advice)


def next_order_index(scenes: DataFrame, key: str, order: str = "order_index") -> DataFrame:
    """(key, next): one more than the largest, 0 without any."""
    return scenes.groupBy(key).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_index"))


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def approve(assets: DataFrame, decisions: DataFrame, key: str = "asset_id") -> DataFrame:
    """Assets with their decided status: approved ones are references, all others generated."""
    joined = assets.join(decisions.select(key, F.col("status").alias("_status")), key, "left")
    status = F.coalesce("_status", "status")
    kind = F.when(F.col("_status").isNull(), F.col("type")).when(F.col("_status") == "APPROVED", "REFERENCE").otherwise("GENERATED")
    return joined.withColumns({"status": status, "type": kind}).drop("_status")


def analysis_ids(sources: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, ids): distinct ids in the order of their sources' rank, and within one by position.
    ``sources`` has (scope, rank, position, id)."""
    first = sources.where("id is not null").groupBy(scope, "id").agg(F.min(F.struct("rank", "position")).alias("at"))
    return first.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
