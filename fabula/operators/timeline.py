"""Timeline: events from facts, merged, put in order and linked to versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fabula.functions import text as T
from fabula.operators.scan import sorted_scan
from fabula.plans.storage import materialize


def planned_events(facts: DataFrame) -> DataFrame:
    """Facts with ``seq`` within their scope and the order they begin with. They are dealt by ranges of
    scope and order, so that one scope may be many tasks, and counted on from range to range."""
    by = ["scope", "chapter_index", "created_at", "id"]
    dealt = facts.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*by)
    kept = materialize(dealt.withColumn("_place", F.monotonically_increasing_id()), "planned")
    # one small row for each scope of a range
    parts = kept.groupBy(F.col("_range").alias("_of"), F.col("scope").alias("_scope")).agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    earlier = Window.partitionBy("_scope").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    shifts = materialize(parts.select("_of", "_scope", shift.alias("_shift")), "shifts")
    rows = kept.join(shifts, (F.col("_range") == F.col("_of")) & F.col("scope").eqNullSafe(F.col("_scope")))
    rows = rows.withColumn("seq", (F.col("_place") + F.col("_shift")).cast("int")).drop("_range", "_place", "_of", "_scope", "_shift")
    return rows.withColumn("relative_order", (F.col("chapter_index") * 1000 + F.col("seq")).cast("long"))


def running_pairwise_mean(value: str, *keys: str, order: str = "seq") -> list[Column]:
    """((c1 + c2) / 2 + c3) / 2 ... in closed form: weights 1/2, 1/4 ... from the last value
    back, the first two alike. Use as ``sum(weight * value)`` per key."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    power = F.when(i == 1, n - 1).otherwise(n - i + 1)
    return [F.pow(F.lit(0.5), power).alias("weight")]


#: What is known of an event's place in time, later facts first.
MARKER_KEYS = ("relative_marker", "hint", "anchor_title", "period_name", "timeline_hint", "quote")


def united(value: str, order: str = "seq") -> Column:
    """The distinct, trimmed, non-empty strings of all arrays, first ones first."""
    items = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))), lambda x: x["v"])))
    return F.array_distinct(F.filter(F.transform(items, T.trim_ws), lambda x: x != ""))


def merge_events(events: DataFrame, digits: int = 4) -> DataFrame:
    """Events of one chapter with the same title as one: first title and description, united
    lists of names, chunks and facts, for each marker the last known, and the running
    pairwise mean of the confidences."""
    keys = ["scope", "chapter_index", "_title"]
    # every different title once: facts repeat them, and they are normalized in Python
    titles = events.select(F.col("title").alias("_raw")).distinct()
    titles = materialize(titles.withColumn("_title", T.normalize_text(F.col("_raw"))), "titles")
    e = events.join(titles, F.col("title").eqNullSafe(F.col("_raw"))).drop("_raw")
    e = e.select("*", *running_pairwise_mean("confidence", *keys))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    lists = [c for c in ("character_names", "location_names", "source_chunk_ids") if c in e.columns]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("id").alias("v")))), lambda x: x["v"])
    return e.groupBy(*keys).agg(
        F.min_by("title", "seq").alias("title"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"),
        F.min("seq").alias("seq"),
        F.min("relative_order").alias("relative_order"),
        *(last(c) for c in MARKER_KEYS if c in e.columns),
        F.min_by("absolute_date", "seq").alias("absolute_date"),
        *(united(c).alias(c) for c in lists),
        F.array_distinct(ordered).alias("source_fact_ids"),
        F.round(F.sum(F.col("weight") * F.col("confidence")), digits).alias("confidence"),
    ).drop("_title")


def name_index(entities: DataFrame) -> DataFrame:
    """(scope, name, entity_id) of normalized names. ``entities`` has (scope, entity_id, rank,
    name, canonical): of several entities with a name the last by rank has it, as later
    entries replace earlier ones."""
    named = entities.withColumn("name", T.normalize_text(F.col("name"))).where("name <> ''")
    return named.groupBy("scope", "name").agg(F.max_by("entity_id", F.struct("rank", "entity_id")).alias("entity_id"))


def resolve_names(events: DataFrame, index: DataFrame, names: str, event_id: str = "id") -> DataFrame:
    """(scope, event_id, entity_id, position): the distinct entities of the events' names,
    each at its first place; names of no entity are left out."""
    listed = events.select("scope", event_id, F.posexplode(names).alias("position", "_raw"))
    # every different name once: events repeat them, and they are normalized in Python
    called = listed.select("scope", "_raw").distinct().withColumn("name", T.normalize_text(F.col("_raw")))
    called = materialize(called, "names")  # else the join's test for nulls is made of every row, before they are told apart
    called = materialize(called.join(index, ["scope", "name"]).select("scope", "_raw", "entity_id"), "called")
    found = listed.join(called, ["scope", "_raw"])
    return found.groupBy("scope", event_id, "entity_id").agg(F.min("position").alias("position"))


def event_versions(links: DataFrame, versions: DataFrame, characters: DataFrame) -> DataFrame:
    """Bridge rows (event_id, version_id) with the version's number and its character's name."""
    v = versions.select("version_id", "version", "character_id")
    return links.dropDuplicates(["event_id", "version_id"]).join(v, "version_id").join(characters.select("character_id", "name"), "character_id")


def timeline_view(events: DataFrame) -> DataFrame:
    """Persisted events with ``order_index``, their number as merged, in the order of queries:
    by relative order, chapter and number. Missing lists are empty."""
    w = Window.partitionBy("scope").orderBy("seq")
    rows = events.withColumn("order_index", F.row_number().over(w) - 1)
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("character_names", "location_names") if c in rows.columns})
    at = Window.partitionBy("scope").orderBy("relative_order", "chapter_index", "order_index")
    return rows.withColumn("position", F.row_number().over(at) - 1)


def _order_step(state: dict, row: tuple) -> int:
    title, own, hint, anchor = row
    key = lambda x: " ".join((x or "").lower().split())
    before = state["by_title"].get(key(anchor)) if anchor else None
    order = (own if before is None else before) + T.MARKER_WEIGHTS.get(hint, 0) + state["n"]
    state["n"] += 1
    state["by_title"][key(title)] = order
    return order


def assign_order(events: DataFrame) -> DataFrame:
    """Replaces ``relative_order``: events are taken by date (undated last) and first order;
    each stands at its anchor's place, if that came before, or its own, plus the weight of
    its hint and its number. Later events of a title replace earlier ones as anchors."""
    start = lambda: {"n": 0, "by_title": {}}
    order = [F.col("absolute_date").asc_nulls_last(), "relative_order", "seq"]
    out = sorted_scan(events, "scope", order, ["title", "relative_order", "hint", "anchor_title"], start, _order_step, "_order", LongType())
    return out.withColumn("relative_order", F.col("_order")).drop("_order")


def adjacent(events: DataFrame) -> DataFrame:
    """(scope, id, next_id) in timeline order."""
    w = Window.partitionBy("scope").orderBy("relative_order", "chapter_index", "id")
    return events.select("scope", "id", F.lead("id").over(w).alias("next_id")).where("next_id is not null")


def best_versions(events: DataFrame, versions: DataFrame, key: str = "root") -> DataFrame:
    """The version of each event's character that fits best: 100 for a common source fact,
    30 and 20 for the period's name in range or age, 20 for a childhood; then the first."""
    period = F.lower(F.col("period_name"))
    age = F.lower(F.coalesce("age", F.lit("")))
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = (
        100 * has(F.arrays_overlap("event_fact_ids", "source_fact_ids"))
        + 30 * has(F.exists("hints", lambda h: F.lower(h).contains(period)) & (period != ""))
        + 20 * has(age.contains(period) & (period != ""))
        + 20 * has((F.col("hint") == "childhood") & (age.contains("child") | age.contains("дет")))
    )
    scored = events.join(versions, key).withColumn("score", score.cast("long"))
    first = Window.partitionBy("event_id", key).orderBy(F.desc("score"), "version")
    return scored.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("event_id", key, "version", "score")
