"""The points of a project: what of it can be searched for by meaning, embedded where it changed.

A point is a chunk, a version of a character or location, or an event of the timeline, with a title and the
text that is embedded. Its id is made of project, kind and id, and its digest of title and text; a
point whose digest is stored already keeps its vector.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.vectors import hash_embedding
from fabula.plans.storage import materialize, scratch
from fabula.sources import snapshots

COLUMNS = ["project", "entity_type", "entity_id", "id", "title", "text", "digest"]


def _text(df: DataFrame, *columns: str) -> Column:
    """The values that are there and not empty, one on each line; structures as JSON."""
    kinds = dict(df.dtypes)
    values = [T.json_text(F.col(c), kinds[c] == "string") if kinds[c].startswith(("struct", "array", "map", "string")) else F.col(c).cast("string") for c in columns if c in kinds]
    return F.concat_ws("\n", *(F.when(v != "", v) for v in values))


def _labelled(name: str, column: str) -> Column:
    return F.concat(F.lit(f"{name}:"), F.col(column).cast("string"))


def _point(df: DataFrame, kind: str, title: Column, text: Column) -> DataFrame:
    key = F.concat_ws(":", F.col("project").cast("string"), F.lit(kind), F.col("id").cast("string"))
    rows = df.where("id is not null").select(F.col("project").cast("string").alias("project"), F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), T.uuid_from_sha256(key).alias("id"), title.alias("title"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct("title", "text")), 256)).select(*COLUMNS)


def project_points(tables: dict[str, DataFrame]) -> DataFrame:
    """(project, entity_type, entity_id, id, title, text, digest) of all tables that are there: chunks (with
    their ``book_title``), versions (of the ``characters`` and ``locations``) and events."""
    made = []
    if "chunks" in tables:
        df = tables["chunks"]
        title = F.concat_ws(" ", F.col("book_title"), F.lit("chapter"), F.col("chapter_index").cast("string"), F.lit("chunk"), F.col("order_index").cast("string"))
        made.append(_point(df, "BookChunk", title, F.col("text")))
    for versions, owners, key, name, kind, values in (
        ("character_versions", "characters", "character_id", "canonical_name", "CharacterVersion", ("age", "timeline_range", "appearance", "personality", "speech_manner", "clothing", "visual_prompt")),
        ("location_versions", "locations", "location_id", "name", "LocationVersion", ("description", "atmosphere", "palette", "era", "social_context", "lighting_rules", "architecture_rules", "recurring_objects")),
    ):
        if versions in tables and owners in tables:
            owner = tables[owners].select("project", F.col("id").alias(key), F.col(name).alias("_name")).dropDuplicates(["project", key])
            df = tables[versions].join(owner, ["project", key])
            made.append(_point(df, kind, F.concat_ws(" ", "_name", F.concat(F.lit("v"), F.col("version").cast("string"))), _text(df, "_name", *values)))
    if "events" in tables:
        df = tables["events"].withColumn("_chapter", _labelled("chapter", "chapter_index")).withColumn("_order", _labelled("relativeOrder", "relative_order"))
        made.append(_point(df, "TimelineEvent", F.col("title"), _text(df, "title", "description", "relative_markers", "_chapter", "_order")))
    return reduce(DataFrame.unionByName, made)


def sync_points(spark: SparkSession, store: str, points: DataFrame, projects: DataFrame | None = None) -> dict[str, int]:
    """Brings what ``store`` has of the projects of ``points`` (and of ``projects``) up to date in one step;
    returns how many points were embedded and how many went. Without a change nothing is written."""
    with scratch(spark):
        points = materialize(points.dropDuplicates(["id"]), "points")
        named = points.select("project").distinct() if projects is None else projects.select(F.col(projects.columns[0]).cast("string").alias("project")).union(points.select("project")).distinct()
        known = snapshots.snapshot(spark, store).table("points")
        if known is None:
            known = points.withColumn("vector", F.array().cast("array<double>")).where("false")
        known = known.join(named, "project", "left_semi")
        same = known.select("id", "digest")
        changed = points.join(same, ["id", "digest"], "left_anti").withColumn("vector", hash_embedding(F.col("text")))
        changed = materialize(changed, "changed-points")
        gone = materialize(known.join(points.select("id"), "id", "left_anti").select("id", "project"), "gone-points")
        touched = materialize(changed.select("project").union(gone.select("project")).distinct(), "touched-projects")
        counts = {"embedded": changed.count(), "removed": gone.count()}
        if any(counts.values()):
            rest = known.join(touched, "project", "left_semi").join(changed.select("id").union(gone.select("id")), "id", "left_anti")
            snapshots.commit(spark, store, {"points": rest.select(*COLUMNS, "vector").unionByName(changed.select(*COLUMNS, "vector"))}, "project", touched)
        return counts
