"""From books to people, places, events, a graph and points, kept up to date in a folder.

Books belong to projects. ``add`` cuts books into chunks, asks a provider for facts, merges the projects
that these books are of, and brings their graph and points up to date. Each of the four stores
(sources/snapshots.py) changes in one step; what is read is always of one state. Adding the same
books again, in any order, gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import entities, project_graph, scenes, timeline, vectors
from fabula.operators import points as project_points
from fabula.operators.books import chunks as cut
from fabula.operators.extraction import Provider, extract_facts, fact_values
from fabula.operators.ledger import Ledger
from fabula.plans.storage import materialize, scratch
from fabula.sources import snapshots

FAMILIES = ("character", "location", "timeline")


def _id(kind: str, *parts: str | Column) -> Column:
    """A stable id of an entity of the project in ``scope``."""
    return T.uuid_from_sha256(F.concat_ws(":", "scope", F.lit(kind), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def facts_of(facts: DataFrame, family: str) -> DataFrame:
    """A family's facts as its merge takes them; a project is a scope."""
    v = fact_values(F.col("value"), family)
    place = F.concat_ws("/", F.lpad(F.col("book_id"), 20, "0"), F.lpad(F.col("order_index").cast("string"), 12, "0"), "chunk_id", F.lpad(F.col("n").cast("string"), 9, "0"))
    base = facts.where(F.col("family") == family).select(F.col("project").alias("scope"), place.alias("id"), "type", "entity_name", v["candidateNames"].alias("candidate_names"), "chapter_index", "confidence", "timeline_hint", "summary", "chunk_id", v.alias("v"))
    if family == "location":
        return base.select("*", F.col("v.parentName").alias("parent_name"), *(F.col(f"v.{x}").alias(y) for x, y in (("atmosphere", "atmosphere"), ("architecture", "architecture"), ("era", "era"), ("socialContext", "social_context"), ("lighting", "lighting")))).drop("v")
    if family == "timeline":
        marker = F.col("v.relativeMarker")
        return base.select(
            "*",
            F.coalesce("v.title", "entity_name").alias("title"),
            F.col("v.description").alias("description"),
            T.parse_absolute_date(F.col("v.absoluteDate")).alias("absolute_date"),
            marker.alias("relative_marker"),
            F.coalesce(F.when(F.col("v.relativeOrderHint") != "unknown", F.col("v.relativeOrderHint")), T.classify_marker(marker)).alias("hint"),
            F.col("v.anchorEventTitle").alias("anchor_title"),
            F.col("v.periodName").alias("period_name"),
            F.col("v.characterNames").alias("character_names"),
            F.col("v.locationNames").alias("location_names"),
            F.array("chunk_id").alias("source_chunk_ids"),
            F.col("id").alias("created_at"),  # the order of the text
        ).drop("v")
    return base.drop("v")


def merge_projects(facts: DataFrame) -> dict[str, DataFrame]:
    """All tables of the projects that the facts (of extraction, with project, book_id and places) are of."""
    people = entities.merge_characters(facts_of(facts, "character"))
    places = entities.merge_locations(facts_of(facts, "location"))
    project = F.col("scope").alias("project")
    characters = people["characters"].select("*", _id("Character", "root").alias("id"))
    versions = people["versions"].select("*", _id("CharacterVersion", "root", "version").alias("id"), _id("Character", "root").alias("character_id"))
    versions = materialize(versions, "versions")
    locations = places["locations"].select("*", _id("Location", "root").alias("id"), F.when(F.col("parent_root").isNotNull(), _id("Location", "parent_root")).alias("parent_id"))

    planned = timeline.planned_events(facts_of(facts, "timeline"))
    events = timeline.assign_order(timeline.merge_events(materialize(planned, "planned")))
    events = timeline.timeline_view(events).withColumn("id", _id("TimelineEvent", "chapter_index", T.normalize_text(F.col("title"))))
    events = materialize(events, "events")

    def found(owners: DataFrame, names: str) -> DataFrame:
        called = owners.select("scope", F.col("id").alias("entity_id"), F.lit(0).alias("rank"), F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
        return timeline.resolve_names(events, timeline.name_index(called), names)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "entity_id"))), lambda x: x["entity_id"])
        return rows.groupBy("scope", "id").agg(ids.alias(name))

    who = materialize(found(characters, "character_names"), "people-of-events")
    where = found(locations, "location_names")
    none = F.array().cast("array<string>")
    whole = events.join(listed(who, "involved_character_ids"), ["scope", "id"], "left").join(listed(where, "involved_location_ids"), ["scope", "id"], "left")
    whole = whole.withColumns({c: F.coalesce(c, none) for c in ("involved_character_ids", "involved_location_ids")})
    asked = who.join(events.select("scope", "id", "period_name", "hint", F.col("source_fact_ids").alias("event_fact_ids")), ["scope", "id"])
    asked = asked.select(F.concat_ws(":", "scope", "id").alias("event_id"), F.col("entity_id").alias("character_id"), "event_fact_ids", "period_name", "hint")
    best = timeline.best_versions(asked, versions.select("character_id", "version", "age", "hints", "source_fact_ids"), "character_id")
    best = best.join(versions.select("character_id", "version", F.col("id").alias("character_version_id"), "scope"), ["character_id", "version"])
    return {
        "characters": characters.select(project, "id", "canonical_name", "aliases"),
        "character_versions": versions.select(project, "id", "character_id", "version", "age", "appearance", "personality", "speech_manner", "clothing", F.struct("start_chapter", "end_chapter", "hints").alias("timeline_range"), F.col("confidence").alias("confidence_score"), "source_fact_ids"),
        "locations": locations.select(project, "id", F.col("canonical_name").alias("name"), "aliases", "parent_id"),
        "location_versions": places["versions"].select(project, _id("LocationVersion", "root", "version").alias("id"), _id("Location", "root").alias("location_id"), "version", "description", "atmosphere", "era", "social_context", F.col("lighting").alias("lighting_rules"), F.col("architecture").alias("architecture_rules"), F.col("confidence").alias("confidence_score"), "source_fact_ids"),
        "events": whole.select(project, "id", "title", "description", "chapter_index", "absolute_date", "relative_order", "order_index", F.struct("relative_marker", "hint", "anchor_title", "period_name").alias("relative_markers"), "involved_character_ids", "involved_location_ids", "source_chunk_ids", "confidence"),
        "event_versions": best.select(project, F.substring_index("event_id", ":", -1).alias("event_id"), "character_version_id"),
        "conflicts": entities.conflicts(
            ("attribute", people["attribute_conflicts"], "type"),
            ("duplicate", people["possible_duplicates"], "right_root"),
            ("location attribute", places["attribute_conflicts"], "attribute"),
            ("location duplicate", places["possible_duplicates"], "right_root"),
            ("location parent", places["parent_conflicts"], "parent_name"),
        ).withColumnRenamed("scope", "project"),
    }


@dataclass
class Library:
    spark: SparkSession
    folder: str
    provider: Provider | None = None
    ledger: Ledger | None = None

    def _now(self, store: str) -> snapshots.Snapshot:
        return snapshots.snapshot(self.spark, f"{self.folder}/{store}")

    def add(self, books: DataFrame, **cuts: int) -> None:
        """Adds books (project, book_id, title, text), in place of those of the same id. What was left
        undone by an earlier run is done by the next one that has the project."""
        spark = self.spark
        with scratch(spark):
            books = materialize(books.select("project", F.col("book_id").cast("long").alias("book_id"), "title", "text").dropDuplicates(["book_id"]), "books")
            chunks = cut(books, "book_id", **cuts).join(books.select("book_id", "project", F.col("title").alias("book_title")), "book_id")
            chunks = materialize(chunks.withColumn("book_id", F.col("book_id").cast("string")), "chunks")
            asked = extract_facts(chunks.select("chunk_id", F.col("book_id").cast("long").alias("doc_id"), "text"), self.provider, FAMILIES, ledger=self.ledger)
            made = materialize(asked.where("error is null"), "extracted")
            number = F.row_number().over(entities.Window.partitionBy("chunk_id", "family").orderBy("type", "entity_name", "summary", "value", "quote", "timeline_hint"))
            facts = made.withColumn("n", number).drop("error", "doc_id").join(chunks.select("chunk_id", "project", "book_id", "chapter_index", "order_index"), "chunk_id")
            # a book that moved leaves its old project, which has to be merged again too
            had = self._now("source").table("chunks")
            projects = books.select("project")
            if had is not None:
                projects = projects.union(had.join(chunks.select("book_id").distinct(), "book_id", "left_semi").select("project"))
            projects = materialize(projects.distinct(), "projects")
            snapshots.commit(spark, f"{self.folder}/source", {"chunks": chunks, "facts": facts}, "book_id", books.select("book_id"))
            self.refresh(projects)

    def refresh(self, projects: DataFrame) -> None:
        """Merges ``projects`` anew from all their facts, and their graph and points with them."""
        spark = self.spark
        with scratch(spark):
            source = self._now("source")
            facts = materialize(source.table("facts").join(projects, "project", "left_semi"), "project-facts")
            snapshots.commit(spark, f"{self.folder}/world", merge_projects(facts), "project", projects)
            tables = self.tables(projects)
            project_graph.sync_projects(spark, f"{self.folder}/graph", tables, projects)
            chunks = source.table("chunks").join(projects, "project", "left_semi").withColumnRenamed("chunk_id", "id")
            project_points.sync_points(spark, f"{self.folder}/points", project_points.project_points(tables | {"chunks": chunks}), projects)

    def tables(self, projects: DataFrame | None = None) -> dict[str, DataFrame]:
        """The merged tables, of one state."""
        now = self._now("world")
        names = {t for c in now.commits for t in c["tables"]}
        of = lambda t: t if projects is None else t.join(projects, "project", "left_semi")
        return {n: of(now.table(n)) for n in sorted(names)}

    def graph(self, *projects: str) -> tuple[DataFrame, DataFrame]:
        return project_graph.stored_graph(self.spark, f"{self.folder}/graph", list(projects))

    def timeline(self, project: str) -> DataFrame:
        return self._now("world").table("events", [project]).orderBy("relative_order", "chapter_index", "order_index")

    def search(self, project: str, query: str, limit: float | None = 10) -> DataFrame:
        """entity_type, entity_id, title and score of the project's points most similar to a text."""
        rows = self._now("points").table("points", [project])
        one = self.spark.createDataFrame([(query,)], "text string").select(vectors.hash_embedding(F.col("text")).alias("v")).first().v
        best = vectors.search_vectors(rows.select("id", "vector"), one, limit, "vector", "id").where("score <> 0")
        return rows.select("id", "entity_type", "entity_id", "title").join(best, "id").drop("id").orderBy(F.desc("score"), "entity_id")

    def resolve_scene(self, texts: DataFrame) -> DataFrame:
        """project, id, entity_type, entity_id, matched, score and status of the people and places named in texts (project,
        id, text), each looked for in its own project."""
        tables = self.tables()
        key = F.to_json(F.struct("project", "entity_type", F.col("id").alias("entity_id")))
        named = [tables[t].select("project", F.lit(kind).alias("entity_type"), "id", F.col(name).alias("_name"), "aliases") for t, kind, name in (("characters", "Character", "canonical_name"), ("locations", "Location", "name"))]
        rows = named[0].union(named[1]).withColumn("entity_id", key)
        labels = rows.select("entity_id", F.col("_name").alias("label"), F.lit(True).alias("is_name")).union(rows.select("entity_id", F.explode("aliases"), F.lit(False)))
        asked = texts.select(F.to_json(F.struct("project", "id")).alias("doc_id"), "text")
        found = scenes.entity_matches(asked, labels)
        of = lambda c, f: F.get_json_object(c, f"$.{f}")
        found = found.where(of("doc_id", "project").eqNullSafe(of("entity_id", "project"))).withColumn("entity_type", of("entity_id", "entity_type"))
        # people and places are resolved by themselves
        resolved = scenes.resolve_mentions(found.withColumn("doc_id", F.concat_ws("|", "entity_type", "doc_id")))
        text_id = F.regexp_replace("doc_id", r"^[A-Za-z]+\|", "")
        return resolved.select(of(text_id, "project").alias("project"), of(text_id, "id").alias("id"), "entity_type", of("entity_id", "entity_id").alias("entity_id"), "matched", "score", "status")
