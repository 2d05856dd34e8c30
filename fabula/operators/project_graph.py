"""The graph of a project, declared as rules over its merged tables.

A node rule makes one node of each row of a table, an edge rule one edge of each row, or of each
element of a list in it. Rules are statements in order: of several rows with one node's key the
last one's properties stay, all of them; edges with the same ends and type merge their properties by
name, the last known value of each. A property that is null is none. An edge needs both nodes.

All tables have a ``project``; a project is written whole, its nodes and edges at once, so that syncing
twice leaves the same graph.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.graph import graph_key, relation_label
from fabula.operators.scan import Previous, segmented_scan
from fabula.plans.storage import materialize
from fabula.sources import snapshots


@dataclass(frozen=True)
class Node:
    """A node for each row of ``table``. ``properties`` maps names to columns; rows with one id
    are taken in ``order``, as far as the table has such columns."""

    label: str
    table: str
    properties: dict[str, str]
    id: str = "id"
    order: tuple[str, ...] = ("position",)


@dataclass(frozen=True)
class Edge:
    """An edge for each row of ``table``, from ``source`` to ``target`` (label and column). A column of arrays
    gives an edge for each element. ``type`` is a name, or with ``type_of`` the column of a relationship's kind.
    ``constants`` are properties that are the same for all rows."""

    table: str
    source: tuple[str, str]
    target: tuple[str, str]
    type: str = ""
    type_of: str = ""
    properties: dict[str, str] | None = None
    constants: dict[str, str] | None = None
    order: tuple[str, ...] = ("position",)


def same(*names: str, **others: str) -> dict[str, str]:
    """Properties under the names that graphs have for the columns, and ``others``."""
    head = lambda n: n.split("_")
    return {head(n)[0] + "".join(w.capitalize() for w in head(n)[1:]): n for n in names} | others


_TIMES = ("created_at", "updated_at")
#: The nodes and edges of a project, their properties and their order.
NODES = (
    Node("Project", "projects", same("id", "name", "book_id", "book_analysis_id", "series_id", "book_ids", *_TIMES)),
    Node("Book", "books", same("id", "title", "author", "language", "content_hash", "file_hash")),
    Node("Character", "characters", same("id", "canonical_name", "aliases", *_TIMES)),
    Node("CharacterVersion", "character_versions", same("id", "character_id", "version", "age", "timeline_range", "appearance", "personality", "speech_manner", "clothing", "confidence_score", "source_fact_ids", "created_at")),
    Node("Location", "locations", same("id", "name", "parent_id", "aliases", *_TIMES)),
    Node("LocationVersion", "location_versions", same("id", "location_id", "version", "description", "atmosphere", "palette", "era", "social_context", "lighting_rules", "architecture_rules", "recurring_objects", "reference_asset_ids", "confidence_score", "source_fact_ids", "created_at")),
    Node("WorldObject", "objects", same("id", "name", "description", "visual_prompt", "metadata", *_TIMES)),
    Node("TimelineEvent", "events", same("id", "title", "description", "chapter_index", "absolute_date", "relative_order", "order_index", "relative_markers", "involved_character_ids", "involved_location_ids", "source_chunk_ids", "confidence", *_TIMES)),
    Node("Scene", "scenes", same("id", "title", "description", "status", "order_index", "prompt", "character_id", "location_id", *_TIMES)),
)
_ROLE = {"Book": "", "Character": "character", "Location": "location", "WorldObject": "world-object", "TimelineEvent": "timeline-event", "Scene": "scene"}
EDGES = (
    Edge("books", ("Project", "project"), ("Book", "id"), "RELATED_TO", properties={"role": "role"}),
    *(Edge(n.table, ("Project", "project"), (n.label, "id"), "RELATED_TO", constants={"role": _ROLE[n.label]}) for n in NODES if _ROLE.get(n.label)),
    Edge("character_versions", ("CharacterVersion", "id"), ("Character", "character_id"), "VERSION_OF"),
    Edge("location_versions", ("LocationVersion", "id"), ("Location", "location_id"), "VERSION_OF"),
    Edge("events", ("Character", "involved_character_ids"), ("TimelineEvent", "id"), "APPEARS_IN"),
    Edge("events", ("TimelineEvent", "id"), ("Location", "involved_location_ids"), "HAPPENS_AT"),
    Edge("event_versions", ("CharacterVersion", "character_version_id"), ("TimelineEvent", "event_id"), "APPEARS_IN"),
    Edge("relationships", ("Character", "source_character_id"), ("Character", "target_character_id"), type_of="type", properties=same("id", "description", "timeline_range"), order=("id",)),
    Edge("locations", ("Location", "id"), ("Location", "parent_id"), "LOCATED_IN"),
    Edge("objects", ("Character", "owner_character_id"), ("WorldObject", "id"), "OWNS"),
    Edge("objects", ("WorldObject", "id"), ("Location", "location_id"), "LOCATED_IN"),
    Edge("_adjacent", ("TimelineEvent", "before"), ("TimelineEvent", "id"), "BEFORE"),
    Edge("_adjacent", ("TimelineEvent", "id"), ("TimelineEvent", "before"), "AFTER"),
    Edge("scenes", ("Character", "character_id"), ("Scene", "id"), "APPEARS_IN"),
    Edge("scenes", ("Character", "character_id"), ("Scene", "id"), "VISITS"),
    Edge("scenes", ("Scene", "id"), ("Location", "location_id"), "HAPPENS_AT"),
)


def _properties(df: DataFrame, columns: dict[str, str], constants: dict[str, Column]) -> Column:
    """A map with every declared property that the table has a column for, nulls included."""
    kinds = dict(df.dtypes)
    made = {name: T.graph_value(F.col(c), kinds[c]) for name, c in columns.items() if c in kinds} | constants
    return F.map_from_arrays(F.array(*(F.lit(n) for n in made)), F.array(*made.values()))


def _position(df: DataFrame, order: tuple[str, ...], without: Iterable[str] = ()) -> Column:
    """What the last row has the most of; rows alike in that are told apart by their values, but for
    those of ``without``."""
    return F.struct(*(F.col(c) for c in order if c in df.columns), F.to_json(F.struct(*(c for c in df.columns if c not in without))).alias("_row"))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by("properties", "at").alias("properties"))


def _folded(rules: list[DataFrame], *keys: str, whole: bool) -> DataFrame:
    """Rows of all rules, those of one key as one: the last rule's properties, or all of them
    with the last value of each name. There are at most as many rows of a key as rules, and one row of
    one rule, which needs no exchange."""
    rows = reduce(DataFrame.unionByName, (r.withColumn("rule", F.lit(i)) for i, r in enumerate(rules)))
    if len(rules) == 1:
        merged = rows
    elif whole:
        merged = rows.groupBy(*keys).agg(F.max_by("properties", "rule").alias("properties"))
    else:
        each = F.transform(F.array_sort(F.collect_list(F.struct("rule", F.map_entries("properties").alias("entries")))), lambda x: x["entries"])
        merged = rows.groupBy(*keys).agg(F.flatten(each).alias("entries"))
        names = F.array_distinct(F.transform("entries", lambda e: e["key"]))
        last = lambda n: F.element_at(F.filter("entries", lambda e: e["key"] == n), -1)["value"]
        merged = merged.withColumn("properties", F.map_from_arrays(names, F.transform(names, last)))
    return merged.select(*keys, F.map_filter("properties", lambda _, v: v.isNotNull()).alias("properties"))


def graph_nodes(tables: dict[str, DataFrame], rules: Iterable[Node] = NODES) -> DataFrame:
    """(project, key, label, properties) of all tables that are there."""
    made: dict[str, list[DataFrame]] = {}
    for rule in rules:
        if rule.table in tables:
            df = tables[rule.table]
            key = graph_key("project", rule.label, rule.id)
            own = {"graphKey": key, "projectId": F.col("project").cast("string"), "label": F.lit(rule.label)}
            rows = df.where(F.col(rule.id).isNotNull()).select("project", key.alias("key"), F.lit(rule.label).alias("label"), _properties(df, rule.properties, own).alias("properties"), _position(df, rule.order).alias("at"))
            made.setdefault(rule.label, []).append(_last(rows, "project", "key", "label"))
    return reduce(DataFrame.unionByName, (_folded(rows, "project", "key", "label", whole=True) for rows in made.values()))


def _lists(df: DataFrame, rule: Edge) -> list[str]:
    """Columns of a rule's ends that give a row for each element."""
    kinds = dict(df.dtypes)
    return [c for _, c in (rule.source, rule.target) if kinds[c].startswith("array")]


def _ends(df: DataFrame, rule: Edge) -> DataFrame:
    """Rows with the ids of both ends; lists give a row for each element."""
    lists = _lists(df, rule)
    for (label, column), name in ((rule.source, "_source"), (rule.target, "_target")):
        df = df.withColumn(name, F.explode(column) if column in lists else F.col(column))
        df = df.where(F.trim(F.col(name).cast("string")) != "").withColumn(f"{name}_key", graph_key("project", label, name))
    return df


def event_order(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """(project, id, before): every event with the one before it, null for a project's first."""
    columns = ["project", *(c for c in ("relative_order", "chapter_index", "order_index") if c in events.columns), "id"]
    kind = events.schema["id"].dataType
    out = segmented_scan(events.select(*columns), "project", columns[1:], ["id"], Previous(), "before", kind, ranges)
    return out.select("project", "id", "before")


def graph_edges(tables: dict[str, DataFrame], nodes: DataFrame, rules: Iterable[Edge] = EDGES) -> DataFrame:
    """(project, source, type, target, properties) of edges between known nodes."""
    if "events" in tables and "_adjacent" not in tables:
        tables = tables | {"_adjacent": event_order(tables["events"])}
    made, keys = [], ["project", "source", "type", "target"]
    for rule in rules:
        if rule.table not in tables or any(c not in tables[rule.table].columns for _, c in (rule.source, rule.target)):
            continue
        df = tables[rule.table]
        kind = relation_label(F.col(rule.type_of)) if rule.type_of else F.lit(rule.type)
        own = {k: F.lit(v) for k, v in (rule.constants or {}).items()} | {"projectId": F.col("project").cast("string"), "type": kind}
        rows = _ends(df, rule).withColumns({"_type": kind, "_project": F.col("project")}).where("_type is not null")
        ends = [F.col("_project").alias("project"), F.col("_source_key").alias("source"), F.col("_type").alias("type"), F.col("_target_key").alias("target")]
        told = {name: c for name, c in (rule.properties or {}).items() if c in df.columns}
        if told:
            at = _position(df, rule.order, [c for c in _lists(df, rule) if c not in told.values()])
            made.append(_last(rows.select(*ends, _properties(df, told, own).alias("properties"), at.alias("at")), *keys))
        else:  # all rows of an edge say the same: only its ends travel, not the list that an element was in
            own["type"] = F.col("type")
            made.append(rows.select(*ends).distinct().select(*keys, _properties(df, {}, own).alias("properties")))
    both = _folded(made, *keys, whole=False)
    known = nodes.select("key")
    for end in ("source", "target"):
        both = both.join(known.withColumnRenamed("key", end), end, "left_semi")
    return both.select(*keys, "properties")


def project_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all projects in the tables; the nodes are written first, as edges
    are checked against them."""
    nodes = materialize(graph_nodes(tables), "graph-nodes")
    return nodes, graph_edges(tables, nodes)


def sync_projects(spark: SparkSession, store: str, tables: dict[str, DataFrame], projects: DataFrame | None = None) -> int:
    """Writes the graphs of all projects in ``tables`` in place of what the store has of them, nodes
    and edges at once; those in ``projects`` without rows have none afterwards."""
    nodes, edges = project_graph(tables)
    return snapshots.commit(spark, store, {"nodes": nodes, "edges": edges}, "project", projects)


def stored_graph(spark: SparkSession, store: str, projects: list | None = None) -> tuple[DataFrame, DataFrame]:
    now = snapshots.snapshot(spark, store)
    return now.table("nodes", projects), now.table("edges", projects)
