"""Knowledge graph as two tables: nodes (key, label, id) and edges (source, type, target)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.plans.storage import materialize

#: Relationship kinds and the edges they become.
RELATIONS = {
    "KNOWS": "KNOWS",
    "ALLY": "KNOWS",
    "MENTOR": "KNOWS",
    "ROMANTIC": "LOVES",
    "ENEMY": "HATES",
    "RIVAL": "HATES",
    "FAMILY": "RELATED_TO",
    "SERVES": "RELATED_TO",
    "OTHER": "RELATED_TO",
}


def relation_label(kind: Column) -> Column:
    """The edge a relationship becomes; null for unknown kinds."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair]), kind)


def graph_key(project: Column | str, label: str, key: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws(":", col(project).cast("string"), F.lit(label), col(key).cast("string"))


def _in_order(tables: tuple[DataFrame, ...]) -> tuple[DataFrame, list[list[str]]]:
    """All rows with ``_at``, which is larger for later tables and, within one, for a larger
    ``position``, if it has that column; and the properties that each table has."""
    made, have = [], []
    for i, t in enumerate(tables):
        position = F.col("position").cast("double") if "position" in t.columns else F.lit(0.0)
        made.append(t.withColumn("_at", F.struct(F.lit(i).alias("table"), position.alias("position"))).drop("position"))
        have.append([c for c in t.columns if c != "position"])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made), have


def nodes(*tables: DataFrame) -> DataFrame:
    """Nodes of all tables (key, label, name and any properties); of several with one key the
    last row stays, all of it. Rows that their order doesn't tell apart are taken by their values."""
    both, _ = _in_order(tables)
    rest = ["name", *(c for c in both.columns if c not in ("key", "label", "name", "_at"))]
    return both.groupBy("key", "label").agg(F.max(F.struct("_at", *rest)).alias("x")).select("key", "label", *(f"x.{c}" for c in rest))


def edges(node_table: DataFrame, *tables: DataFrame) -> DataFrame:
    """One edge for each (source, type, target) of which both ends are nodes; each property has
    the value of the last row whose table has it."""
    both, have = _in_order(tables)
    ends, rest = ["source", "type", "target"], [c for c in both.columns if c not in ("source", "type", "target", "_at")]

    def last(c: str) -> Column:
        said = F.col("_at.table").isin(*(i for i, columns in enumerate(have) if c in columns))
        return F.max(F.when(said, F.struct("_at", c)))[c].alias(c)

    both = both.groupBy(*ends).agg(*map(last, rest)) if rest else both.select(*ends).distinct()
    known = node_table.select("key")
    both = both.join(known.withColumnRenamed("key", "source"), "source", "left_semi")
    return both.join(known.withColumnRenamed("key", "target"), "target", "left_semi").select(*ends, *rest)


def neighbourhood(edge_table: DataFrame, seeds: DataFrame, hops: int = 2, through: Column | None = None) -> DataFrame:
    """(seed, key) of all nodes within ``hops`` edges in either direction, seeds included.
    ``through`` limits which nodes a path may go on from, to keep hubs from joining all."""
    both = _links(edge_table)
    reached = seeds.select(F.col("key").alias("seed"), "key").distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        if through is not None:
            frontier = frontier.where(through)
        frontier, parts = _step(frontier, both)
        reached = _dealt(reached.union(frontier), parts)
        if hop < hops:
            reached, frontier = materialize(reached, "reached"), materialize(_dealt(frontier, parts), "frontier")
    return reached


#: Links of a node that a task joins at once, and pairs that a task tells apart.
LINKS_AT_ONCE, PAIRS_AT_ONCE = 1 << 12, 1 << 21


def _links(edge_table: DataFrame) -> DataFrame:
    """(key, next) of all edges, in both directions."""
    return materialize(edge_table.select(F.col("source").alias("key"), F.col("target").alias("next")).union(edge_table.select("target", "source")).distinct(), "links")


def _dealt(pairs: DataFrame, parts: int) -> DataFrame:
    """The different (seed, key), told apart after they are dealt, so that a task holds its share only."""
    return pairs.repartition(parts, "seed", "key").distinct()


def _step(frontier: DataFrame, both: DataFrame) -> tuple[DataFrame, int]:
    """(seed, key) one link on, repeats included, and into how many parts these are to be dealt. The links of
    a hub are in blocks, so that it is many tasks."""
    degrees = both.groupBy("key").agg(F.count("*").alias("degree"))
    made = frontier.groupBy("key").agg(F.count("*").alias("n")).join(degrees, "key").agg(F.sum(F.col("n") * F.col("degree"))).first()[0]
    parts = max(frontier.sparkSession.sparkContext.defaultParallelism, (made or 0) // PAIRS_AT_ONCE + 1)
    hubs = degrees.where(F.col("degree") > LINKS_AT_ONCE).select("key", F.ceil(F.col("degree") / LINKS_AT_ONCE).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    split = both.join(hubs, "key", "left").select("key", F.pmod(F.xxhash64("next"), blocks).cast("int").alias("block"), "next")
    asked = frontier.join(hubs, "key", "left").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "seed")
    joined = asked.repartition(parts, "key", "block").join(split.repartition(parts, "key", "block"), ["key", "block"])
    return joined.select("seed", F.col("next").alias("key")), parts


def seed_context(seeds: DataFrame, node_table: DataFrame, edge_table: DataFrame, most_nodes: int = 20, most_edges: int = 30) -> DataFrame:
    """context_lines() of the neighbourhood of two edges around each seed (key), which isn't made for that.

    What is first in a neighbourhood is among the first next to one of its nodes within one edge; so of each
    node only its first neighbours and edges are joined. An edge whose ends both are two edges away is at no
    such node: then either end has several neighbours, and only those nodes are looked for."""
    rank = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    both = _links(edge_table)
    own = seeds.select(F.col("key").alias("seed"), "key").distinct()
    beside, parts = _step(own, both)
    near = materialize(_dealt(own.union(beside), parts), "near")
    labels = node_table.select("key", "label")
    listed = both.join(labels.withColumnRenamed("key", "next"), "next").withColumn("line", rank("key", "label", "next")).where(F.col("line") <= most_nodes)
    top = near.join(listed, "key").select("seed", F.col("next").alias("key"), "label").union(near.join(labels, "key").select("seed", "key", "label")).distinct()
    top = top.withColumn("line", rank("seed", "label", "key")).where(F.col("line") <= most_nodes)
    properties = F.col("properties") if "properties" in node_table.columns else F.to_json(F.struct("name"))
    top = top.join(node_table, ["key", "label"]).select("seed", "line", F.concat(F.lit("node "), "label", F.lit(": "), properties).alias("text"))
    ends = ["type", "source", "target"]
    edges_of = edge_table.select(*ends).distinct()
    at = edges_of.select(F.col("source").alias("key"), *ends).union(edges_of.where("source <> target").select("target", *ends))
    at = at.withColumn("line", rank("key", *ends)).where(F.col("line") <= most_edges)
    core = both.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    inner = edges_of
    for end in ("source", "target"):
        inner = inner.join(core.withColumnRenamed("key", end), end, "left_semi")
    inner = materialize(inner, "inner-edges")
    far = materialize(both.join(inner.select(F.col("source").alias("next")).union(inner.select("target")).distinct(), "next", "left_semi"), "inner-links")
    further, parts = _step(near, far)
    inside = materialize(_dealt(near.union(further), parts), "inside")
    found = inner.join(inside.withColumnRenamed("key", "source"), "source").join(inside.select("seed", F.col("key").alias("target")), ["seed", "target"])
    links = near.join(at, "key").select("seed", *ends).union(found.select("seed", *ends)).distinct()
    links = links.withColumn("line", rank("seed", *ends)).where(F.col("line") <= most_edges)
    text = F.concat(F.lit("relationship "), "type", F.lit(": "), "source", F.lit(" -> "), "target")
    return top.union(links.select("seed", (F.col("line") + most_nodes).alias("line"), text.alias("text")))


def ancestry(parents: DataFrame) -> DataFrame:
    """(id, path): names from the root to each row of (id, name, parent_id), by doubling the
    reach of parent links until none is open, however deep; a row whose links form a circle
    stops at the first repeat."""
    rows = parents.select("id", F.col("parent_id").alias("up"), F.array("name").alias("path"), F.array("id").alias("seen"))
    while True:
        other = rows.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("seen").alias("seen2"))
        joined = rows.join(other, "up", "left")
        new = F.col("seen2").isNotNull() & ~F.coalesce(F.arrays_overlap("seen", "seen2"), F.lit(False))
        rows = joined.select("id", F.when(new, F.col("up2")).alias("up"), F.when(new, F.concat("path2", "path")).otherwise(F.col("path")).alias("path"), F.when(new, F.concat("seen2", "seen")).otherwise(F.col("seen")).alias("seen"))
        rows = materialize(rows, "ancestry")
        if not rows.where("up is not null").head(1):
            return rows.select("id", "path")


def without_scope(node_table: DataFrame, edge_table: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a project's nodes and the edges at them."""
    of = lambda c: F.substring_index(F.col(c), ":", 1) == project
    return node_table.where(~of("key")), edge_table.where(~of("source") & ~of("target"))


def ordered_nodes(node_table: DataFrame) -> DataFrame:
    return node_table.orderBy("label", "key")


def ordered_edges(edge_table: DataFrame) -> DataFrame:
    return edge_table.orderBy("type", "source", "target")


def context_lines(near: DataFrame, node_table: DataFrame, edge_table: DataFrame, most_nodes: int = 20, most_edges: int = 30) -> DataFrame:
    """(seed, line, text): the first nodes and edges of each neighbourhood (seed, key), in the
    order of graph results. ``node_table`` may have a ``properties`` column."""
    nodes_of = near.join(node_table, "key")
    rank = lambda *by: F.row_number().over(Window.partitionBy("seed").orderBy(*by))
    properties = F.col("properties") if "properties" in node_table.columns else F.to_json(F.struct("name"))
    top = nodes_of.withColumn("line", rank("label", "key")).where(F.col("line") <= most_nodes)
    top = top.select("seed", "line", F.concat(F.lit("node "), "label", F.lit(": "), properties).alias("text"))
    inside = edge_table.join(near.withColumnRenamed("key", "source"), "source").join(near.select("seed", F.col("key").alias("target")), ["seed", "target"])
    links = inside.select("seed", "type", "source", "target").distinct().withColumn("line", rank("type", "source", "target")).where(F.col("line") <= most_edges)
    text = F.concat(F.lit("relationship "), "type", F.lit(": "), "source", F.lit(" -> "), "target")
    return top.union(links.select("seed", (F.col("line") + most_nodes).alias("line"), text.alias("text")))


def scene_entities(scenes: DataFrame, appears_in: DataFrame, happens_at: DataFrame, located_in: DataFrame) -> DataFrame:
    """(scene, character_ids, location_ids, object_ids): distinct ids along optional links.

    ``scenes`` (scene), ``appears_in`` (character, scene), ``happens_at`` (scene, location),
    ``located_in`` (object, location). Each list is made by itself, so the chain's rows don't
    multiply; a list is as long as one scene has entities. Scenes with the same locations have the
    same objects: their list is made once, and joined last."""
    ids = lambda rows, by, c: rows.groupBy(by).agg(F.array_sort(F.collect_set(c)).alias(f"{c}_ids"))
    places = materialize(ids(scenes.join(happens_at, "scene"), "scene", "location"), "places")
    at = places.select("location_ids").distinct().withColumn("location", F.explode("location_ids"))
    objects = materialize(ids(at.join(located_in.select("location", "object").distinct(), "location"), "location_ids", "object"), "objects")
    out = scenes.select("scene").distinct().join(ids(scenes.join(appears_in, "scene"), "scene", "character"), "scene", "left")
    out = out.join(places, "scene", "left").join(objects, "location_ids", "left")
    return out.select("scene", *(F.coalesce(f"{c}_ids", F.array()).alias(f"{c}_ids") for c in ("character", "location", "object")))
