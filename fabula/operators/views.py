"""Project views: rows that belong together, in the order in which they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T


def include(parents: DataFrame, children: DataFrame, key: str, *order: Column) -> DataFrame:
    """Each parent with its children, one row each, numbered from 0 in this order; a parent
    without children has one row with nulls. Rows instead of a list, as a parent may have any
    number of children."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return parents.join(children.withColumn("position", n), key, "left")


def world_scope(analyses: DataFrame, series: DataFrame, projects: DataFrame) -> DataFrame:
    """Analyses with ``world_id``: the world of their series, else of their project, else
    their own. ``series`` has (series_id, world_id), ``projects`` (project_id, world_id)."""
    s = series.select("series_id", F.col("world_id").alias("_series"))
    p = projects.select("project_id", F.col("world_id").alias("_project"))
    own = analyses.withColumnRenamed("world_id", "_own")
    out = own.join(s, "series_id", "left").join(p, "project_id", "left")
    return out.withColumn("world_id", F.coalesce("_series", "_project", "_own")).drop("_series", "_project", "_own")


def having_content(analyses: DataFrame, books: DataFrame, hashes: DataFrame) -> DataFrame:
    """Analyses of books whose content hash is among ``hashes`` (content_hash)."""
    wanted = books.join(hashes, "content_hash", "left_semi").select("book_id")
    return analyses.join(wanted, "book_id", "left_semi")


def with_composite_keys(assets: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Approved references for any of the keys."""
    return assets.where("type = 'REFERENCE' and status = 'APPROVED'").join(keys.select(*columns), list(columns), "left_semi")


def listed_in(rows: DataFrame, lists: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """Rows whose id is in any of the lists."""
    return rows.join(lists.select(F.explode(list_col).alias(id_col)), id_col, "left_semi")


def checked(rows: DataFrame, **rules: Column) -> DataFrame:
    """Rows with ``errors``, the names of the rules that they break; a rule that can't be told,
    as of a missing value, is not broken. Rows without errors may pass, the others are the
    table of rejects."""
    broken = F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items()))
    return rows.withColumn("errors", F.filter(broken, lambda x: x.isNotNull()))


def by_name(rows: DataFrame, name: str = "name", *ties: str) -> DataFrame:
    """In the order of a reader: letters before their case and accents."""
    norm = T.normalize_text(F.col(name))
    return rows.orderBy(F.collate(norm, "UNICODE"), name, *ties)


def characters_view(characters: DataFrame, versions: DataFrame) -> DataFrame:
    """(scope, root, canonical_name, aliases, version ...): characters by name with their
    versions in order."""
    joined = characters.join(versions, ["scope", "root"], "left")
    return joined.withColumn("aliases", F.array_sort("aliases")).orderBy("scope", "canonical_name", "root", "version")


def locations_view(locations: DataFrame, name: str = "canonical_name", parent: str = "parent_root") -> DataFrame:
    """Locations by parent, those without one last, and name."""
    return locations.orderBy(F.col(parent).asc_nulls_last(), name)


def styles_view(styles: DataFrame) -> DataFrame:
    """The default first, then by name."""
    return styles.orderBy(F.desc("is_default"), "name")


def assets_view(assets: DataFrame, created: str = "created_at", key: str = "asset_id") -> DataFrame:
    return assets.orderBy(created, key)


def first_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Union of several sources without repeats: of rows with the same key the first."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")
