"""From extracted facts to canonical characters and locations.

Facts have (scope, id, type, entity_name, candidate_names, chapter_index,
confidence, timeline_hint) and, as far as the family has them, summary,
parent_name, era and the other location values. All operators work on every scope
at once; ties that the order of facts leaves open are settled by name or id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fabula.functions import text as T
from fabula.operators.components import components
from fabula.operators.scan import Resets, segmented_scan
from fabula.plans.storage import materialize

#: The kinds of facts of each family.
CHARACTER_TYPES = (
    "CHARACTER_MENTION",
    "CHARACTER_ALIAS",
    "CHARACTER_APPEARANCE",
    "CHARACTER_AGE",
    "CHARACTER_PERSONALITY",
    "CHARACTER_SPEECH_MANNER",
    "CHARACTER_RELATIONSHIP",
    "CHARACTER_PLOT_CHANGE",
    "CHARACTER_CANDIDATE",
)
LOCATION_TYPES = (
    "LOCATION_MENTION",
    "LOCATION_ALIAS",
    "LOCATION_HIERARCHY",
    "LOCATION_ATMOSPHERE",
    "LOCATION_ARCHITECTURE",
    "LOCATION_ERA",
    "LOCATION_SOCIAL_CONTEXT",
    "LOCATION_LIGHTING",
    "LOCATION_COLOR",
    "LOCATION_RECURRING_OBJECT",
    "LOCATION_CHANGE",
    "LOCATION_CANDIDATE",
)
TIMELINE_TYPES = ("TIMELINE_EVENT", "TIMELINE_MARKER", "TIMELINE_CHARACTER_PERIOD", "TIMELINE_CANDIDATE")
FAMILIES = {"character": CHARACTER_TYPES, "location": LOCATION_TYPES, "timeline": TIMELINE_TYPES}
#: Words that tell clothing, what stands for missing texts, and which values of
#: locations may conflict.
CLOTHING = ("clothing", "clothes", "dress", "wears", "одеж")
NO_APPEARANCE = "No reliable appearance facts extracted yet."
NO_DESCRIPTION = "No reliable location description extracted yet."
LOCATION_VALUES = ("architecture", "era", "lighting", "atmosphere")
_SEP = "\x1f"


def family(kind: Column) -> Column:
    """The family whose merge reads facts of a kind, or null."""
    out = F.lit(None).cast("string")
    for name, kinds in FAMILIES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def entity_groups(facts: DataFrame, normalize=T.normalize_name) -> DataFrame:
    """Facts with ``root``: the component of their entity's normalized name, names that
    one fact mentions together being connected."""
    key = lambda c: F.concat_ws(_SEP, F.col("scope").cast("string"), normalize(c))
    # every different pair of names once: facts repeat them, and names are normalized in Python
    pairs = facts.select("scope", "entity_name", F.explode_outer("candidate_names").alias("name")).distinct()
    keyed = pairs.select("scope", "entity_name", "name", key(F.col("entity_name")).alias("a"))
    keyed = keyed.withColumn("_scope", F.col("scope")).withColumn("scope", F.split("a", _SEP)[0])
    other = F.coalesce(F.when(T.trim_ws(F.col("name")) != "", key(F.col("name"))), "a")
    keyed = materialize(keyed.select(F.col("_scope"), F.col("entity_name").alias("_name"), "a", other.alias("b")), "names")
    roots = components(keyed.select("a", "b")).withColumnRenamed("node", "a")
    # written, so that Spark knows its size: facts stay where they are if it is small
    rooted = materialize(keyed.select("_scope", "_name", "a").distinct().join(roots, "a").drop("a"), "rooted")
    same = F.col("scope").eqNullSafe(F.col("_scope")) & F.col("entity_name").eqNullSafe(F.col("_name"))
    return facts.join(rooted, same).drop("_scope", "_name")


def entity_names(groups: DataFrame) -> DataFrame:
    """(scope, root, name, n): raw names of each group, and how many facts are about each;
    names that only occur as candidates have 0."""
    own = groups.select("scope", "root", F.col("entity_name").alias("name"), F.lit(1).alias("n"))
    others = groups.select("scope", "root", F.explode("candidate_names").alias("name"), F.lit(0).alias("n")).where(T.trim_ws(F.col("name")) != "")
    return own.union(others).groupBy("scope", "root", "name").agg(F.sum("n").alias("n"))


def canonical_names(groups: DataFrame, people: bool = True, normalize=T.normalize_name) -> DataFrame:
    """(scope, root, canonical_name, aliases): most facts first, for people then no
    honorific, more words, and always the shorter and then the first name."""
    name = F.col("name")
    order = [F.desc("n")]
    if people:
        order += [T.has_honorific(name).cast("int"), F.desc(F.size(F.split(name, r"\s+")))]
    first = Window.partitionBy("scope", "root").orderBy(*order, F.length("name"), "name")
    names = entity_names(groups).withColumn("_rank", F.row_number().over(first))
    chosen = F.max(F.when(F.col("_rank") == 1, name)).over(Window.partitionBy("scope", "root"))
    names = names.withColumn("canonical_name", chosen).withColumn("_norm", normalize(name))
    other = F.when(F.col("_norm") != normalize(F.col("canonical_name")), F.struct("_norm", "name"))
    aliases = F.transform(F.array_sort(F.collect_list(other)), lambda x: x["name"])
    return names.groupBy("scope", "root", "canonical_name").agg(aliases.alias("aliases"))


def _said(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _character_reads(row: tuple) -> tuple[bool, dict[str, str], dict[str, str]]:
    kind, hint, summary, confidence = row
    sets = {"hint": hint} if hint else {}
    compared = dict(sets)
    value = _said(summary)
    if value and kind in ("CHARACTER_AGE", "CHARACTER_APPEARANCE", "CHARACTER_PERSONALITY"):
        sets[kind] = value
        if kind == "CHARACTER_AGE" or (confidence or 0) >= 0.5:
            compared[kind] = value
    return kind == "CHARACTER_PLOT_CHANGE", compared, sets


def _location_reads(row: tuple) -> tuple[bool, dict[str, str], dict[str, str]]:
    kind, hint, era = row
    sets = {k: v for k, v in (("hint", hint), ("era", _said(era))) if v}
    return kind == "LOCATION_CHANGE", sets, sets


def version_segments(groups: DataFrame, family: str = "character", ranges: int | None = None) -> DataFrame:
    """Facts with ``version``, from 1: a new one begins at a change, at another timeline
    hint than the segment's last, and for characters at another age than the segment's
    last or a sure other appearance or personality, for locations at another era.
    What a segment has not said yet never begins a new one. An entity with very many facts
    is many tasks."""
    reads = ["type", "timeline_hint", "summary", "confidence"] if family == "character" else ["type", "timeline_hint", "era"]
    machine = Resets(_character_reads if family == "character" else _location_reads)
    return segmented_scan(groups, "root", ["chapter_index", "id"], reads, machine, "version", LongType(), ranges)


def ordered_distinct(value: Column) -> Column:
    """Distinct non-empty trimmed strings in the order of facts."""
    v = T.trim_ws(value)
    items = F.array_sort(F.collect_list(F.when(v != "", F.struct("chapter_index", "id", v.alias("v")))))
    return F.array_distinct(F.transform(items, lambda x: x["v"]))


def latest(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull() & (value != ""), F.struct("chapter_index", "id")))


def _average(digits: int) -> Column:
    return F.round(F.avg("confidence"), digits)


def character_versions(segmented: DataFrame, digits: int = 4) -> DataFrame:
    """One row per version with its age, appearance, personality, clothing and range."""
    of = lambda kind: F.when(F.col("type") == kind, F.col("summary"))
    looks = of("CHARACTER_APPEARANCE")
    rows = segmented.groupBy("scope", "root", "version").agg(
        latest(of("CHARACTER_AGE")).alias("age"),
        ordered_distinct(looks).alias("_looks"),
        ordered_distinct(of("CHARACTER_PERSONALITY")).alias("_traits"),
        latest(of("CHARACTER_SPEECH_MANNER")).alias("speech_manner"),
        F.min("chapter_index").alias("start_chapter"),
        F.max("chapter_index").alias("end_chapter"),
        ordered_distinct(F.col("timeline_hint")).alias("hints"),
        _average(digits).alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "id"))), lambda x: x["id"]).alias("source_fact_ids"),
    )
    dressed = F.filter("_looks", lambda s: F.exists(F.array(*map(F.lit, CLOTHING)), lambda k: F.lower(s).contains(k)))
    joined = lambda c: F.array_join(c, " ")
    return rows.select(
        "scope",
        "root",
        "version",
        "age",
        F.when(F.size("_looks") > 0, joined(F.col("_looks"))).otherwise(NO_APPEARANCE).alias("appearance"),
        F.when(F.size("_traits") > 0, joined(F.col("_traits"))).alias("personality"),
        "speech_manner",
        F.when(F.size(dressed) > 0, joined(dressed)).alias("clothing"),
        "start_chapter",
        "end_chapter",
        "hints",
        "confidence",
        "source_fact_ids",
    )


def location_versions(segmented: DataFrame, digits: int = 4) -> DataFrame:
    """One row per version with its description and latest known values."""
    values = ("atmosphere", "architecture", "era", "social_context", "lighting")
    have = [c for c in values if c in segmented.columns]
    rows = segmented.groupBy("scope", "root", "version").agg(
        ordered_distinct(F.col("summary")).alias("_said"),
        *(latest(F.col(c)).alias(c) for c in have),
        _average(digits).alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "id"))), lambda x: x["id"]).alias("source_fact_ids"),
    )
    said = F.when(F.size("_said") > 0, F.array_join("_said", " ")).otherwise(NO_DESCRIPTION)
    return rows.select("scope", "root", "version", said.alias("description"), *have, "confidence", "source_fact_ids")


def attribute_conflicts(groups: DataFrame, types: tuple[str, ...] = ("CHARACTER_AGE", "CHARACTER_APPEARANCE", "CHARACTER_PERSONALITY"), value: str = "summary") -> DataFrame:
    """Types of which a group has several different values, with all of them."""
    v = F.col(value)
    said = groups.where(F.col("type").isin(*types) & v.isNotNull() & (v != ""))
    items = F.array_sort(F.collect_list(F.struct("chapter_index", F.col("id").alias("fact_id"), v.alias("value"), "confidence")))
    said = said.withColumn("_v", T.normalize_text(v))
    found = said.groupBy("scope", "root", "type").agg(F.count_distinct("_v").alias("n_values"), items.alias("facts"))
    return found.where("n_values > 1")


def location_conflicts(groups: DataFrame) -> DataFrame:
    """(scope, root, attribute, n_values, facts): values of which the facts of a location
    state several different ones."""
    value = lambda c: F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value"))
    said = groups.select("scope", "root", "id", "chapter_index", "confidence", F.inline(F.array(*(value(c) for c in LOCATION_VALUES if c in groups.columns)))).where("value <> ''")
    items = F.array_sort(F.collect_list(F.struct("chapter_index", F.col("id").alias("fact_id"), "value", "confidence")))
    said = said.withColumn("_v", T.normalize_text(F.col("value")))
    found = said.groupBy("scope", "root", "attribute").agg(F.count_distinct("_v").alias("n_values"), items.alias("facts"))
    return found.where("n_values > 1")


def conflicts(*found: tuple[str, DataFrame, str]) -> DataFrame:
    """(scope, kind, subject, detail) of all kinds of conflicts: each given as its kind, the
    table, and an expression for what is in conflict; the subject is ``root``, or the first
    of a pair."""
    rows = []
    for kind, table, detail in found:
        subject = F.col("root") if "root" in table.columns else F.col("left_root")
        rows.append(table.select("scope", F.lit(kind).alias("kind"), subject.alias("subject"), F.expr(detail).cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, rows)


def duplicate_classes(names: DataFrame) -> DataFrame:
    """(scope, key, root, n_roots): groups that share a name or last word, one row for each
    member instead of a row for each pair."""
    keys = _match_keys(names, False)
    sizes = keys.groupBy("scope", "key", (F.xxhash64("key") % 2).alias("half")).agg(F.count("*").alias("n_roots")).where("n_roots > 1").drop("half")
    return keys.join(sizes, ["scope", "key"])


def location_parents(groups: DataFrame) -> DataFrame:
    """(scope, root, parent_name, n_parents): the most frequent parent, the first seen on a
    tie, and how many different ones there are; several are a conflict."""
    named = groups.where(T.trim_ws(F.col("parent_name")) != "")
    seen = named.groupBy("scope", "root", "parent_name").agg(F.count("*").alias("n"), F.min(F.struct("chapter_index", "id")).alias("seen"))
    best = Window.partitionBy("scope", "root").orderBy(F.desc("n"), "seen")
    seen = seen.withColumn("_parent", T.normalize_text(F.col("parent_name")))
    kinds = F.size(F.collect_set("_parent").over(Window.partitionBy("scope", "root")))
    return seen.withColumn("_rank", F.row_number().over(best)).withColumn("n_parents", kinds).where("_rank = 1").select("scope", "root", "parent_name", "n_parents")


def _match_keys(names: DataFrame, loose: bool) -> DataFrame:
    name = F.col("name")
    if loose:
        key = F.array(F.when(F.length(T.loose_location_key(name)) > 2, T.loose_location_key(name)))
    else:
        norm = T.normalize_name(name)
        last = T.last_word(norm)
        key = F.array(F.concat(F.lit("="), norm), F.when(F.length(last) > 2, F.concat(F.lit("~"), last)))
    return names.select("scope", "root", F.explode(key).alias("key")).where("key is not null").distinct()


def possible_duplicates(names: DataFrame, loose: bool = False) -> DataFrame:
    """Pairs (scope, left_root, right_root) of different groups: with an equal name or last
    word of more than two letters; ``loose``: with an equal key without article and place
    nouns. ``names`` has (scope, root, name). An equi-join of match keys; where very many
    groups share a key, duplicate_classes() says the same without pairs."""
    keys = _match_keys(names, loose)
    right = keys.select("scope", "key", F.col("root").alias("right_root"))
    pairs = keys.withColumnRenamed("root", "left_root").join(right, ["scope", "key"]).where("left_root < right_root")
    return pairs.select("scope", "left_root", "right_root").distinct()


def patch(rows: DataFrame, patches: DataFrame, key: str, clear: str | None = None) -> DataFrame:
    """Rows with the values that a patch row of the same key has; nulls leave them. ``clear``
    is a column of ``patches`` with the names of those that become null."""
    changed = [c for c in patches.columns if c not in (key, clear)]
    p = patches.select(key, *(F.col(c).alias(f"_new_{c}") for c in changed), *([F.col(clear).alias("_clear")] if clear else []))

    def value(c: str) -> Column:
        out = F.coalesce(f"_new_{c}", c)
        return F.when(F.coalesce(F.array_contains("_clear", c), F.lit(False)), F.lit(None)).otherwise(out) if clear else out

    return rows.join(p, key, "left").select(*(value(c).alias(c) if c in changed else F.col(c) for c in rows.columns))


def last_versions(versions: DataFrame, *keys: str, order: str = "version") -> DataFrame:
    """The last version of each key."""
    rest = [c for c in versions.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("_last")
    return versions.groupBy(*keys).agg(row).select(*keys, "_last.*").select(*versions.columns)


def patch_last_version(versions: DataFrame, patches: DataFrame, key: str, clear: str | None = None) -> DataFrame:
    """Versions of which only each key's last one takes the values of its patch."""
    last = versions.groupBy(key).agg(F.max("version").alias("_last"))
    marked = versions.join(last, key)
    old = marked.where("version <> _last").select(*versions.columns)
    return old.unionByName(patch(marked.where("version = _last").select(*versions.columns), patches, key, clear))


def typed_values(json: Column, strings: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """A struct of the named values of JSON objects: strings that are strings, and the strings
    of lists; what has another type is as if it weren't there. No object: all null or empty."""
    v = F.try_parse_json(json)
    is_string = lambda x: F.schema_of_variant(x) == "STRING"
    one = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    texts = [F.when(is_string(one(k)), F.try_variant_get(v, f"$.{k}", "string")).alias(k) for k in strings]
    many = [F.coalesce(F.transform(F.filter(F.try_variant_get(v, f"$.{k}", "array<variant>"), is_string), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")).alias(k) for k in lists]
    return F.struct(*texts, *many)


def safe_json(json: Column, keep_nulls: bool = False) -> Column:
    """JSON objects without their null members, unless these are kept; null for anything else."""
    members = F.from_json(json, "map<string,variant>")
    kept = members if keep_nulls else F.map_filter(members, lambda _, x: ~F.coalesce(F.is_variant_null(x), F.lit(True)))
    return F.when(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.to_json(kept))


def merge_characters(facts: DataFrame, digits: int = 4) -> dict[str, DataFrame]:
    """All tables of a character merge; unlike an approach that replaces a scope at large,
    conflicts of locations are never touched."""
    groups = materialize(entity_groups(facts.where(F.col("type").isin(*CHARACTER_TYPES))), "groups")
    names = canonical_names(groups)
    listed = names.select("scope", "root", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    return {
        "characters": names,
        "versions": character_versions(version_segments(groups), digits),
        "attribute_conflicts": attribute_conflicts(groups),
        "possible_duplicates": possible_duplicates(listed),
    }


def merge_locations(facts: DataFrame) -> dict[str, DataFrame]:
    """All tables of a location merge, the parents resolved to groups of the same scope."""
    groups = materialize(entity_groups(facts.where(F.col("type").isin(*LOCATION_TYPES)), T.normalize_text), "groups")
    names = canonical_names(groups, people=False, normalize=T.normalize_text)
    listed = names.select("scope", "root", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    parents = location_parents(groups)
    known = listed.select("scope", F.col("root").alias("parent_root"), T.normalize_text(F.col("name")).alias("_n")).distinct()
    placed = parents.withColumn("_n", T.normalize_text(F.col("parent_name"))).join(known, ["scope", "_n"]).where("root <> parent_root")
    return {
        "locations": names.join(placed.select("scope", "root", "parent_root"), ["scope", "root"], "left"),
        "versions": location_versions(version_segments(groups, "location")),
        "attribute_conflicts": location_conflicts(groups),
        "parent_conflicts": parents.where("n_parents > 1"),
        "possible_duplicates": possible_duplicates(listed, loose=True),
    }
