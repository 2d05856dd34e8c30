"""Queries over the merged tables of projects, made from the facts of ``queries``."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import prompts
from fabula.operators import entities, points, scenes, timeline
from fabula.operators import project_graph as graph
from fabula.operators.graph import RELATIONS, ancestry
from fabula.operators.vector_index import VectorIndex
from fabula.plans.queries import _ROOTS, _SEGMENTS, FACTS, facts, query, read
from fabula.plans.storage import materialize, shared_dir


def _told(properties: str = "properties") -> Column:
    """A map as one text, its names in order."""
    entries = F.array_sort(F.map_entries(properties))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# ------------------------------------------------------------------ versions of a hot entity

_HOT = f"""{FACTS}, grouped AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'hot' ELSE entity_name END AS root FROM facts)"""


@query(
    f"""WITH {_HOT}, o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY chapter_index, id) AS i, lag(era) OVER (PARTITION BY root, era IS NOT NULL ORDER BY chapter_index, id) AS era_before FROM grouped)
    SELECT id, root, CAST(1 + count(*) FILTER (era_before IS NOT NULL AND era <> era_before) OVER (PARTITION BY root ORDER BY i) AS BIGINT) AS version FROM o"""
)
def version_segments_hot(spark, sf_dir):
    """Half of all facts are one location's: a version is a run of facts of one era."""
    f = facts(spark, sf_dir).withColumn("root", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("entity_name")))
    f = f.withColumn("timeline_hint", F.lit(None).cast("string"))
    return entities.version_segments(f, "location").select("id", "root", "version")


@query(
    f"""WITH RECURSIVE {FACTS}, o AS (SELECT *, entity_name AS root, row_number() OVER (PARTITION BY entity_name ORDER BY chapter_index, id) AS i FROM facts),
    steps AS (SELECT root, i, id, 1::BIGINT AS version, timeline_hint AS hint, era FROM o WHERE i = 1
        UNION ALL SELECT root, i, id, CASE WHEN fresh THEN version + 1 ELSE version END, CASE WHEN fresh THEN own_hint ELSE coalesce(own_hint, hint) END, CASE WHEN fresh THEN own_era ELSE coalesce(own_era, era) END
        FROM (SELECT o.root, o.i, o.id, s.version, s.hint, s.era, o.timeline_hint AS own_hint, o.era AS own_era, coalesce(o.type = 'CHARACTER_PLOT_CHANGE' OR o.timeline_hint <> s.hint OR o.era <> s.era, FALSE) AS fresh FROM steps s JOIN o ON o.root = s.root AND o.i = s.i + 1))
    SELECT id, root, version FROM steps"""
)
def location_change_versions(spark, sf_dir):
    """Versions of locations, of whose facts a tenth and more are changes."""
    kind = F.when(F.col("type") == "CHARACTER_PLOT_CHANGE", "LOCATION_CHANGE").otherwise("LOCATION_MENTION")
    f = facts(spark, sf_dir).withColumn("root", F.col("entity_name")).withColumn("type", kind)
    return entities.version_segments(f, "location").select("id", "root", "version")


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
    up AS (SELECT id, id AS at, name AS path, parent, 1 AS n FROM c UNION ALL SELECT up.id, c.id, c.name || ' > ' || path, c.parent, n + 1 FROM up JOIN c ON c.id = up.parent)
    SELECT id, arg_max(path, n) AS path FROM up GROUP BY id"""
)
def hierarchy_deep(spark, sf_dir):
    """Every customer lies in the one of half its key: as many levels as the key has bits."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k > 1, F.floor(k / 2)).alias("parent_id"))
    return ancestry(rows).select("id", F.array_join("path", " > ").alias("path"))


@query(
    """WITH c AS (SELECT event_id // 3 AS asset_id, CASE WHEN event_id % 2 = 0 THEN 'character' ELSE 'style' END AS type, event_type NOT IN ('error', 'signup') AS passed, least(1.0, greatest(0.0, value / 50)) AS s FROM events),
    a AS (SELECT asset_id, floor(avg(s) * 100 + 0.5) / 100 AS score, bool_and(passed) AS all_passed, bool_or(type = 'character' AND NOT passed) AS failed FROM c GROUP BY asset_id)
    SELECT asset_id, score, all_passed, CASE WHEN score >= 0.82 AND all_passed THEN 'approve' WHEN score < 0.45 THEN 'regenerate' WHEN failed THEN 'inpaint' ELSE 'manual_review' END AS recommendation FROM a"""
)
def validation_advice(spark, sf_dir):
    """Three checks of an asset, so that each advice is given; characters fail as well."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    checks = e.select(F.floor(k / 3).alias("asset_id"), F.when(k % 2 == 0, "character").otherwise("style").alias("type"), (~F.col("event_type").isin("error", "signup")).alias("passed"), (F.col("value") / 50).alias("score"))
    return scenes.validate(checks).select("asset_id", "score", "all_passed", "recommendation")


# ------------------------------------------------------------------ graph of a project

_KINDS = list(RELATIONS)


def world_tables(spark, sf_dir, wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Each scope is a project: its people and their versions, places that are named twice,
    one event for each kind of fact and day, scenes, and relationships of all kinds. Only the
    ``wanted`` tables are made, or all."""
    name = lambda c: F.element_at(F.split(c, "\x1f"), -1)
    groups = materialize(entities.entity_groups(facts(spark, sf_dir)), "groups").withColumn("project", F.col("scope"))
    names = materialize(entities.canonical_names(groups).withColumn("id", name("root")), "names")
    segmented = entities.version_segments(groups.select("scope", "root", "id", "chapter_index", "type", "timeline_hint", "summary", "confidence"))
    versions = entities.character_versions(segmented)
    version_id = F.concat(name("root"), F.lit("#"), F.col("version").cast("string"))
    title = F.concat("type", F.lit(" "), (F.col("k") % 5).cast("string"))
    titled = timeline.planned_events(groups.select("scope", "id", "chapter_index", "created_at", "confidence", "summary", "entity_name", "parent_name", title.alias("title")))
    titled = titled.withColumn("absolute_date", F.lit(None).cast("date")).withColumn("description", F.col("summary"))
    titled = titled.withColumn("character_names", F.array("entity_name")).withColumn("location_names", F.array("parent_name"))
    merged = timeline.merge_events(titled).withColumn("id", F.concat(F.lit("e"), F.element_at("source_fact_ids", 1).cast("string")))
    # written with what is read of it: it is named, and joined with the names found
    merged = materialize(merged.select("scope", "id", "title", "chapter_index", "relative_order", "character_names", "location_names", "source_fact_ids"), "merged")
    called = names.select("scope", F.col("id").alias("entity_id"), F.lit(0).alias("rank"), F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    found = timeline.resolve_names(merged, timeline.name_index(called), "character_names")
    people = found.groupBy("scope", "id").agg(F.array_sort(F.collect_list("entity_id")).alias("involved_character_ids"))
    events = materialize(merged.join(people, ["scope", "id"]), "events")
    of_event = events.select(F.col("id").alias("event_id"), F.explode("source_fact_ids").alias("fact"))
    places = groups.select("project", F.col("parent_name").alias("id")).distinct()
    places = places.withColumn("parent_id", F.when(F.col("id") != "loc0", "loc0")).withColumn("position", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("name", F.when(F.col("position") == 1, F.concat(F.lit("old "), "id")).otherwise(F.col("id")))
    other = groups.select((F.col("id") - 1).alias("id"), F.col("scope").alias("other_scope"), name("root").alias("target_character_id"))
    kinds = F.array(*map(F.lit, _KINDS))
    relations = groups.join(other, "id").where(F.col("scope") == F.col("other_scope"))
    made = {
        "projects": groups.select("project", F.col("project").alias("id"), F.concat(F.lit("project "), "project").alias("name")).distinct(),
        "character_versions": versions.select(F.col("scope").alias("project"), version_id.alias("id"), name("root").alias("character_id"), "version", "age", "appearance"),
        "locations": places,
        "event_versions": segmented.select(F.col("scope").alias("project"), F.col("id").alias("fact"), version_id.alias("character_version_id")).join(of_event, "fact").drop("fact"),
        "scenes": groups.where("id % 50 = 0").select("project", F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), name("root").alias("character_id"), F.col("parent_name").alias("location_id")),
        "relationships": relations.select("project", "id", name("root").alias("source_character_id"), "target_character_id", F.get(kinds, (F.col("k") % len(_KINDS)).cast("int")).alias("type"), F.when(F.col("k") % 3 > 0, F.col("summary")).alias("description")),
    }
    made = {n: materialize(t, f"world-{n}") for n, t in made.items() if wanted is None or n in wanted}  # several rules read each, none makes it again
    return made | {
        "characters": names.select(F.col("scope").alias("project"), "id", "canonical_name", "aliases"),
        "events": events.select(F.col("scope").alias("project"), "id", "title", "chapter_index", "relative_order", "involved_character_ids", F.array_sort("location_names").alias("involved_location_ids")),
    }


_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_WORLD = f"""{FACTS}, {_ROOTS}, {_SEGMENTS}, g AS (SELECT grouped.*, version, split_part(grouped.root, chr(31), 2) AS c, scope AS project, type || ' ' || (k % 5) AS title FROM grouped JOIN steps USING (id)),
    nm AS (SELECT project, c, name, sum(n) AS n FROM (SELECT project, c, entity_name AS name, 1 AS n FROM g UNION ALL SELECT project, c, candidate, 0 FROM g WHERE candidate IS NOT NULL) GROUP BY ALL),
    nr AS (SELECT *, row_number() OVER (PARTITION BY project, c ORDER BY n DESC, length(name), name) AS r FROM nm),
    people AS (SELECT project, c AS id, max(name) FILTER (r = 1) AS name, coalesce(list(name ORDER BY name) FILTER (r > 1), []) AS aliases FROM nr GROUP BY ALL),
    looks AS (SELECT c, project, version, summary, min(struct_pack(c := chapter_index, i := id)) AS seen FROM g WHERE type = 'CHARACTER_APPEARANCE' GROUP BY ALL),
    told AS (SELECT project, c, version, string_agg(summary, ' ' ORDER BY seen) AS look FROM looks GROUP BY ALL),
    ver AS (SELECT g.project, g.c, g.version, arg_max(summary, struct_pack(c := chapter_index, i := id)) FILTER (type = 'CHARACTER_AGE') AS age, coalesce(any_value(look), '{entities.NO_APPEARANCE}') AS look
            FROM g LEFT JOIN told ON told.project = g.project AND told.c = g.c AND told.version = g.version GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY chapter_index, created_at, id) - 1 AS seq FROM g),
    ev AS (SELECT project, chapter_index, title, 'e' || arg_min(id, seq) AS id, chapter_index * 1000 + min(seq) AS ro, list_sort(list(DISTINCT c)) AS cs, list_sort(list(DISTINCT parent_name)) AS ls FROM pl GROUP BY project, chapter_index, title),
    fe AS (SELECT pl.*, ev.id AS event FROM pl JOIN ev USING (project, chapter_index, title)),
    lo AS (SELECT DISTINCT project, parent_name AS id FROM g),
    nodes AS (
        SELECT DISTINCT project, 'Project' AS label, project AS id, 'graphKey=' || project || ':Project:' || project || ';id=' || project || ';label=Project;name=project ' || project || ';projectId=' || project AS properties FROM g
        UNION ALL SELECT project, 'Character', id, 'aliases=' || CAST(to_json(aliases) AS VARCHAR) || ';canonicalName=' || name || ';graphKey=' || project || ':Character:' || id || ';id=' || id || ';label=Character;projectId=' || project FROM people
        UNION ALL SELECT project, 'CharacterVersion', c || '#' || version, CASE WHEN age IS NULL THEN '' ELSE 'age=' || age || ';' END || 'appearance=' || look || ';characterId=' || c || ';graphKey=' || project || ':CharacterVersion:' || c || '#' || version || ';id=' || c || '#' || version || ';label=CharacterVersion;projectId=' || project || ';version=' || version FROM ver
        UNION ALL SELECT project, 'Location', id, 'graphKey=' || project || ':Location:' || id || ';id=' || id || ';label=Location;name=' || id || CASE WHEN id = 'loc0' THEN '' ELSE ';parentId=loc0' END || ';projectId=' || project FROM lo
        UNION ALL SELECT project, 'TimelineEvent', id, 'chapterIndex=' || chapter_index || ';graphKey=' || project || ':TimelineEvent:' || id || ';id=' || id || ';involvedCharacterIds=' || CAST(to_json(cs) AS VARCHAR) || ';involvedLocationIds=' || CAST(to_json(ls) AS VARCHAR) || ';label=TimelineEvent;projectId=' || project || ';relativeOrder=' || ro || ';title=' || title FROM ev
        UNION ALL SELECT project, 'Scene', 's' || id, 'characterId=' || c || ';graphKey=' || project || ':Scene:s' || id || ';id=s' || id || ';label=Scene;locationId=' || parent_name || ';projectId=' || project FROM g WHERE id % 50 = 0)"""


def _edges_sql() -> str:
    plain = lambda a, kind, b, rows: f"SELECT DISTINCT project, {a} AS source, '{kind}' AS type, {b} AS target, 'projectId=' || project || ';type={kind}' AS properties FROM {rows}"
    key = lambda label, c: f"project || ':{label}:' || {c}"
    next_event = "(SELECT project, id, lead(id) OVER (PARTITION BY project ORDER BY ro, chapter_index, id) AS after FROM ev) WHERE after IS NOT NULL"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items())
    return " UNION ALL ".join(
        [
            f"""SELECT project, {key("Project", "project")} AS source, 'RELATED_TO' AS type, project || ':' || label || ':' || id AS target,
            'projectId=' || project || ';role=' || CASE label WHEN 'Character' THEN 'character' WHEN 'Location' THEN 'location' WHEN 'TimelineEvent' THEN 'timeline-event' ELSE 'scene' END || ';type=RELATED_TO' AS properties FROM nodes WHERE label IN ('Character', 'Location', 'TimelineEvent', 'Scene')""",
            plain(key("CharacterVersion", "c || '#' || version"), "VERSION_OF", key("Character", "c"), "ver"),
            plain(key("Character", "c"), "APPEARS_IN", key("TimelineEvent", "event"), "fe"),
            plain(key("TimelineEvent", "event"), "HAPPENS_AT", key("Location", "parent_name"), "fe"),
            plain(key("CharacterVersion", "c || '#' || version"), "APPEARS_IN", key("TimelineEvent", "event"), "fe"),
            plain(key("Location", "id"), "LOCATED_IN", key("Location", "'loc0'"), "lo WHERE id <> 'loc0'"),
            plain(key("TimelineEvent", "id"), "BEFORE", key("TimelineEvent", "after"), next_event),
            plain(key("TimelineEvent", "after"), "AFTER", key("TimelineEvent", "id"), next_event),
            plain(key("Character", "c"), "APPEARS_IN", key("Scene", "'s' || id"), "g WHERE id % 50 = 0"),
            plain(key("Character", "c"), "VISITS", key("Scene", "'s' || id"), "g WHERE id % 50 = 0"),
            plain(key("Scene", "'s' || id"), "HAPPENS_AT", key("Location", "parent_name"), "g WHERE id % 50 = 0"),
            f"""SELECT project, {key("Character", "a")} AS source, kind AS type, {key("Character", "b")} AS target,
            arg_max(CASE WHEN said IS NULL THEN '' ELSE 'description=' || said || ';' END || 'id=' || id || ';projectId=' || project || ';type=' || kind, id) AS properties
            FROM (SELECT x.project, x.id, x.c AS a, y.c AS b, CASE list_extract({_KIND_SQL}, CAST(x.k % {len(_KINDS)} + 1 AS BIGINT)) {cases} END AS kind, CASE WHEN x.k % 3 > 0 THEN x.summary END AS said
                  FROM g x JOIN g y ON y.id = x.id + 1 AND y.project = x.project) GROUP BY project, a, b, kind""",
        ]
    )


@query(f"WITH RECURSIVE {_WORLD} SELECT project, project || ':' || label || ':' || id AS key, label, properties FROM nodes")
def project_nodes(spark, sf_dir):
    """Places come twice, so that the last row of a node stays."""
    return graph.graph_nodes(world_tables(spark, sf_dir, [n.table for n in graph.NODES])).select("project", "key", "label", _told().alias("properties"))


@query(f"WITH RECURSIVE {_WORLD} {_edges_sql()}")
def project_edges(spark, sf_dir):
    """Relationships of all kinds, of which several become one edge; the last one's values stay."""
    tables = world_tables(spark, sf_dir)
    nodes = materialize(graph.graph_nodes(tables), "graph-nodes")
    return graph.graph_edges(tables, nodes).select("project", "source", "type", "target", _told().alias("properties"))


# ------------------------------------------------------------------ points and prompts

_POINT_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(
    f"""WITH RECURSIVE {_WORLD}, points AS (
        SELECT ver.project, 'CharacterVersion' AS entity_type, c || '#' || version AS entity_id, name || ' v' || version AS title, name || coalesce(chr(10) || age, '') || chr(10) || look AS text FROM ver JOIN people ON people.project = ver.project AND people.id = ver.c
        UNION ALL SELECT project, 'TimelineEvent', id, title, title || chr(10) || 'chapter:' || chapter_index || chr(10) || 'relativeOrder:' || ro FROM ev
        UNION ALL SELECT 'b' || doc_id % 5, 'BookChunk', CAST(doc_id AS VARCHAR), 'Book ' || lang || ' chapter ' || doc_id % 7 || ' chunk ' || doc_id, text FROM documents)
    SELECT project, entity_type, entity_id, {_POINT_SQL} AS id, title, sha256(text) AS text_sha256 FROM (SELECT *, sha256(project || ':' || entity_type || ':' || entity_id) AS h FROM points)"""
)
def project_points(spark, sf_dir):
    """Chunks are whole documents, versions and events those of the project graph."""
    k = F.col("doc_id")
    chunks = read(spark, sf_dir, "documents").select(F.concat(F.lit("b"), k % 5).alias("project"), k.alias("id"), F.concat(F.lit("Book "), "lang").alias("book_title"), (k % 7).alias("chapter_index"), k.alias("order_index"), "text")
    made = points.project_points(world_tables(spark, sf_dir, ["characters", "character_versions", "events"]) | {"chunks": chunks})
    return made.select("project", "entity_type", "entity_id", "id", "title", F.sha2("text", 256).alias("text_sha256"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Draw ' || p_name || ', ' || p_brand || '!' WHEN 1 THEN '{{ missing }}' || p_brand || '{{name}}' || p_brand ELSE 'plain $1 \\' END AS text FROM part"""
)
def template_rows(spark, sf_dir):
    """Each row has a template and values of its own; some values look like places."""
    k = F.col("p_partkey")
    template = F.when(k % 3 == 0, "Draw {{ name }}, {{brand}}!").when(k % 3 == 1, "{{ missing }}{{ brand }}{{place}}{{ brand }}").otherwise("plain $1 \\")
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("place"), F.lit("{{name}}"))
    return read(spark, sf_dir, "part").select("p_partkey", prompts.render_rows(template, values).alias("text"))


_STYLE_SQL = "'Visual style: ' || p_type, 'Style language: ' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'Primary color: #' || p_size END, 'Contrast level: ' || p_size % 3 || '/100', 'Grain level: 5/100'"


def _style_of_part() -> Column:
    size = F.col("p_size")
    color = F.when(size % 2 == 0, F.concat(F.lit("#"), size.cast("string")))
    none = F.lit(None).cast("string")
    return F.struct(F.col("p_type").alias("name"), F.col("p_brand").alias("prompt"), F.col("p_brand").alias("negative_prompt"), color.alias("primary_color"), F.lit("").alias("secondary_color"), none.alias("accent_color"), (size % 3).alias("contrast_level"), none.alias("saturation_level"), F.lit(5).alias("grain_level"), none.alias("line_thickness"))


def _fields(names, **values: Column) -> Column:
    """A struct of the fields that prompts have, null where no value is given."""
    return F.struct(*(values.get(n, F.lit(None).cast("string")).cast("string").alias(n) for n in ("name", *names) if n != "aliases"), values.get("aliases", F.array().cast("array<string>")).alias("aliases"))


@query(
    f"""SELECT p_partkey, concat_ws(chr(10), '{prompts.SCENE_TASK}', 'User scene request: ' || p_name, CASE WHEN p_size % 3 = 0 THEN 'Timeline hint: h' || p_size END, 'Aspect ratio: 16:9',
    CASE WHEN p_size % 2 = 0 THEN 'Resolved characters:' || chr(10) || '- ' || p_brand || '; aliases=a, b; age=' || p_size || '; appearance={{"x":1}}' || chr(10) || '- other; appearance=plain' END,
    'Resolved locations:' || chr(10) || '- ' || p_type || '; description=d; era=now', CASE WHEN p_size % 5 = 0 THEN 'Resolved objects:' || chr(10) || '- clock; visual=v' END,
    'Knowledge graph context:' || chr(10) || 'node A: {{}}', 'Approved reference assets:' || chr(10) || '- character:7; assetId=' || p_partkey || '; path=p; mime=image/png', {_STYLE_SQL}, '{prompts.SCENE_RULES[0]}', '{prompts.SCENE_RULES[1]}') AS prompt,
    p_brand || ', {prompts.SCENE_AVOIDS}' AS negative_prompt FROM part"""
)
def scene_prompt_whole(spark, sf_dir):
    size = F.col("p_size")
    people, places, things = prompts.CHARACTER_FIELDS.values(), prompts.LOCATION_FIELDS.values(), prompts.OBJECT_FIELDS.values()
    none = lambda names: F.filter(F.array(_fields(names)), lambda x: F.lit(False))
    one = _fields(people, name=F.col("p_brand"), aliases=F.array(F.lit("a"), F.lit("b")), age=size, appearance=F.lit('{"x":1}'))
    characters = F.when(size % 2 == 0, F.array(one, _fields(people, name=F.lit("other"), appearance=F.lit("plain")))).otherwise(none(people))
    locations = F.array(_fields(places, name=F.col("p_type"), description=F.lit("d"), era=F.lit("now"), palette=F.lit("")))
    objects = F.when(size % 5 == 0, F.array(_fields(things, name=F.lit("clock"), visual_prompt=F.lit("v")))).otherwise(none(things))
    assets = F.array(F.struct(F.lit("character").alias("entity_type"), F.lit("7").alias("entity_id"), F.col("p_partkey").cast("string").alias("id"), F.lit("p").alias("local_path"), F.lit("image/png").alias("mime_type"), F.lit(None).cast("string").alias("prompt")))
    request = F.struct(F.col("p_name").alias("user_text"), F.when(size % 3 == 0, F.concat(F.lit("h"), size)).alias("timeline_hint"), F.lit("16:9").alias("aspect_ratio"))
    made = prompts.scene_prompt(request, characters, locations, objects, F.array(F.lit("node A: {}")), assets, _style_of_part())
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("x")).select("p_partkey", "x.*")


@query(
    f"""SELECT p_partkey, concat_ws(chr(10), 'Character visual passport asset: SHEET', 'Character: ' || p_name, 'Version: ' || p_size, CASE WHEN p_size % 2 = 0 THEN 'Age: ' || p_size END, 'Asset layout: ' || p_type, 'Appearance: a', {_STYLE_SQL}, 'Seed: ' || p_partkey,
    '{prompts.PASSPORT_RULES[0]}', '{prompts.PASSPORT_RULES[1]}') AS prompt, p_brand || CASE WHEN p_size % 3 = 0 THEN ', bad' ELSE '' END || ', {prompts.PASSPORT_AVOIDS}' AS negative_prompt FROM part"""
)
def passport_prompt_whole(spark, sf_dir):
    size = F.col("p_size")
    version = _fields((*prompts.PASSPORT_FIELDS.values(), "version", "age", "negative_prompt"), version=size, age=F.when(size % 2 == 0, size), appearance=F.lit("a"), negative_prompt=F.when(size % 3 == 0, "bad"))
    made = prompts.passport_prompt(F.lit("SHEET"), F.col("p_type"), F.col("p_name"), version, _style_of_part(), F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("x")).select("p_partkey", "x.*")


# ------------------------------------------------------------------ stored vectors


def _vectors(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("project"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("old").alias("kind"))


@query(
    """SELECT 'p' || CASE WHEN vec_id % 20 = 0 THEN 99 ELSE label END AS project, vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'old' END AS kind,
    round(CAST(CASE WHEN vec_id % 10 = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 5) AS first FROM embeddings WHERE label <> 3 OR vec_id % 20 = 0
    UNION ALL SELECT 'p' || label, vec_id, 'old', round(CAST(embedding[1] AS DOUBLE), 5) FROM embeddings WHERE vec_id % 20 = 0 AND label <> 3"""
)
def vector_index_updates(spark, sf_dir):
    """An index of all points, after a tenth of them got opposite vectors (half of these as points of
    a project of their own) and one project went."""
    rows = _vectors(spark, sf_dir)
    index = VectorIndex.create(spark, f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}", rows, 16)
    changed = rows.where("id % 10 = 0").withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("kind", F.lit("new"))
    index.upsert(changed.withColumn("project", F.when(F.col("id") % 20 == 0, "p99").otherwise(F.col("project"))))
    index.delete(F.col("project") == "p3")
    return index.points().select("project", "id", "kind", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@query("SELECT count(*) AS n_queries, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether a search of the index finds nine tenths of the exact ten best of every vector whose
    id is divisible by 50, against all, with as many lists as a tenth of these queries asks for."""
    rows = _vectors(spark, sf_dir).withColumn("project", F.lit("all"))
    index = VectorIndex.create(spark, f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}", rows, 32)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "project", "vector")
    probes = index.probes_for(queries.where("query_id % 500 = 0"), 10, 0.95)
    reached = index.recall(queries, 10, probes)
    return queries.agg(F.count("*").alias("n_queries"), (F.lit(reached) >= 0.9).alias("enough"))
