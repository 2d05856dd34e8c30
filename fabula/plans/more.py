"""Registered queries of views, lookups, typed values and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import prompts
from fabula.functions import text as T
from fabula.operators import books, entities, graph, timeline, vectors, views
from fabula.plans.queries import _GRAPH, _ROOTS, _SEGMENTS, FACTS, PLANNED, _graph, facts, planned, query, read
from fabula.plans.storage import materialize
from fabula.sources import tables

ALL_TYPES = [*entities.CHARACTER_TYPES, *entities.LOCATION_TYPES, *entities.TIMELINE_TYPES, "CHARACTER_ROLE", "OTHER"]


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ------------------------------------------------------------------ filters


@query(
    f"""SELECT id, type, CASE WHEN type IN {_in(entities.CHARACTER_TYPES)} THEN 'character' WHEN type IN {_in(entities.LOCATION_TYPES)} THEN 'location' WHEN type IN {_in(entities.TIMELINE_TYPES)} THEN 'timeline' END AS family
    FROM (SELECT event_id AS id, ({ALL_TYPES})[event_id % {len(ALL_TYPES)} + 1] AS type FROM events)"""
)
def fact_families(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ALL_TYPES)), (F.col("event_id") % len(ALL_TYPES) + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("type")).withColumn("family", entities.family(F.col("type")))


@query("SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'view' AND day(ts) <= 9")
def equality_conjunction(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where((F.col("user_id") == 7) & (F.col("event_type") == "view") & (F.dayofmonth("ts") <= 9)).select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND value > 50 AND (user_id % 5, event_id % 3) IN ((1, 0), (2, 1), (4, 2))")
def composite_keys(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    assets = e.select("event_id", F.when(F.col("event_type") == "view", "REFERENCE").otherwise("GENERATED").alias("type"), F.when(F.col("value") > 50, "APPROVED").otherwise("PENDING").alias("status"), (F.col("user_id") % 5).alias("a"), (F.col("event_id") % 3).alias("b"))
    return views.with_composite_keys(assets, spark.createDataFrame([(1, 0), (2, 1), (4, 2)], "a bigint, b bigint"), "a", "b").select("event_id")


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 = 0))")
def relation_predicate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.sha2("text", 256).alias("content_hash"))
    analyses = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("book_id"))
    return views.having_content(analyses, d, d.where("book_id % 50 = 0").select("content_hash")).select(F.col("book_id").alias("doc_id"))


@query("SELECT doc_id, known_id FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 50 = 0) LEFT JOIN (SELECT sha256(text) AS h, max(doc_id) AS known_id FROM documents WHERE doc_id % 50 <> 0 GROUP BY 1) USING (h)")
def newest_with_content(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    known = d.where("doc_id % 50 <> 0").select("content_hash", F.col("doc_id").alias("known_id"))
    return books.newest_with_content(d.where("doc_id % 50 = 0"), known, F.desc("known_id")).select("doc_id", "known_id")


@query(
    """SELECT o_orderkey AS analysis_id, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 1000000 + o_custkey END, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 2000000 + o_custkey END, o_orderkey) AS world_id
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"""
)
def scope_coalesce(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey")
    o = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    analyses = o.select(k.alias("analysis_id"), F.when(k % 3 == 0, c).alias("series_id"), F.when(k % 2 == 0, c).alias("project_id"), k.alias("world_id"))
    series = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("series_id"), (F.col("c_custkey") + 1000000).alias("world_id"))
    projects = customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") + 2000000).alias("world_id"))
    return views.world_scope(analyses, series, projects).select("analysis_id", "world_id")


_JSON = """'{"summary":' || CASE k % 4 WHEN 0 THEN '"s' || k || '"' WHEN 1 THEN '5' WHEN 2 THEN 'null' ELSE '{"a":1}' END || ',"candidateNames":' || CASE k % 3 WHEN 0 THEN '["a",1,"b",null]' WHEN 1 THEN '"x"' ELSE '[]' END || ',"era":"e"}'"""


def _json():
    k = F.get_json_object("props", "$.k").try_cast("long")
    summary = F.when(k % 4 == 0, F.concat(F.lit('"s'), k.cast("string"), F.lit('"'))).when(k % 4 == 1, "5").when(k % 4 == 2, "null").otherwise('{"a":1}')
    names = F.when(k % 3 == 0, '["a",1,"b",null]').when(k % 3 == 1, '"x"').otherwise("[]")
    return F.when(k % 11 == 0, F.lit("[1]")).otherwise(F.concat(F.lit('{"summary":'), summary, F.lit(',"candidateNames":'), names, F.lit(',"era":"e"}')))


_JSON_ROWS = f"j AS (SELECT event_id, CASE WHEN k % 11 = 0 THEN '[1]' ELSE {_JSON} END AS j FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


@query(
    f"""WITH {_JSON_ROWS} SELECT event_id, CASE WHEN json_type(j, '$.summary') = 'VARCHAR' THEN json_extract_string(j, '$.summary') END AS summary, json_extract_string(j, '$.era') AS era,
    CASE WHEN json_type(j, '$.candidateNames') = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(json_extract(j, '$.candidateNames') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), ',') ELSE '' END AS names FROM j"""
)
def typed_json(spark, sf_dir):
    v = entities.typed_values(_json(), ("summary", "era"), ("candidateNames",))
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", "v.summary", "v.era", F.array_join("v.candidateNames", ",").alias("names"))


@query(f"WITH {_JSON_ROWS} SELECT event_id, CASE WHEN j[1] = '{{' THEN replace(j, '\"summary\":null,', '') END AS safe FROM j")
def json_safe(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", entities.safe_json(_json()).alias("safe"))


@query("SELECT p_partkey, list_reduce(list_filter([CASE WHEN length(p_name) > 12 THEN 'name' END, CASE WHEN NOT p_size BETWEEN 5 AND 40 THEN 'size' END], lambda x: x IS NOT NULL), lambda a, b: a || ',' || b, '') AS errors FROM part WHERE length(p_name) > 12 OR NOT p_size BETWEEN 5 AND 40")
def reject_table(spark, sf_dir):
    rows = views.checked(read(spark, sf_dir, "part"), name=F.length("p_name") <= 12, size=F.col("p_size").between(5, 40))
    return rows.where(F.size("errors") > 0).select("p_partkey", F.concat(F.lit(","), F.array_join("errors", ",")).alias("errors"))


@query(
    """WITH l AS (SELECT p_brand, max(p_partkey) AS k FROM part GROUP BY p_brand) SELECT p_brand, p_partkey AS version, CASE WHEN p_partkey = k THEN 'new ' || p_brand ELSE p_name END AS age,
    CASE WHEN p_partkey = k AND ends_with(p_brand, '1') THEN NULL ELSE p_type END AS speech FROM part JOIN l USING (p_brand)"""
)
def partial_update(spark, sf_dir):
    versions = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("version"), F.col("p_name").alias("age"), F.col("p_type").alias("speech"))
    none = F.lit(None).cast("string")
    patches = versions.select("p_brand").distinct().select("p_brand", F.concat(F.lit("new "), "p_brand").alias("age"), none.alias("speech"), F.when(F.col("p_brand").endswith("1"), F.array(F.lit("speech"))).alias("clear"))
    return entities.patch_last_version(versions, patches, "p_brand", "clear")


# ------------------------------------------------------------------ joins


@query("SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def nested_include(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    made = views.include(read(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", F.col("o_orderdate"), F.col("o_orderkey"))
    return made.select("c_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


@query("SELECT DISTINCT l_orderkey AS event_id, p_partkey AS version_id, p_size AS version, n_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN nation ON p_partkey % 25 = n_nationkey")
def bridge_join(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("version_id"))
    versions = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), F.col("p_size").alias("version"), (F.col("p_partkey") % 25).alias("character_id"))
    people = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("character_id"), F.col("n_name").alias("name"))
    return timeline.event_versions(links, versions, people).select("event_id", "version_id", "version", "name")


@query(
    """WITH names AS (SELECT DISTINCT 's' || (user_id % 3) AS scope, user_id AS entity, 'u' || user_id AS name FROM events UNION SELECT DISTINCT 's' || (user_id % 3), user_id, 'u' || (user_id % 10) FROM events),
    idx AS (SELECT scope, name, max(entity) AS entity FROM names GROUP BY ALL),
    asked AS (SELECT event_id, 's' || (user_id % 3) AS scope, unnest(['u' || user_id, 'u' || (user_id % 10), 'nobody']) AS name FROM events)
    SELECT DISTINCT event_id AS id, entity AS entity_id FROM asked JOIN idx USING (scope, name)"""
)
def name_lookup(spark, sf_dir):
    u = F.col("user_id")
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), (u % 3).cast("string")).alias("scope"), F.col("event_id").alias("id"), u.alias("entity_id"), u.alias("rank"), F.concat(F.lit("u"), u.cast("string")).alias("full"), F.concat(F.lit("u"), (u % 10).cast("string")).alias("short"))
    people = e.select("scope", "entity_id", "rank", F.explode(F.array("full", "short")).alias("name")).distinct()
    asked = e.select("scope", "id", F.array(F.upper("full"), F.concat(F.lit("  "), "short"), F.lit("nobody"), "full").alias("names"))
    return timeline.resolve_names(asked, timeline.name_index(people), "names").select("id", "entity_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0) OR c_custkey IN (SELECT o_custkey + 1 FROM orders WHERE o_orderkey % 50 = 0)")
def semi_join_ids(spark, sf_dir):
    lists = read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.array("o_custkey", F.col("o_custkey") + 1).alias("ids"))
    return views.listed_in(read(spark, sf_dir, "customer"), lists, "c_custkey", "ids").select("c_custkey")


@query(
    """WITH s AS (SELECT o_orderkey AS scene, o_custkey % 100 AS location FROM orders WHERE o_orderkey % 50 = 0),
    c AS (SELECT scene, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS characters FROM s JOIN lineitem ON l_orderkey = scene GROUP BY scene),
    o AS (SELECT scene, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS objects FROM s JOIN part ON p_partkey % 100 = location AND p_partkey % 7 = 0 GROUP BY scene)
    SELECT scene, coalesce(characters, '') AS characters, CAST(location AS VARCHAR) AS locations, coalesce(objects, '') AS objects FROM s LEFT JOIN c USING (scene) LEFT JOIN o USING (scene)"""
)
def optional_chain(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("scene"), (F.col("o_custkey") % 100).cast("string").alias("location"))
    appears = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("character"), F.col("l_orderkey").alias("scene"))
    things = read(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").cast("string").alias("object"), (F.col("p_partkey") % 100).cast("string").alias("location"))
    made = graph.scene_entities(o.select("scene"), appears, o, things)
    return made.select("scene", *(F.array_join(f"{c}_ids", ",").alias(f"{c}s") for c in ("character", "location", "object")))


@query("SELECT p_brand, p_partkey AS version, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1")
def last_version(spark, sf_dir):
    return entities.last_versions(read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("version"), "p_name"), "p_brand")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS p_name FROM part UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey % 5 = 0")
def upsert_by_key(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = p.where("p_partkey % 3 = 0").withColumn("p_name", F.concat("p_name", F.lit("!"))).union(p.where("p_partkey % 5 = 0").select(-F.col("p_partkey"), F.lit("new")))
    return tables.upsert(p, new, "p_partkey")


# ------------------------------------------------------------------ aggregations of facts

def _located(spark, sf_dir):
    k = F.col("k")
    return facts(spark, sf_dir).withColumns({"atmosphere": F.concat(F.lit("a"), k % 3), "lighting": F.when(k % 5 == 0, F.concat(F.lit("l"), k % 2)), "architecture": F.when(k % 2 == 0, "Arch").otherwise(" arch ")})


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS}, v AS (SELECT root, chapter_index, id, unnest(['atmosphere', 'lighting', 'architecture', 'era']) AS attribute, unnest(['a' || (k % 3), CASE WHEN k % 5 = 0 THEN 'l' || (k % 2) END, 'arch', era]) AS value FROM grouped)
    SELECT root, attribute, count(DISTINCT value) AS n_values, count(*) AS n_facts, min(id) AS first_fact FROM v WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1"""
)
def location_conflicts(spark, sf_dir):
    found = entities.location_conflicts(entities.entity_groups(_located(spark, sf_dir)))
    return found.select("root", "attribute", "n_values", F.size("facts").cast("long").alias("n_facts"), F.array_min(F.transform("facts", lambda x: x["fact_id"])).alias("first_fact"))


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS} SELECT root AS subject, 'ATTRIBUTE' AS kind, type AS detail FROM grouped WHERE type IN ('CHARACTER_AGE', 'CHARACTER_APPEARANCE', 'CHARACTER_PERSONALITY') GROUP BY root, type HAVING count(DISTINCT summary) > 1
    UNION ALL SELECT root, 'PARENT', CAST(count(DISTINCT parent_name) AS VARCHAR) FROM grouped GROUP BY root HAVING count(DISTINCT parent_name) > 1"""
)
def conflict_union(spark, sf_dir):
    groups = entities.entity_groups(facts(spark, sf_dir))
    made = entities.conflicts(("ATTRIBUTE", entities.attribute_conflicts(groups), "type"), ("PARENT", entities.location_parents(groups).where("n_parents > 1"), "n_parents"))
    return made.select("subject", "kind", "detail")


_DRESSED = FACTS.replace("'v' || (k % 4) AS summary", "CASE k % 5 WHEN 0 THEN 'Red dress' WHEN 1 THEN 'wears a hat ' || (k % 3) WHEN 2 THEN ' одежда ' ELSE 'tall ' || (k % 4) END AS summary")


@query(
    f"""WITH RECURSIVE {_DRESSED}, {_ROOTS}, {_SEGMENTS}, f AS (SELECT g.root, g.type, g.chapter_index, g.id, trim(g.summary) AS summary, version FROM grouped g JOIN steps USING (id)),
    u AS (SELECT root, version, type, summary, min(struct_pack(c := chapter_index, i := id)) AS seen FROM f GROUP BY ALL)
    SELECT root, version, string_agg(summary, ' ' ORDER BY seen) FILTER (type = 'CHARACTER_APPEARANCE' AND (contains(lower(summary), 'dress') OR contains(lower(summary), 'wears') OR contains(lower(summary), 'одеж'))) AS clothing,
           string_agg(summary, ' ' ORDER BY seen) FILTER (type = 'CHARACTER_PERSONALITY') AS personality FROM u GROUP BY root, version"""
)
def character_wardrobe(spark, sf_dir):
    k = F.col("k")
    said = F.when(k % 5 == 0, "Red dress").when(k % 5 == 1, F.concat(F.lit("wears a hat "), k % 3)).when(k % 5 == 2, " одежда ").otherwise(F.concat(F.lit("tall "), k % 4))
    groups = entities.entity_groups(facts(spark, sf_dir).withColumn("summary", said))
    return entities.character_versions(entities.version_segments(groups)).select("root", "version", "clothing", "personality")


@query(
    """WITH n AS (SELECT p_type AS root, CASE p_partkey % 4 WHEN 0 THEN 'Mr. ' || p_name WHEN 1 THEN p_name || ' Jr' ELSE p_name END AS name FROM part), c AS (SELECT root, name, count(*) AS n FROM n GROUP BY ALL)
    SELECT root, name AS canonical_name FROM c QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, starts_with(name, 'Mr. '), len(string_split(name, ' ')) DESC, length(name), name) = 1"""
)
def canonical_people(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Mr. "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" Jr"))).otherwise(F.col("p_name"))
    rows = read(spark, sf_dir, "part").select(F.lit("p").alias("scope"), F.col("p_type").alias("root"), name.alias("entity_name"), F.array().cast("array<string>").alias("candidate_names"))
    return entities.canonical_names(rows).select("root", "canonical_name")


@query("WITH n AS (SELECT DISTINCT p_name AS name, p_type AS root FROM part), c AS (SELECT root, name, count(*) AS n FROM (SELECT p_type AS root, p_name AS name FROM part) GROUP BY ALL) SELECT root, name AS canonical_name FROM c QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, length(name), name) = 1")
def canonical_places(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.lit("p").alias("scope"), F.col("p_type").alias("root"), F.col("p_name").alias("entity_name"), F.array().cast("array<string>").alias("candidate_names"))
    return entities.canonical_names(rows, people=False, normalize=T.normalize_text).select("root", "canonical_name")


@query(
    """WITH n AS (SELECT DISTINCT p_type AS root, trim(regexp_replace(regexp_replace(lower(p_name), '^the\\s+', ''), '\\b(city|park|square|street|district|building|room|apartment)\\b', '', 'g')) AS key FROM (SELECT p_type, CASE p_partkey % 3 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ' Park' ELSE p_name END AS p_name FROM part))
    SELECT DISTINCT a.root AS left_root, b.root AS right_root FROM n a JOIN n b USING (key) WHERE a.root < b.root AND length(key) > 2"""
)
def possible_duplicate_places(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("The "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" Park"))).otherwise(F.col("p_name"))
    names = read(spark, sf_dir, "part").select(F.lit("p").alias("scope"), F.col("p_type").alias("root"), name.alias("name")).distinct()
    return entities.possible_duplicates(names, loose=True).select("left_root", "right_root")


@query("WITH n AS (SELECT DISTINCT p_name AS name, p_type AS root FROM part), k AS (SELECT DISTINCT root, '=' || lower(name) AS key FROM n UNION SELECT DISTINCT root, '~' || string_split(lower(name), ' ')[-1] FROM n) SELECT key, root, count(*) OVER (PARTITION BY key) AS n_roots FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1")
def duplicate_classes(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.lit("p").alias("scope"), F.col("p_type").alias("root"), F.col("p_name").alias("name")).distinct()
    return entities.duplicate_classes(names).select("key", "root", "n_roots")


@query(f"WITH {PLANNED} SELECT who AS scope, id, CAST(seq AS BIGINT) AS order_index, row_number() OVER (PARTITION BY who ORDER BY own, chapter_index, seq) - 1 AS position FROM planned")
def timeline_view(spark, sf_dir):
    made = timeline.timeline_view(planned(spark, sf_dir))
    return made.select("scope", "id", F.col("order_index").cast("long").alias("order_index"), F.col("position").cast("long").alias("position"))


# ------------------------------------------------------------------ orders and sets


@query("SELECT DISTINCT p_name FROM part ORDER BY lower(p_name), p_name")
def names_by_locale(spark, sf_dir):
    return views.by_name(read(spark, sf_dir, "part").select("p_name").distinct(), "p_name")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS parent FROM nation ORDER BY parent NULLS LAST, n_name")
def locations_by_parent(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).alias("parent"))
    return views.locations_view(n, "n_name", "parent")


@query("SELECT p_partkey, p_name, p_size = 1 AS is_default FROM part ORDER BY is_default DESC, p_name")
def styles_by_default(spark, sf_dir):
    return views.styles_view(read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), (F.col("p_size") == 1).alias("is_default"))).withColumnRenamed("name", "p_name")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id")
def assets_by_created(spark, sf_dir):
    return views.assets_view(read(spark, sf_dir, "events").where("event_type = 'purchase'"), "ts", "event_id").select("event_id")


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS}, {_SEGMENTS}, c AS (SELECT root, any_value(scope) AS scope, count(DISTINCT entity_name) AS n FROM grouped GROUP BY root) SELECT root, version FROM (SELECT DISTINCT root, version FROM steps) JOIN c USING (root)"""
)
def characters_view(spark, sf_dir):
    made = entities.merge_characters(facts(spark, sf_dir))
    return views.characters_view(made["characters"], made["versions"]).select("root", "version")


@query(f"WITH {_GRAPH} SELECT * FROM edges ORDER BY type, source, target")
def graph_order(spark, sf_dir):
    return graph.ordered_edges(_graph(spark, sf_dir)[1])


_NEAR = """b AS (SELECT source AS key, target AS next FROM edges UNION SELECT target, source FROM edges), seeds AS (SELECT 'p:Supplier:' || s_suppkey AS key FROM supplier WHERE s_suppkey % 50 = 0),
    one AS (SELECT seeds.key AS seed, next AS key FROM seeds JOIN b USING (key)), near AS (SELECT key AS seed, key FROM seeds UNION SELECT * FROM one UNION SELECT seed, next FROM one JOIN b USING (key))"""


@query(
    f"""WITH {_GRAPH}, {_NEAR}, top AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY label, key) AS line, 'node ' || label || ': {{"name":"' || name || '"}}' AS text FROM near JOIN nodes USING (key)),
    inside AS (SELECT DISTINCT a.seed, type, source, target FROM edges JOIN near a ON a.key = source JOIN near b ON b.key = target AND a.seed = b.seed),
    links AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY type, source, target) AS line, 'relationship ' || type || ': ' || source || ' -> ' || target AS text FROM inside)
    SELECT seed, line, text FROM top WHERE line <= 20 UNION ALL SELECT seed, line + 20, text FROM links WHERE line <= 30"""
)
def graph_context(spark, sf_dir):
    """Queries are the suppliers whose key is divisible by 50."""
    nodes, edges = (materialize(t, "graph") for t in _graph(spark, sf_dir))
    seeds = read(spark, sf_dir, "supplier").where("s_suppkey % 50 = 0").select(graph.graph_key(F.lit("p"), "Supplier", "s_suppkey").alias("key"))
    made = graph.seed_context(seeds, nodes, edges)
    return made.select("seed", F.col("line").cast("long").alias("line"), "text")


@query(
    f"""WITH {_GRAPH} SELECT 'node' AS kind, key FROM nodes WHERE NOT (label = 'Customer' AND CAST(split_part(key, ':', 3) AS BIGINT) % 2 = 0)
    UNION ALL SELECT 'edge', source FROM edges WHERE NOT (type = 'LIVES_IN' AND source LIKE 'p:Customer:%' AND CAST(split_part(source, ':', 3) AS BIGINT) % 2 = 0)"""
)
def graph_delete_scope(spark, sf_dir):
    """Customers with an even key stand for another project, which is deleted."""
    nodes, edges = _graph(spark, sf_dir)
    moved = lambda c: F.when(F.col(c).startswith("p:Customer:") & (F.substring_index(c, ":", -1).cast("long") % 2 == 0), F.concat(F.lit("q"), F.substring(c, 2, 99))).otherwise(F.col(c))
    n, e = graph.without_scope(nodes.withColumn("key", moved("key")), edges.withColumn("source", moved("source")), "q")
    return n.select(F.lit("node").alias("kind"), "key").union(e.select(F.lit("edge"), "source"))


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 2)")
def vector_delete(spark, sf_dir):
    return vectors.deleted(read(spark, sf_dir, "embeddings"), label=[1, 2]).select("vec_id", "label")


@query(
    """WITH s AS (SELECT o_custkey AS id, o_orderkey AS position, 1 AS rank FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT c_custkey, 0, 2 FROM customer)
    SELECT id, rank, position FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, position) = 1"""
)
def union_first_wins(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"), F.lit(1).alias("rank"))
    both = o.union(read(spark, sf_dir, "customer").select("c_custkey", F.lit(0), F.lit(2)))
    return views.first_of_each(both, "id", F.col("rank"), F.col("position"))


# ------------------------------------------------------------------ functions


@query(
    """SELECT event_id, epoch_ms(CASE event_id % 5 WHEN 0 THEN TIMESTAMP '2024-01-02' WHEN 1 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN 4 THEN TIMESTAMP '2024-01-02 01:04:05' END) AS at FROM events"""
)
def absolute_date(spark, sf_dir):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "2024-01-02").when(k == 1, "2024-01-02T03:04:05Z").when(k == 2, "2024-13-01").when(k == 3, "soon").otherwise(" 2024-01-02T03:04:05+02:00 ")
    return read(spark, sf_dir, "events").select("event_id", F.unix_millis(T.parse_absolute_date(text)).alias("at"))


@query("SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: unicode(c))) AS BIGINT) AS n FROM part")
def char_code_sum(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.char_code_sum(F.col("p_name")).alias("n"))


@query("SELECT p_partkey, CAST(floor((p_size + 1) / 60.0 * 100 + 0.5) AS BIGINT) AS percent FROM part")
def progress_percent(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.progress_percent(F.col("p_size"), F.lit(60)).alias("percent"))


@query("SELECT item_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS title FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)")
def scene_title(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.scene_title(F.col("text")).alias("title"))


@query("SELECT p_partkey, 'scenes/' || p_brand || '/' || p_partkey || '/' || p_size || CASE WHEN p_size % 2 = 0 THEN '.jpg' ELSE '.png' END AS key FROM part")
def storage_key(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "image/jpeg").otherwise("image/webp")
    return read(spark, sf_dir, "part").select("p_partkey", T.storage_key(F.col("p_brand"), F.col("p_partkey"), F.col("p_size"), kind).alias("key"))


@query("""SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || '}' AS json, p_type AS plain FROM part""")
def json_stringify(spark, sf_dir):
    value = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return read(spark, sf_dir, "part").select("p_partkey", T.json_text(value).alias("json"), T.json_text(F.col("p_type"), True).alias("plain"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, '{"a":' || user_id || '}' AS nested FROM events""")
def graph_values(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.graph_value(F.col("ts"), "timestamp").alias("at"), T.graph_value(F.struct(F.col("user_id").alias("a")), "struct").alias("nested"))


_REGISTRY = [(1, "scene", "1", "old {{ x }}"), (2, "scene", "2", "new {{ x }}"), (3, "people", "1", "who {{ x }}")]


@query(
    f"""WITH r(position, id, version, template) AS (VALUES {", ".join(map(str, _REGISTRY))}), w AS (SELECT p_partkey AS request, CASE p_partkey % 3 WHEN 0 THEN 'scene' WHEN 1 THEN 'people' ELSE 'none' END AS id, CASE WHEN p_partkey % 2 = 0 THEN '2' END AS version FROM part)
    SELECT request, r.version, template FROM w JOIN r ON w.id = r.id AND (w.version IS NULL OR w.version = r.version) QUALIFY row_number() OVER (PARTITION BY request ORDER BY position) = 1"""
)
def prompt_lookup(spark, sf_dir):
    registry = spark.createDataFrame(_REGISTRY, "position int, id string, version string, template string")
    k = F.col("p_partkey")
    wanted = read(spark, sf_dir, "part").select(k.alias("request"), F.when(k % 3 == 0, "scene").when(k % 3 == 1, "people").otherwise("none").alias("id"), F.when(k % 2 == 0, "2").alias("version"))
    return prompts.find_prompts(wanted, registry)


@query(
    """SELECT p_partkey, 'Request: ' || p_name || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Hint: h' || p_size ELSE '' END || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'People:' || chr(10) || '- ' || p_brand || '; age=' || p_size || CASE WHEN p_size % 4 = 0 THEN '; speech=slow' ELSE '' END || chr(10) || '- other' ELSE '' END || chr(10) || 'Style: ' || p_type AS prompt FROM part"""
)
def scene_prompt(spark, sf_dir):
    size = F.col("p_size")
    people = F.when(size % 2 == 0, F.array(prompts.described(F.col("p_brand"), age=size.cast("string"), speech=F.when(size % 4 == 0, "slow")), prompts.described(F.lit("other")))).otherwise(F.array().cast("array<string>"))
    made = prompts.lines(prompts.titled("Request", F.col("p_name")), prompts.titled("Hint", F.when(size % 3 == 0, F.concat(F.lit("h"), size))), prompts.section("People:", people), prompts.titled("Style", F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("prompt"))


@query("SELECT n_nationkey, 'Place: ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'Within: ' || r_name || ' > ' || n_name ELSE '' END || chr(10) || 'Version: ' || n_nationkey AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey")
def passport_prompt(spark, sf_dir):
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    names = F.when(F.col("n_nationkey") % 2 == 0, F.array("r_name", "n_name")).otherwise(F.array("n_name"))
    made = prompts.lines(prompts.titled("Place", F.col("n_name")), prompts.titled("Within", prompts.chain(names)), prompts.titled("Version", F.col("n_nationkey")))
    return read(spark, sf_dir, "nation").join(region, "n_regionkey").select("n_nationkey", made.alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE length(text) END AS end_offset, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS token_estimate FROM documents")
def backfill(spark, sf_dir):
    k = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(k % 2 == 0, F.lit(7).cast("long")).alias("end_offset"), F.when(k % 3 == 0, F.lit(9).cast("long")).alias("token_estimate"))
    return books.backfilled(rows).select("doc_id", "end_offset", "token_estimate")
