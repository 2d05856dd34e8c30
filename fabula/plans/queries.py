"""Registered queries of the library with their SQL, over the driver's tables.

Facts come from ``events``: the user is the entity, the day the chapter, the kind of
event the kind of fact, and ``k`` of its properties says what it states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import prompts
from fabula.functions import text as T
from fabula.operators import books, components, entities, graph, scenes, timeline, vectors
from fabula.plans.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ text

_WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_WSL = r"[ \t\x0b\f\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _normalized_sql(c: str) -> str:
    t = f"replace(nfc_normalize({c}), chr(0), '')"
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[\t\f\x0b]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '[ \x{{00a0}}]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?m)^{_WSL}+|{_WSL}+$', '', 'g')"
    return rf"regexp_replace({t}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"SELECT doc_id, sha256(n) AS text_sha256, length(n) AS n_chars FROM (SELECT doc_id, {_normalized_sql('text')} AS n FROM documents)")
def text_normalize(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", T.normalize_book_text(F.col("text")).alias("n"))
    return t.select("doc_id", F.sha2("n", 256).alias("text_sha256"), F.length("n").cast("long").alias("n_chars"))


def _stripped_sql(c: str) -> str:
    t = f"regexp_replace({c}, '(?is)<script.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for entity, plain in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)")):
        t = f"replace({t}, '{entity}', {plain})"
    return t


@query(f"SELECT page_id, sha256({_stripped_sql('html')}) AS text_sha256 FROM pages")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_xml_tags(F.col("html")), 256).alias("text_sha256"))


_TITLE_SQL = r"""length(title) BETWEEN 3 AND 140 AND (
    regexp_matches(title, '(?i)^(chapter|part|book)\s+([ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b[\s:.-]*(.*)$')
    OR regexp_matches(title, '(?i)^(глава|часть)\s+([ivxlcdm]+|\d+|[а-яё]+)\b[\s:.-]*(.*)$')
    OR regexp_matches(title, '^\d{1,3}[\s.:-]+[^\n]{1,120}$'))"""
_BOOK_SQL = """books AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'intro' || chr(10) || 'Chapter I' || chr(10) || text || chr(10) || '  глава 2 ' || chr(10) || text
    WHEN 2 THEN '1. Start' || chr(10) || text || chr(10) || 'BOOK ten - x' || chr(10) || text || chr(10) || 'chapters' || chr(10) ELSE 'Part one' || chr(10) || text END AS text FROM documents)"""
_LINES_SQL = f"""{_BOOK_SQL}, lines AS (SELECT doc_id, n, i AS line_no, w[i] AS line FROM (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS w, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM books)),
    placed AS (SELECT doc_id, n, trim(line) AS title, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines)"""
_RANGES_SQL = f"""t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM placed WHERE {_TITLE_SQL}),
    ranges AS (SELECT doc_id, row_number() OVER w - 1 AS chapter_index, title, CAST(pos AS BIGINT) AS start_offset, CAST(lead(pos, 1, n) OVER w AS BIGINT) AS end_offset
    FROM t WHERE c > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    UNION ALL SELECT doc_id, 0, NULL, 0, length(text) FROM books WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM t WHERE c > 1))"""


def titled_books(spark, sf_dir):
    """Documents as books: a quarter as they are, the others with title lines."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = lambda *parts: F.concat(*[x for p in parts for x in (F.lit("\n"), p)][1:])
    t, k = F.col("text"), F.col("doc_id") % 4
    made = F.when(k == 1, lines(F.lit("intro"), F.lit("Chapter I"), t, F.lit("  глава 2 "), t))
    made = made.when(k == 2, F.concat(lines(F.lit("1. Start"), t, F.lit("BOOK ten - x"), t, F.lit("chapters")), F.lit("\n")))
    return d.withColumn("text", made.when(k == 3, lines(F.lit("Part one"), t)).otherwise(t))


@query(f"WITH {_LINES_SQL} SELECT doc_id, count(*) AS n_titles FROM placed WHERE {_TITLE_SQL} GROUP BY doc_id")
def chapter_titles(spark, sf_dir):
    return books.marked_books(titled_books(spark, sf_dir)).where(F.size("titles") > 0).select("doc_id", F.size("titles").cast("long").alias("n_titles"))


@query(f"WITH {_LINES_SQL}, {_RANGES_SQL} SELECT * FROM ranges")
def chapter_ranges(spark, sf_dir):
    return books.chapters(titled_books(spark, sf_dir))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return books.deduplicated(read(spark, sf_dir, "documents"))


_CHUNKS_SQL = rf"""chapter_texts AS (SELECT doc_id, chapter_index, start_offset, substr(text, start_offset + 1, end_offset - start_offset) AS t FROM ranges JOIN books USING (doc_id)),
    cuts AS (SELECT doc_id, chapter_index, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS nxt, FALSE AS done FROM chapter_texts
    UNION ALL SELECT doc_id, chapter_index, nxt, e2, greatest(nxt + 1, e2 - 800), e2 >= n FROM (
        SELECT *, CASE WHEN hard >= n THEN n WHEN para > nxt + 3600 THEN para WHEN word > nxt + 5400 THEN word ELSE hard END AS e2 FROM (
            SELECT c.doc_id, c.chapter_index, c.nxt, length(t) AS n, least(c.nxt + 7200, length(t)) AS hard,
                   CASE WHEN contains(substr(t, 1, least(c.nxt + 7200, length(t)) + 2), chr(10) || chr(10)) THEN length(substr(t, 1, least(c.nxt + 7200, length(t)) + 2)) - instr(reverse(substr(t, 1, least(c.nxt + 7200, length(t)) + 2)), chr(10) || chr(10)) - 1 ELSE -1 END AS para,
                   c.nxt + length(regexp_extract(substr(t, c.nxt + 1, least(c.nxt + 7200, length(t)) - c.nxt), '(?s)^(.*)\s', 1)) AS word
            FROM cuts c JOIN chapter_texts USING (doc_id, chapter_index) WHERE NOT c.done AND c.nxt < length(t)))),
    pieces AS (SELECT doc_id, chapter_index, start_offset + s + length(p) - length(ltrim(p, {{ws}})) AS start_offset, start_offset + s + length(rtrim(p, {{ws}})) AS end_offset, trim(p, {{ws}}) AS text
        FROM (SELECT doc_id, chapter_index, start_offset, s, substr(t, s + 1, e - s) AS p FROM cuts JOIN chapter_texts USING (doc_id, chapter_index) WHERE e > 0) WHERE trim(p, {{ws}}) <> ''),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, start_offset, end_offset) - 1 AS order_index FROM pieces),
    hashed AS (SELECT *, sha256(doc_id || ':' || order_index || ':' || start_offset || ':' || end_offset || ':' || text) AS h FROM numbered)""".replace("{{ws}}", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)").replace("{ws}", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")
_UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(
    f"""WITH RECURSIVE {_LINES_SQL}, {_RANGES_SQL}, {_CHUNKS_SQL}
    SELECT doc_id, chapter_index, order_index, start_offset, end_offset, {_UUID_SQL} AS chunk_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS token_estimate FROM hashed"""
)
def chunk_book(spark, sf_dir):
    made = books.chunks(titled_books(spark, sf_dir), target=1800, overlap=200)
    return made.select("doc_id", "chapter_index", "order_index", "start_offset", "end_offset", "chunk_id", "token_estimate")


@query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    """SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT p_partkey, sha256('parts:part:' || p_partkey) AS h FROM part)"""
)
def stable_point_id(spark, sf_dir):
    key = F.concat(F.lit("parts:part:"), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", T.uuid_from_sha256(key).alias("point_id"))


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' \"' || p_name || '\" ' || p_type || '!'), '[''\"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 140) AS slug FROM part")
def slugify(spark, sf_dir):
    title = F.concat(F.col("p_brand"), F.lit(' "'), F.col("p_name"), F.lit('" '), F.col("p_type"), F.lit("!"))
    return read(spark, sf_dir, "part").select("p_partkey", T.slugify(title).alias("slug"))


# ------------------------------------------------------------------ facts

_TYPES = {"signup": "CHARACTER_PLOT_CHANGE", "view": "CHARACTER_APPEARANCE", "click": "CHARACTER_PERSONALITY", "error": "CHARACTER_AGE"}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    kind = F.lit("CHARACTER_MENTION")
    for event, name in _TYPES.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    user = lambda c: F.concat(F.lit("u"), c.cast("string"))
    uid = F.col("user_id")
    return e.select(
        F.concat(F.lit("s"), (uid % 3).cast("string")).alias("scope"),
        F.col("event_id").alias("id"),
        kind.alias("type"),
        user(uid).alias("entity_name"),
        F.when(F.col("event_type") == "signup", F.array(user(uid - uid % 12))).otherwise(F.array().cast("array<string>")).alias("candidate_names"),
        F.dayofmonth("ts").cast("long").alias("chapter_index"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4).alias("confidence"),
        F.when(k % 10 == 0, F.concat(F.lit("h"), F.floor(k / 10).cast("string"))).alias("timeline_hint"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("summary"),
        F.concat(F.lit("loc"), (k % 5).cast("string")).alias("parent_name"),
        F.when(k % 7 == 0, F.concat(F.lit("era"), (k % 3).cast("string"))).alias("era"),
        F.col("ts").alias("created_at"),
        k.alias("k"),
    )


FACTS = """facts AS (SELECT 's' || (user_id % 3) AS scope, event_id AS id,
    CASE event_type WHEN 'signup' THEN 'CHARACTER_PLOT_CHANGE' WHEN 'view' THEN 'CHARACTER_APPEARANCE' WHEN 'click' THEN 'CHARACTER_PERSONALITY' WHEN 'error' THEN 'CHARACTER_AGE' ELSE 'CHARACTER_MENTION' END AS type,
    'u' || user_id AS entity_name, CASE WHEN event_type = 'signup' THEN 'u' || (user_id - user_id % 12) END AS candidate,
    CAST(day(ts) AS BIGINT) AS chapter_index, round(least(value / 100, 1.0), 4) AS confidence,
    CASE WHEN k % 10 = 0 THEN 'h' || (k // 10) END AS timeline_hint, 'v' || (k % 4) AS summary, 'loc' || (k % 5) AS parent_name,
    CASE WHEN k % 7 = 0 THEN 'era' || (k % 3) END AS era, ts AS created_at, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

_ROOTS = """edges AS (SELECT DISTINCT scope, entity_name AS a, coalesce(candidate, entity_name) AS b FROM facts),
    sym AS (SELECT scope, a, b FROM edges UNION SELECT scope, b, a FROM edges),
    reach AS (SELECT DISTINCT scope, a AS node, a AS other FROM sym UNION SELECT reach.scope, reach.node, sym.b FROM reach JOIN sym ON reach.scope = sym.scope AND reach.other = sym.a),
    roots AS (SELECT scope, node, scope || chr(31) || min(other) AS root FROM reach GROUP BY scope, node),
    grouped AS (SELECT facts.*, root FROM facts JOIN roots ON facts.scope = roots.scope AND facts.entity_name = roots.node)"""


@query(f"WITH {FACTS} SELECT id, type, confidence, summary FROM facts WHERE type IN ('CHARACTER_AGE', 'CHARACTER_APPEARANCE') AND confidence >= 0.5")
def fact_filter(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.where(F.col("type").isin("CHARACTER_AGE", "CHARACTER_APPEARANCE") & (F.col("confidence") >= 0.5)).select("id", "type", "confidence", "summary")


@query(f"WITH RECURSIVE {FACTS}, {_ROOTS} SELECT id, root FROM grouped")
def entity_components(spark, sf_dir):
    return entities.entity_groups(facts(spark, sf_dir)).select("id", "root")


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS},
    names AS (SELECT root, name, sum(n) AS n FROM (SELECT root, entity_name AS name, 1 AS n FROM grouped UNION ALL SELECT root, candidate, 0 FROM grouped WHERE candidate IS NOT NULL) GROUP BY root, name),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, length(name), name) AS r FROM names)
    SELECT root, max(name) FILTER (r = 1) AS canonical_name, coalesce(string_agg(name, ',' ORDER BY name) FILTER (r > 1), '') AS aliases FROM ranked GROUP BY root"""
)
def canonical_name(spark, sf_dir):
    named = entities.canonical_names(entities.entity_groups(facts(spark, sf_dir)))
    return named.select("root", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


_SEGMENTS = """ordered AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY chapter_index, id) AS i FROM grouped),
    steps AS (
        SELECT root, i, id, 1::BIGINT AS version, timeline_hint AS hint,
               CASE WHEN type = 'CHARACTER_AGE' THEN summary END AS age, CASE WHEN type = 'CHARACTER_APPEARANCE' THEN summary END AS look, CASE WHEN type = 'CHARACTER_PERSONALITY' THEN summary END AS trait
        FROM ordered WHERE i = 1
        UNION ALL
        SELECT root, i, id, CASE WHEN fresh THEN version + 1 ELSE version END, CASE WHEN fresh THEN timeline_hint ELSE coalesce(timeline_hint, hint) END,
               CASE WHEN type = 'CHARACTER_AGE' THEN summary WHEN NOT fresh THEN age END, CASE WHEN type = 'CHARACTER_APPEARANCE' THEN summary WHEN NOT fresh THEN look END, CASE WHEN type = 'CHARACTER_PERSONALITY' THEN summary WHEN NOT fresh THEN trait END
        FROM (SELECT o.root, o.i, o.id, o.type, o.summary, o.timeline_hint, s.version, s.hint, s.age, s.look, s.trait,
                     coalesce(o.type = 'CHARACTER_PLOT_CHANGE' OR o.timeline_hint <> s.hint OR (o.type = 'CHARACTER_AGE' AND o.summary <> s.age)
                     OR (o.confidence >= 0.5 AND ((o.type = 'CHARACTER_APPEARANCE' AND o.summary <> s.look) OR (o.type = 'CHARACTER_PERSONALITY' AND o.summary <> s.trait))), FALSE) AS fresh
              FROM steps s JOIN ordered o ON o.root = s.root AND o.i = s.i + 1))"""


@query(f"WITH RECURSIVE {FACTS}, {_ROOTS}, {_SEGMENTS} SELECT id, version FROM steps")
def version_segments(spark, sf_dir):
    return entities.version_segments(entities.entity_groups(facts(spark, sf_dir))).select("id", "version")


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS}, {_SEGMENTS}, f AS (SELECT g.*, version FROM grouped g JOIN steps USING (id)),
    looks AS (SELECT root, version, summary, min(struct_pack(c := chapter_index, i := id)) AS seen FROM f WHERE type = 'CHARACTER_APPEARANCE' GROUP BY ALL),
    told AS (SELECT root, version, string_agg(summary, ' ' ORDER BY seen) AS appearance FROM looks GROUP BY ALL)
    SELECT root, version, arg_max(summary, struct_pack(c := chapter_index, i := id)) FILTER (type = 'CHARACTER_AGE') AS age,
           coalesce(any_value(appearance), 'No reliable appearance facts extracted yet.') AS appearance, min(chapter_index) AS start_chapter, max(chapter_index) AS end_chapter,
           round(avg(confidence), 9) AS confidence, count(*) AS n_facts
    FROM f LEFT JOIN told USING (root, version) GROUP BY root, version"""
)
def character_versions(spark, sf_dir):
    made = entities.merge_characters(facts(spark, sf_dir), digits=9)["versions"]
    return made.select("root", "version", "age", "appearance", "start_chapter", "end_chapter", "confidence", F.size("source_fact_ids").cast("long").alias("n_facts"))


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS} SELECT root, type, count(DISTINCT summary) AS n_values, string_agg(id || '=' || summary, ',' ORDER BY chapter_index, id) AS said
    FROM grouped WHERE type IN ('CHARACTER_AGE', 'CHARACTER_APPEARANCE', 'CHARACTER_PERSONALITY') GROUP BY root, type HAVING count(DISTINCT summary) > 1"""
)
def attribute_conflicts(spark, sf_dir):
    found = entities.attribute_conflicts(entities.entity_groups(facts(spark, sf_dir)))
    said = F.array_join(F.transform("facts", lambda x: F.concat(x["fact_id"].cast("string"), F.lit("="), x["value"])), ",")
    return found.select("root", "type", "n_values", said.alias("said"))


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS}, n AS (SELECT root, parent_name, count(*) AS n, min(struct_pack(c := chapter_index, i := id)) AS seen FROM grouped GROUP BY ALL)
    SELECT root, parent_name, n_parents FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, seen) AS r, count(*) OVER (PARTITION BY root) AS n_parents FROM n) WHERE r = 1"""
)
def location_parents(spark, sf_dir):
    found = entities.location_parents(entities.entity_groups(facts(spark, sf_dir)))
    return found.select("root", "parent_name", F.col("n_parents").cast("long").alias("n_parents"))


@query("WITH n AS (SELECT DISTINCT p_name AS name, p_type AS root FROM part), k AS (SELECT DISTINCT root, '=' || lower(name) AS key FROM n UNION SELECT DISTINCT root, '~' || string_split(lower(name), ' ')[-1] FROM n) SELECT DISTINCT a.root AS left_root, b.root AS right_root FROM k a JOIN k b USING (key) WHERE a.root < b.root")
def possible_duplicates(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.lit("p").alias("scope"), F.col("p_type").alias("root"), F.col("p_name").alias("name")).distinct()
    return entities.possible_duplicates(names).select("left_root", "right_root")


# ------------------------------------------------------------------ timeline


def planned(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("scope", F.col("entity_name"))
    hint = T.classify_marker(F.when(F.col("k") % 6 == 0, "the Next Day").when(F.col("k") % 6 == 1, "in his childhood").when(F.col("k") % 6 == 2, "a year later").when(F.col("k") % 6 == 3, "Before dawn").when(F.col("k") % 6 == 4, "после обеда").otherwise("some day"))
    f = f.withColumns({"title": F.concat("type", F.lit(" "), (F.col("k") % 5).cast("string")), "description": F.when(F.col("k") % 2 == 0, F.col("summary")), "hint": hint, "absolute_date": F.when(F.col("k") % 9 == 0, F.to_date("created_at"))})
    f = f.withColumn("anchor_title", F.when(F.col("k") % 4 == 0, F.concat(F.col("type"), F.lit(" 1"))))
    f = f.withColumn("character_names", F.array("entity_name", F.concat(F.lit(" n"), F.col("k") % 3))).withColumn("source_chunk_ids", F.array(F.concat(F.lit("c"), F.col("id") % 2)))
    f = f.withColumn("period_name", F.when(F.col("k") % 5 == 3, F.concat(F.lit("p"), F.col("k") % 7)))
    return timeline.planned_events(f)


PLANNED = f"""{FACTS}, planned AS (SELECT *, chapter_index * 1000 + seq AS own FROM (SELECT *, entity_name AS who, type || ' ' || (k % 5) AS title, CASE WHEN k % 2 = 0 THEN summary END AS description,
    CASE k % 6 WHEN 0 THEN 'next_day' WHEN 1 THEN 'childhood' WHEN 2 THEN 'year_later' WHEN 3 THEN 'before' WHEN 4 THEN 'after' WHEN 5 THEN 'unknown' END AS hint, CASE WHEN k % 4 = 0 THEN type || ' 1' END AS anchor_title,
    CASE WHEN k % 9 = 0 THEN CAST(created_at AS DATE) END AS absolute_date,
    row_number() OVER (PARTITION BY entity_name ORDER BY chapter_index, created_at, id) - 1 AS seq FROM facts))"""
_MERGED = """w AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY seq) AS i FROM planned WINDOW g AS (PARTITION BY who, chapter_index, title)),
    merged AS (SELECT who AS scope, chapter_index, title, arg_min(description, seq) FILTER (description IS NOT NULL) AS description, min(seq) AS seq, min(own) AS own,
               arg_max(hint, seq) FILTER (hint IS NOT NULL) AS hint, arg_max(anchor_title, seq) FILTER (anchor_title IS NOT NULL) AS anchor_title, (array_agg(absolute_date ORDER BY seq))[1] AS absolute_date,
               string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq) AS source_facts, arg_max('p' || (k % 7), seq) FILTER (k % 5 = 3) AS period_name, list(who || ',n' || (k % 3) ORDER BY seq) AS ns, list('c' || (id % 2) ORDER BY seq) AS cs, round(sum(confidence * pow(0.5, CASE WHEN i = 1 THEN n - 1 ELSE n - i + 1 END)), 12) AS confidence
               FROM w GROUP BY who, chapter_index, title)"""


_FIRSTS = "array_to_string(list_transform(list_sort(list_transform(list_distinct({c}), lambda x: struct_pack(p := list_position({c}, x), v := x))), lambda x: x.v), ',')"


@query(
    f"""WITH {PLANNED}, {_MERGED}, split AS (SELECT *, string_split(array_to_string(ns, ','), ',') AS nn FROM merged)
    SELECT scope, chapter_index, title, description, source_facts, confidence, hint, period_name, {_FIRSTS.format(c="nn")} AS names, {_FIRSTS.format(c="cs")} AS chunks FROM split"""
)
def event_merge(spark, sf_dir):
    m = timeline.merge_events(planned(spark, sf_dir), digits=12)
    return m.select("scope", "chapter_index", "title", "description", F.array_join(F.transform("source_fact_ids", lambda x: x.cast("string")), ",").alias("source_facts"), "confidence", "hint", "period_name", F.array_join("character_names", ",").alias("names"), F.array_join("source_chunk_ids", ",").alias("chunks"))


@query(
    f"""WITH RECURSIVE {PLANNED}, {_MERGED}, o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY absolute_date ASC NULLS LAST, own, seq) - 1 AS i FROM merged),
    a AS (SELECT o.scope, o.i, o.own, o.seq, o.title, CASE o.hint WHEN 'childhood' THEN -1000000 WHEN 'before' THEN -100 WHEN 'after' THEN 50 WHEN 'next_day' THEN 10 WHEN 'year_later' THEN 365 ELSE 0 END AS w, max(p.i) AS anchor
          FROM o LEFT JOIN o p ON p.scope = o.scope AND p.i < o.i AND lower(p.title) = lower(o.anchor_title) GROUP BY ALL),
    walk AS (SELECT scope, i, seq, title, own + w + i AS pos, [own + w + i] AS orders FROM a WHERE i = 0
             UNION ALL SELECT a.scope, a.i, a.seq, a.title, coalesce(list_extract(orders, CAST(anchor + 1 AS BIGINT)), a.own) + a.w + a.i, list_append(orders, coalesce(list_extract(orders, CAST(anchor + 1 AS BIGINT)), a.own) + a.w + a.i)
             FROM walk JOIN a ON a.scope = walk.scope AND a.i = walk.i + 1)
    SELECT scope, seq, title, CAST(pos AS BIGINT) AS relative_order FROM walk"""
)
def relative_order(spark, sf_dir):
    return timeline.assign_order(timeline.merge_events(planned(spark, sf_dir))).select("scope", F.col("seq").cast("long").alias("seq"), "title", "relative_order")


@query(f"WITH {PLANNED} SELECT * FROM (SELECT who AS scope, id, lead(id) OVER (PARTITION BY who ORDER BY own, chapter_index, id) AS next_id FROM planned) WHERE next_id IS NOT NULL")
def event_adjacency(spark, sf_dir):
    return timeline.adjacent(planned(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS}, {_SEGMENTS}, f AS (SELECT g.*, version FROM grouped g JOIN steps USING (root, id)),
    v AS (SELECT root, version, list(id) AS ids, list(lower(timeline_hint)) FILTER (timeline_hint IS NOT NULL) AS hints,
          CASE WHEN version % 2 = 0 THEN 'child of ' ELSE '' END || coalesce(arg_max(summary, struct_pack(c := chapter_index, i := id)) FILTER (type = 'CHARACTER_AGE'), '') AS age FROM f GROUP BY root, version),
    q AS (SELECT id, root, CASE WHEN id % 100 = 0 THEN id ELSE -1 END AS fact, CASE id % 3 WHEN 0 THEN 'H' || (id % 10) WHEN 1 THEN 'v' || (id % 4) ELSE '' END AS period, CASE WHEN id % 4 = 2 THEN 'childhood' END AS hint FROM grouped WHERE id % 50 = 0),
    s AS (SELECT q.id AS event_id, root, version, CASE WHEN list_contains(ids, fact) THEN 100 ELSE 0 END + CASE WHEN period <> '' AND len(list_filter(hints, lambda h: contains(h, lower(period)))) > 0 THEN 30 ELSE 0 END
          + CASE WHEN period <> '' AND contains(age, lower(period)) THEN 20 ELSE 0 END + CASE WHEN hint = 'childhood' AND contains(age, 'child') THEN 20 ELSE 0 END AS score FROM q JOIN v USING (root))
    SELECT event_id, root, version, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, version) AS r FROM s) WHERE r = 1"""
)
def version_match_top1(spark, sf_dir):
    """Queries are the facts whose id is divisible by 50, against all versions."""
    groups = materialize(entities.entity_groups(facts(spark, sf_dir)), "groups")
    versions = entities.character_versions(entities.version_segments(groups))
    age = F.concat(F.when(F.col("version") % 2 == 0, "child of ").otherwise(""), F.coalesce("age", F.lit("")))
    versions = versions.select("root", "version", age.alias("age"), "hints", "source_fact_ids")
    i = F.col("id")
    period = F.when(i % 3 == 0, F.concat(F.lit("H"), i % 10)).when(i % 3 == 1, F.concat(F.lit("v"), i % 4)).otherwise("")
    own = F.array(F.when(i % 100 == 0, i).otherwise(-1))
    events = groups.where(i % 50 == 0).select(i.alias("event_id"), "root", own.alias("event_fact_ids"), period.alias("period_name"), F.when(i % 4 == 2, "childhood").alias("hint"))
    return timeline.best_versions(events, versions)


# ------------------------------------------------------------------ graph


def _graph(spark, sf_dir):
    t = lambda name: read(spark, sf_dir, name)
    key = lambda label, c: graph.graph_key(F.lit("p"), label, c)
    node = lambda name, label, i, text: t(name).select(key(label, i).alias("key"), F.lit(label).alias("label"), F.col(text).alias("name"))
    nodes = graph.nodes(node("region", "Region", "r_regionkey", "r_name"), node("nation", "Nation", "n_nationkey", "n_name"), node("customer", "Customer", "c_custkey", "c_name"), node("supplier", "Supplier", "s_suppkey", "s_name"))
    edge = lambda name, a, kind, b: t(name).select(key(*a).alias("source"), F.lit(kind).alias("type"), key(*b).alias("target"))
    edges = graph.edges(
        nodes,
        edge("nation", ("Nation", "n_nationkey"), "PART_OF", ("Region", "n_regionkey")),
        edge("customer", ("Customer", "c_custkey"), "LIVES_IN", ("Nation", "c_nationkey")),
        edge("supplier", ("Supplier", "s_suppkey"), "LIVES_IN", ("Nation", "s_nationkey")),
        edge("orders", ("Customer", "o_custkey"), "ORDERED", ("Order", "o_orderkey")),
    )
    return nodes, edges


_GRAPH = """nodes AS (SELECT 'p:Region:' || r_regionkey AS key, 'Region' AS label, r_name AS name FROM region UNION SELECT 'p:Nation:' || n_nationkey, 'Nation', n_name FROM nation
    UNION SELECT 'p:Customer:' || c_custkey, 'Customer', c_name FROM customer UNION SELECT 'p:Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier),
    edges AS (SELECT 'p:Nation:' || n_nationkey AS source, 'PART_OF' AS type, 'p:Region:' || n_regionkey AS target FROM nation UNION SELECT 'p:Customer:' || c_custkey, 'LIVES_IN', 'p:Nation:' || c_nationkey FROM customer
    UNION SELECT 'p:Supplier:' || s_suppkey, 'LIVES_IN', 'p:Nation:' || s_nationkey FROM supplier)"""


@query(f"WITH {_GRAPH} SELECT * FROM nodes")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def graph_edges(spark, sf_dir):
    """Edges to orders have no node there and are left out."""
    return _graph(spark, sf_dir)[1]


@query(
    f"""WITH {_GRAPH}, b AS (SELECT source AS key, target AS next FROM edges UNION SELECT target, source FROM edges), seeds AS (SELECT 'p:Supplier:' || s_suppkey AS key FROM supplier WHERE s_suppkey % 50 = 0),
    one AS (SELECT seeds.key AS seed, next AS key FROM seeds JOIN b USING (key)), two AS (SELECT seed, next AS key FROM one JOIN b USING (key))
    SELECT key AS seed, key FROM seeds UNION SELECT * FROM one UNION SELECT * FROM two"""
)
def neighbourhood_2hop(spark, sf_dir):
    """Queries are the suppliers whose key is divisible by 50."""
    seeds = read(spark, sf_dir, "supplier").where("s_suppkey % 50 = 0").select(graph.graph_key(F.lit("p"), "Supplier", "s_suppkey").alias("key"))
    return graph.neighbourhood(_graph(spark, sf_dir)[1], seeds)


@query("SELECT n_nationkey AS id, r_name || ' > ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1000 + r_regionkey, r_name FROM region")
def hierarchy_chain(spark, sf_dir):
    regions = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).alias("parent_id"))
    return graph.ancestry(regions.union(nations)).select("id", F.array_join("path", " > ").alias("path"))


# ------------------------------------------------------------------ vectors

SEARCH = "the thing and with that this from Pfhe scheit"


def _features_sql(table: str, key: str) -> str:
    """Sparse embeddings over DuckDB's tokens."""
    return f"""t AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS token FROM {table}) WHERE length(token) > 1 GROUP BY ALL),
    d AS (SELECT {key}, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 256 AS dim, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END * n * ln(1 + length(token)) AS w FROM t),
    s AS (SELECT {key}, dim, sum(w) AS w FROM d GROUP BY ALL), f AS (SELECT {key}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM s)"""


@query(f"WITH {_features_sql('benchmark', 'item_id')} SELECT item_id, dim, round(weight, 6) AS weight FROM f WHERE abs(weight) > 1e-9")
def hash_embedding(spark, sf_dir):
    f = vectors.hash_features(read(spark, sf_dir, "benchmark"), "item_id", "text")
    return f.where(F.abs("weight") > 1e-9).select("item_id", "dim", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{SEARCH}'), {_features_sql("docs", "doc_id")}
    SELECT a.doc_id, round(sum(a.weight * b.weight), 6) AS score FROM f a JOIN f b ON a.dim = b.dim AND b.doc_id = -1 WHERE a.doc_id >= 0 GROUP BY a.doc_id ORDER BY round(sum(a.weight * b.weight), 9) DESC, a.doc_id LIMIT 10"""
)
def semantic_search(spark, sf_dir):
    return vectors.search_text(read(spark, sf_dir, "documents"), SEARCH, "doc_id").withColumn("score", F.round("score", 6))


_QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]


@query(f"SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}::DOUBLE[]), 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf_dir):
    return vectors.search_vectors(read(spark, sf_dir, "embeddings"), _QUERY_VECTOR, 20, label=[1, 2, 3]).withColumn("score", F.round("score", 6))


@query(
    """SELECT 'document' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'item', item_id, length(text) FROM benchmark UNION ALL SELECT 'page', page_id, length(html) FROM pages UNION ALL SELECT 'event', event_id, length(event_type) FROM events UNION ALL SELECT 'place', n_nationkey, length(n_name) FROM nation"""
)
def points_union(spark, sf_dir):
    row = lambda name, kind, key, text: read(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.length(text).cast("long").alias("n"))
    return row("documents", "document", "doc_id", "text").unionByName(row("benchmark", "item", "item_id", "text")).unionByName(row("pages", "page", "page_id", "html")).unionByName(row("events", "event", "event_id", "event_type")).unionByName(row("nation", "place", "n_nationkey", "n_name"))


# ------------------------------------------------------------------ scenes

_SCENE = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _labels(spark, sf_dir):
    """Entities: the first two words of each benchmark item, the third word as an alias."""
    w = F.split(T.scene_text(F.col("text")), " ")
    b = read(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    name = b.select(F.col("item_id").alias("entity_id"), F.array_join(F.slice("w", 1, 2), " ").alias("label"), F.lit(True).alias("is_name"))
    return name.union(b.where(F.size("w") > 2).select("item_id", F.get("w", F.lit(2)), F.lit(False)))


def _stem_sql(c: str) -> str:
    arms = " ".join(f"WHEN length({c}) > {len(s) + 3} AND ends_with({c}, '{s}') THEN left({c}, -{len(s)})" for s in T.STEM_SUFFIXES)
    return f"CASE {arms} ELSE {c} END"


_MATCHES = f"""items AS (SELECT item_id, string_split({_SCENE.format(c="text")}, ' ') AS w FROM benchmark),
    labels AS (SELECT item_id AS entity_id, array_to_string(w[1:2], ' ') AS label, TRUE AS is_name FROM items UNION ALL SELECT item_id, w[3], FALSE FROM items WHERE len(w) > 2),
    texts AS (SELECT doc_id, {_SCENE.format(c="text")} AS t FROM documents), stems AS (SELECT doc_id, list({_stem_sql("x")}) AS s FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS x FROM texts) GROUP BY doc_id),
    hits AS (SELECT doc_id, entity_id, label, is_name, CASE WHEN contains(' ' || t || ' ', ' ' || label || ' ') THEN CASE WHEN is_name THEN 1.0::DOUBLE ELSE 1.05::DOUBLE END
             WHEN NOT contains(label, ' ') AND list_contains(s, {_stem_sql("label")}) THEN CASE WHEN is_name THEN 0.92::DOUBLE ELSE 0.97::DOUBLE END END AS score
             FROM texts JOIN stems USING (doc_id), labels WHERE label <> ''),
    best AS (SELECT doc_id, entity_id, max(score) AS score, arg_max(label, struct_pack(a := score, b := is_name, c := label)) AS matched FROM hits WHERE score IS NOT NULL GROUP BY ALL)"""


@query(
    f"""WITH {_MATCHES}, m AS (SELECT *, max(score) OVER (PARTITION BY doc_id, matched) AS top FROM best),
    n AS (SELECT *, score >= top - 0.08 AS near, count(*) FILTER (score >= top - 0.08) OVER (PARTITION BY doc_id, matched) AS c FROM m)
    SELECT doc_id, entity_id, matched, score, CASE WHEN NOT near THEN 'other' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM n"""
)
def entity_resolution(spark, sf_dir):
    m = scenes.resolve_mentions(scenes.entity_matches(read(spark, sf_dir, "documents"), _labels(spark, sf_dir)))
    return m.select("doc_id", "entity_id", "matched", "score", "status")


@query(
    rf"""WITH items AS (SELECT item_id, {_SCENE.format(c="text")} AS t FROM benchmark), known AS (SELECT DISTINCT item_id, {_stem_sql("x")} AS s FROM (SELECT item_id, unnest(string_split(t, ' ')[1:5]) AS x FROM items)),
    mentions AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}[\p{{L}}\p{{N}}-]+(?:\s+\p{{Lu}}[\p{{L}}\p{{N}}-]+)*)', 1)) AS mention FROM benchmark),
    w AS (SELECT item_id, mention, unnest(string_split({_SCENE.format(c="mention")}, ' ')) AS x FROM mentions)
    SELECT DISTINCT item_id, mention FROM w WHERE x <> '' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.item_id = w.item_id AND k.s = {_stem_sql("w.x")})"""
)
def capitalized_suggestions(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    known = b.select("item_id", F.array_join(F.slice(F.split(T.scene_text(F.col("text")), " "), 1, 5), " ").alias("label"))
    return scenes.create_suggestions(b, known, "item_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def missing_references(spark, sf_dir):
    approved = read(spark, sf_dir, "labels").where("quality = 1")
    return scenes.missing_references(read(spark, sf_dir, "documents").select("doc_id"), approved, "doc_id")


@query(
    """WITH c AS (SELECT user_id AS asset_id, CASE WHEN event_type = 'view' THEN 'character' ELSE event_type END AS type, event_type <> 'error' AS passed, least(1.0, greatest(0.0, value / 50)) AS s FROM events),
    a AS (SELECT asset_id, floor(avg(s) * 100 + 0.5) / 100 AS score, bool_and(passed) AS all_passed, bool_or(type = 'character' AND NOT passed) AS character_failed FROM c GROUP BY asset_id)
    SELECT asset_id, score, all_passed, CASE WHEN score >= 0.82 AND all_passed THEN 'approve' WHEN score < 0.45 THEN 'regenerate' WHEN character_failed THEN 'inpaint' ELSE 'manual_review' END AS recommendation FROM a"""
)
def validation_aggregate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    checks = e.select(F.col("user_id").alias("asset_id"), F.when(F.col("event_type") == "view", "character").otherwise(F.col("event_type")).alias("type"), (F.col("event_type") != "error").alias("passed"), (F.col("value") / 50).alias("score"))
    return scenes.validate(checks).select("asset_id", "score", "all_passed", "recommendation")


@query("SELECT conv_id, max(turn) + 1 AS next_index FROM conversations GROUP BY conv_id")
def max_plus_one(spark, sf_dir):
    return scenes.next_order_index(read(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def take_one_newest(spark, sf_dir):
    return scenes.newest(read(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_brand FROM part")
def patch_coalesce(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    changes = part.where("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    return entities.patch(part, changes, "p_partkey")


@query(
    f"""WITH RECURSIVE {_LINES_SQL}, {_RANGES_SQL}, {_CHUNKS_SQL}, c AS (SELECT doc_id, {_UUID_SQL} AS chunk_id, text FROM hashed),
    f AS (SELECT DISTINCT doc_id, chunk_id, 'character' AS family, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b')) AS entity_name FROM c
          UNION ALL SELECT DISTINCT doc_id, chunk_id, 'location', unnest(regexp_extract_all(text, '\\b(?:in|at) ([A-Z][a-z]+)\\b', 1)) FROM c)
    SELECT chunk_id, doc_id, family, upper(family) || '_MENTION' AS type, entity_name, lower(entity_name) AS summary, 0.5::DOUBLE AS confidence FROM f"""
)
def llm_extract_mock(spark, sf_dir):
    from fabula.operators.extraction import RuleProvider, extract_facts

    made = books.chunks(titled_books(spark, sf_dir), target=1800, overlap=200)
    return extract_facts(made, RuleProvider(), ("character", "location", "timeline")).select("chunk_id", "doc_id", "family", "type", "entity_name", "summary", "confidence")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey % 97 AS b FROM orders), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM x UNION SELECT r.node, x.b FROM r JOIN x ON r.other = x.a) SELECT node, min(other) AS root FROM r GROUP BY node")
def connected_components(spark, sf_dir):
    return components.components(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") % 97).alias("b")))


# ------------------------------------------------------------------ more of facts, prompts and scopes


@query(
    f"""WITH RECURSIVE {FACTS}, {_ROOTS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY chapter_index, id) AS i FROM grouped),
    steps AS (SELECT root, i, id, 1::BIGINT AS version, timeline_hint AS hint, era AS age FROM ordered WHERE i = 1
        UNION ALL SELECT root, i, id, CASE WHEN fresh THEN version + 1 ELSE version END, CASE WHEN fresh THEN th ELSE coalesce(th, hint) END, CASE WHEN fresh THEN era ELSE coalesce(era, age) END
        FROM (SELECT o.root, o.i, o.id, o.timeline_hint AS th, o.era, s.version, s.hint, s.age, coalesce(o.timeline_hint <> s.hint, FALSE) OR coalesce(o.era <> s.age, FALSE) AS fresh
              FROM steps s JOIN ordered o ON o.root = s.root AND o.i = s.i + 1)),
    f AS (SELECT g.*, version FROM grouped g JOIN steps USING (id)),
    said AS (SELECT root, version, string_agg(summary, ' ' ORDER BY seen) AS description FROM (SELECT root, version, summary, min(struct_pack(c := chapter_index, i := id)) AS seen FROM f GROUP BY ALL) GROUP BY ALL)
    SELECT root, version, any_value(description) AS description, arg_max(era, struct_pack(c := chapter_index, i := id)) FILTER (era IS NOT NULL) AS era, round(avg(confidence), 9) AS confidence, count(*) AS n_facts
    FROM f JOIN said USING (root, version) GROUP BY root, version"""
)
def location_versions(spark, sf_dir):
    segmented = entities.version_segments(entities.entity_groups(facts(spark, sf_dir)), "location")
    made = entities.location_versions(segmented, digits=9)
    return made.select("root", "version", "description", "era", "confidence", F.size("source_fact_ids").cast("long").alias("n_facts"))


@query(f"WITH {FACTS} SELECT scope, entity_name, string_agg(summary, ',' ORDER BY seen) AS summaries FROM (SELECT scope, entity_name, summary, min(struct_pack(c := chapter_index, i := id)) AS seen FROM facts GROUP BY ALL) GROUP BY ALL")
def ordered_distinct_list(spark, sf_dir):
    f = facts(spark, sf_dir).groupBy("scope", "entity_name").agg(entities.ordered_distinct(F.col("summary")).alias("summaries"))
    return f.select("scope", "entity_name", F.array_join("summaries", ",").alias("summaries"))


@query(f"WITH {FACTS} SELECT entity_name, arg_max(era, struct_pack(c := chapter_index, i := id)) FILTER (era IS NOT NULL) AS era FROM facts GROUP BY entity_name")
def latest_value(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("entity_name").agg(entities.latest(F.col("era")).alias("era"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'KNOWS' WHEN 'view' THEN 'LOVES' WHEN 'click' THEN 'HATES' WHEN 'error' THEN 'RELATED_TO' END AS label FROM events")
def relation_labels(spark, sf_dir):
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "MENTOR"), ("view", "ROMANTIC"), ("click", "RIVAL"), ("error", "FAMILY"), ("purchase", "?")) for x in p]), F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", graph.relation_label(kind).alias("label"))


@query("SELECT p_partkey, 'Draw ' || p_name || ' of ' || p_brand || ', {{ missing }}' || chr(10) || p_type AS prompt FROM part")
def prompt_render(spark, sf_dir):
    head = prompts.render("Draw {{name}} of {{ brand }}, {{ missing }}", name=F.col("p_name"), brand=F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", prompts.lines(head, F.lit(""), F.col("p_type")).alias("prompt"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'bolt') THEN 'cold' END AS style, p_name AS subject FROM part")
def style_match(spark, sf_dir):
    presets = spark.createDataFrame([(1, "warm", "red"), (2, "cold", "blue"), (3, "cold", "bolt")], "rank int, style string, trigger string")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Style of "), F.col("p_name")).alias("text"))
    return prompts.abstract_styles(rows, presets, "p_partkey").drop("avoided")


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'PENDING' WHEN quality = 1 THEN 'APPROVED' ELSE 'REJECTED' END AS status, CASE WHEN l.doc_id IS NULL THEN 'DRAFT' WHEN quality = 1 THEN 'REFERENCE' ELSE 'GENERATED' END AS type
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def approval_transition(spark, sf_dir):
    assets = read(spark, sf_dir, "documents").select("doc_id", F.lit("PENDING").alias("status"), F.lit("DRAFT").alias("type"))
    decided = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "APPROVED").otherwise("REJECTED").alias("status"))
    return scenes.approve(assets, decided, "doc_id")


@query(
    """WITH s AS (SELECT o_custkey AS scope, 1 AS rank, o_orderkey AS position, o_orderkey % 7 AS id FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, 2, o_orderkey, o_orderkey % 5 FROM orders),
    f AS (SELECT scope, id, min(struct_pack(a := rank, b := position)) AS pos FROM s GROUP BY ALL) SELECT scope, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM f GROUP BY scope"""
)
def analysis_id_list(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    row = lambda rank, m: o.select(F.col("o_custkey").alias("scope"), F.lit(rank).alias("rank"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % m).alias("id"), "o_orderpriority")
    both = row(1, 7).where(F.col("o_orderpriority").startswith("1")).union(row(2, 5))
    return scenes.analysis_ids(both).select("scope", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
