from pyspark.sql import functions as F

from fabula.operators import project_graph as P


def world(spark, names=("Mara",)):
    """A project like that of a first sync: people, a square, two events, a scene; and rows that repeat."""
    make = spark.createDataFrame
    return {
        "projects": make([("p1", "p1", "Project", "b1", ["b1", "b2"]), ("p2", "p2", "Other", None, None)], "project string, id string, name string, book_id string, book_ids array<string>"),
        "books": make([("p1", "b1", "Book", "primary-book"), ("p1", "b2", "Next", "series-book")], "project string, id string, title string, role string"),
        "characters": make([("p1", "c1", n, [n[0]]) for n in names] + [("p1", "c2", "Ilya", []), ("p2", "c1", "Someone else", None)], "project string, id string, canonical_name string, aliases array<string>"),
        "character_versions": make([("p1", "v1", "c1", 1, None, 0.5), ("p1", "v2", "c1", 2, "30", 0.25), ("p1", "v3", "gone", 1, None, 1.0)], "project string, id string, character_id string, version int, age string, confidence_score double"),
        "locations": make([("p1", "l1", "Old Square", "l2"), ("p1", "l2", "City", None), ("p1", "l3", "Nowhere", "missing")], "project string, id string, name string, parent_id string"),
        "objects": make([("p1", "o1", "Clock", "c2", "l1"), ("p1", "o2", "Key", " ", None)], "project string, id string, name string, owner_character_id string, location_id string"),
        "events": make([("p1", "e2", "Second", 5, ["c1", "c2"], []), ("p1", "e1", "First", 1, ["c1"], ["l1", "none"]), ("p1", "e3", "Third", 5, None, ["l1"]), ("p2", "e1", "Alone", 0, ["c1"], None)], "project string, id string, title string, relative_order int, involved_character_ids array<string>, involved_location_ids array<string>"),
        "event_versions": make([("p1", "e1", "v1"), ("p1", "e1", "v1")], "project string, event_id string, character_version_id string"),
        "relationships": make([("p1", "r1", "c1", "c2", "ALLY", "friends", "1-2"), ("p1", "r2", "c1", "c2", "KNOWS", None, "3-4"), ("p1", "r3", "c2", "c1", "RIVAL", "x", None), ("p1", "r4", "c2", "c1", "NONSENSE", "x", None)], "project string, id string, source_character_id string, target_character_id string, type string, description string, timeline_range string"),
        "scenes": make([("p1", "s1", "Scene", "c1", "l1"), ("p1", "s2", "Empty", None, None)], "project string, id string, title string, character_id string, location_id string"),
    }


def told(edges):
    short = lambda k: k.split(":")[-1]
    return {(r.project, short(r.source), r.type, short(r.target)) for r in edges.collect()}


def test_nodes_and_edges_of_all_rules(spark):
    nodes, edges = P.project_graph(world(spark))
    found = {r.key: r.properties for r in nodes.collect()}
    assert found["p1:Character:c1"] == {"id": "c1", "canonicalName": "Mara", "aliases": '["M"]', "graphKey": "p1:Character:c1", "projectId": "p1", "label": "Character"}
    assert found["p2:Character:c1"]["canonicalName"] == "Someone else" and "aliases" not in found["p2:Character:c1"]
    assert found["p1:CharacterVersion:v2"]["confidenceScore"] == "0.25" and "age" not in found["p1:CharacterVersion:v1"]
    assert found["p1:Project:p1"]["bookIds"] == '["b1","b2"]' and len(found) == 21
    got = told(edges)
    related = {e for e in got if e[2] == "RELATED_TO"}
    assert len(related) == 16  # two books, and 12 entities of p1, two of p2
    assert got - related == {
        ("p1", "v1", "VERSION_OF", "c1"),
        ("p1", "v2", "VERSION_OF", "c1"),
        ("p1", "c1", "APPEARS_IN", "e1"),
        ("p1", "c1", "APPEARS_IN", "e2"),
        ("p1", "c2", "APPEARS_IN", "e2"),
        ("p2", "c1", "APPEARS_IN", "e1"),
        ("p1", "v1", "APPEARS_IN", "e1"),
        ("p1", "e1", "HAPPENS_AT", "l1"),
        ("p1", "e3", "HAPPENS_AT", "l1"),
        ("p1", "c1", "KNOWS", "c2"),
        ("p1", "c2", "HATES", "c1"),
        ("p1", "l1", "LOCATED_IN", "l2"),
        ("p1", "o1", "LOCATED_IN", "l1"),
        ("p1", "c2", "OWNS", "o1"),
        ("p1", "e1", "BEFORE", "e2"),
        ("p1", "e2", "BEFORE", "e3"),
        ("p1", "e2", "AFTER", "e1"),
        ("p1", "e3", "AFTER", "e2"),
        ("p1", "c1", "APPEARS_IN", "s1"),
        ("p1", "c1", "VISITS", "s1"),
        ("p1", "s1", "HAPPENS_AT", "l1"),
    }
    # the later statement sets what it knows, and takes away what it says is null
    assert edges.where("type = 'KNOWS'").first().properties == {"id": "r2", "timelineRange": "3-4", "projectId": "p1", "type": "KNOWS"}
    roles = {r.target: r.properties["role"] for r in edges.where("type = 'RELATED_TO'").collect()}
    assert roles["p1:Book:b1"] == "primary-book" and roles["p1:WorldObject:o1"] == "world-object"


def test_the_last_row_of_a_node_stays_whole_and_edges_merge_by_name(spark):
    make = spark.createDataFrame
    tables = {
        "a": make([("p", "x", 1, "first", "only here"), ("p", "x", 2, "second", None), ("p", "y", 1, "y", None)], "project string, id string, n int, name string, more string"),
        "b": make([("p", "x", "y", "later")], "project string, s string, t string, note string"),
        "c": make([("p", "x", "y", None, 7), ("p", "x", "y", 3, 8)], "project string, s string, t string, note int, n int"),
    }
    nodes = P.graph_nodes(tables, [P.Node("N", "a", {"name": "name", "more": "more"}, order=("n",))])
    x = {r.key: r.properties for r in nodes.collect()}["p:N:x"]
    assert x["name"] == "second" and "more" not in x
    rule = lambda table, properties: P.Edge(table, ("N", "s"), ("N", "t"), "R", properties=properties, order=("n",))
    made = P.graph_edges(tables, nodes, [rule("b", {"note": "note", "old": "note"}), rule("c", {"note": "note", "n": "n"})]).collect()
    assert [r.properties for r in made] == [{"note": "3", "old": "later", "n": "8", "projectId": "p", "type": "R"}]
    made = P.graph_edges(tables, nodes, [rule("c", {"note": "note"}), rule("b", {"old": "note"})]).collect()
    assert made[0].properties["note"] == "3" and made[0].properties["old"] == "later"


def test_a_stored_graph_updated_twice_is_the_same(spark, tmp_path):
    store = str(tmp_path / "graph")
    read = lambda: [sorted((str(r) for r in df.collect())) for df in P.stored_graph(spark, store)]
    P.sync_projects(spark, store, world(spark))
    once = read()
    P.sync_projects(spark, store, world(spark))
    assert read() == once
    # another name replaces the node, a project without rows goes, the other stays
    only = {t: df.where("project = 'p1'") for t, df in world(spark, ("Mira",)).items()}
    P.sync_projects(spark, store, only)
    nodes, edges = P.stored_graph(spark, store)
    assert nodes.where(F.col("properties")["canonicalName"] == "Mira").count() == 1 and nodes.where(F.col("properties")["canonicalName"] == "Mara").count() == 0
    assert nodes.where("project = 'p2'").count() == 3
    P.sync_projects(spark, store, only, spark.createDataFrame([("p1",), ("p2",)], "project string"))
    assert {r.project for r in P.stored_graph(spark, store)[0].collect()} == {"p1"}


def test_events_of_one_project_in_many_ranges(spark):
    events = spark.createDataFrame([("p", f"e{i:03}", i // 3, i % 2) for i in range(300)] + [("q", "z", 1, 1)], "project string, id string, relative_order int, chapter_index int").repartition(5)
    got = {r.id: r.before for r in P.event_order(events, ranges=8).collect()}
    order = sorted(range(300), key=lambda i: (i // 3, i % 2, i))
    assert got == {"z": None} | {f"e{i:03}": f"e{order[k - 1]:03}" if k else None for k, i in enumerate(order)}


def test_edges_of_long_lists_do_not_carry_the_lists(spark):
    """Shuffled bytes grow with the elements of a list, not with their square."""
    n = 2000
    people = spark.range(n).select(F.lit("p").alias("project"), F.concat(F.lit("c"), "id").alias("id"))
    events = spark.range(4).select(F.lit("p").alias("project"), F.concat(F.lit("e"), "id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("involved_character_ids"))
    nodes = people.select(F.concat(F.lit("p:Character:"), "id").alias("key")).union(events.select(F.concat(F.lit("p:TimelineEvent:"), "id")))
    rules = [e for e in P.EDGES if e.source == ("Character", "involved_character_ids")]
    edges = P.graph_edges({"events": events, "_adjacent": events}, nodes, rules)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 4 * n and "json" not in plan.lower()
    assert edges.first().properties == {"projectId": "p", "type": "APPEARS_IN"}


def test_labels_of_one_rule_are_exchanged_once(spark):
    make = spark.createDataFrame
    tables = {"a": make([("p", "x", "A")], "project string, id string, name string"), "b": make([("p", "x", "B")], "project string, id string, name string"), "c": make([("p", "x", "C")], "project string, id string, name string")}
    nodes = lambda *rules: P.graph_nodes(tables, [P.Node(label, t, {"name": "name"}) for label, t in rules])
    apart = nodes(("N", "a"), ("M", "b"))
    assert apart._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {(r.key, r.properties["name"]) for r in apart.collect()} == {("p:N:x", "A"), ("p:M:x", "B")}
    both = nodes(("N", "a"), ("M", "b"), ("N", "c"))
    assert {(r.key, r.properties["name"]) for r in both.collect()} == {("p:N:x", "C"), ("p:M:x", "B")}


def test_nodes_make_no_tables_of_edges(spark, monkeypatch):
    from fabula.plans import world as W

    written, write = [], W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    assert W.project_nodes(spark, "/root/testdata/sf0.001").count() > 0
    assert "world-relationships" not in written and "world-event_versions" not in written
    assert written.count("merged") == 1 and len(written) == len(set(written))
