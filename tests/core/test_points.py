from fabula.operators import points as P


def tables(spark, age="30", events=2):
    make = spark.createDataFrame
    return {
        "chunks": make([("p", "k1", "Book", 0, 1, "one"), ("p", "k2", "Book", 1, 2, None)], "project string, id string, book_title string, chapter_index int, order_index int, text string"),
        "characters": make([("p", "c", "Mara")], "project string, id string, canonical_name string"),
        "character_versions": make([("p", "v", "c", 1, age, {"x": "y"}), ("q", "w", "c", 1, "1", None)], "project string, id string, character_id string, version int, age string, appearance map<string,string>"),
        "events": make([("p", f"e{i}", f"Event {i}", "", 2, i) for i in range(events)] + [("q", "e", "Alone", None, 0, 0)], "project string, id string, title string, description string, chapter_index int, relative_order int"),
    }


def test_titles_and_texts(spark):
    got = {(r.project, r.entity_type, r.entity_id): (r.title, r.text) for r in P.project_points(tables(spark)).collect()}
    assert got["p", "BookChunk", "k1"] == ("Book chapter 0 chunk 1", "one") and got["p", "BookChunk", "k2"][1] == ""
    assert got["p", "CharacterVersion", "v"] == ("Mara v1", 'Mara\n30\n{"x":"y"}')
    assert got["p", "TimelineEvent", "e1"] == ("Event 1", "Event 1\nchapter:2\nrelativeOrder:1")
    assert len(got) == 6  # the version of q has no character


def test_only_what_changed_is_embedded(spark, tmp_path):
    store = str(tmp_path / "points")
    stored = lambda: {r.id: (r.text, tuple(r.vector)) for r in P.snapshots.snapshot(spark, store).table("points").collect()}
    assert P.sync_points(spark, store, P.project_points(tables(spark))) == {"embedded": 6, "removed": 0}
    before = stored()
    assert P.sync_points(spark, store, P.project_points(tables(spark))) == {"embedded": 0, "removed": 0}
    assert P.snapshots.snapshot(spark, store).number == 1
    assert P.sync_points(spark, store, P.project_points(tables(spark, "31", 1))) == {"embedded": 1, "removed": 1}
    after = stored()
    assert len(after) == 5 and sum(before.get(i) == x for i, x in after.items()) == 4 and all(len(v) == 256 for _, v in after.values())
    only_p = P.project_points(tables(spark, "31", 1)).where("project = 'p'")
    assert P.sync_points(spark, store, only_p) == {"embedded": 0, "removed": 0}  # q is not asked for
    assert P.sync_points(spark, store, only_p, spark.createDataFrame([("q",)], "project string")) == {"embedded": 0, "removed": 1}
    assert len(stored()) == 4
