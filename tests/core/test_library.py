import json
import re

from fabula.library import Library
from fabula.operators.ledger import Ledger


def provider():
    class Marked:
        """Facts in square brackets: ``[kind|name|value|other members as JSON]``."""

        def complete(self, text, family):
            facts = []
            for kind, name, value, more in re.findall(r"\[(\w+)\|([^|\]]*)\|([^|\]]*)\|?([^\]]*)\]", text):
                if kind.startswith(family.upper()):
                    value = {"title" if family == "timeline" else "summary": value} | json.loads(more or "{}")
                    facts.append({"type": kind, "entityName": name, "confidence": 0.75, "value": value})
            return json.dumps({"facts": facts})

    return Marked()


ONE = """Mara walks. [CHARACTER_AGE|Mara|30] [CHARACTER_APPEARANCE|Mara Lind|tall|{"candidateNames": "M"}] [LOCATION_MENTION|Old Square|a square|{"parentName": "City"}] [LOCATION_MENTION|City|big]
[TIMELINE_EVENT|start|The Meeting|{"characterNames": "C", "locationNames": "L"}] [TIMELINE_EVENT|later|The Parting|{"relativeMarker": "after the meeting", "anchorEventTitle": "The Meeting"}]"""
ONE = ONE.replace('{"candidateNames": "M"}', "{}").replace('{"characterNames": "C", "locationNames": "L"}', "{}")


def books(spark, *rows):
    return spark.createDataFrame(rows, "project string, book_id bigint, title string, text string")


def state(library):
    tables = {n: sorted(map(str, t.collect())) for n, t in library.tables().items()}
    nodes, edges = library.graph("p")
    return tables | {"nodes": sorted(map(str, nodes.collect())), "edges": sorted(map(str, edges.collect()))}


def test_from_books_to_search_and_scenes(spark, tmp_path):
    library = Library(spark, str(tmp_path / "library"), provider(), Ledger(f"file://{tmp_path}/ledger"))
    library.add(books(spark, ("p", 1, "First", ONE), ("q", 2, "Other", "[CHARACTER_MENTION|Mara|someone else]")))
    tables = library.tables()
    assert {r.canonical_name for r in tables["characters"].where("project = 'p'").collect()} == {"Mara", "Mara Lind"}
    places = {r.name: r for r in tables["locations"].collect()}
    assert places["Old Square"].parent_id == places["City"].id and places["City"].parent_id is None
    assert [r.title for r in library.timeline("p").collect()] == ["The Meeting", "The Parting"]
    nodes, edges = library.graph("p")
    assert {r.label for r in nodes.collect()} == {"Character", "CharacterVersion", "Location", "LocationVersion", "TimelineEvent"}
    assert {"VERSION_OF", "LOCATED_IN", "BEFORE", "AFTER"} <= {r.type for r in edges.collect()}
    top = library.search("p", "the parting", 3).collect()
    assert top[0].title == "The Parting" and library.search("q", "parting").count() == 0
    scene = spark.createDataFrame([("p", 1, "Mara at the old square"), ("q", 2, "Mara at the old square")], "project string, id int, text string")
    got = {(r.project, r.entity_type, r.matched, r.status) for r in library.resolve_scene(scene).collect()}
    assert got == {("p", "Character", "Mara", "resolved"), ("p", "Location", "Old Square", "resolved"), ("q", "Character", "Mara", "resolved")}


def test_adding_again_or_in_another_order_gives_the_same(spark, tmp_path):
    first, second = (Library(spark, str(tmp_path / n), provider()) for n in "ab")
    rows = [("p", 1, "First", ONE), ("p", 2, "Second", "[CHARACTER_AGE|Mara|31] and [CHARACTER_MENTION|Ilya|new]")]
    first.add(books(spark, *rows))
    want = state(first)
    second.add(books(spark, ("p", 1, "First", "[CHARACTER_MENTION|Wrong|x]"), rows[1]))
    assert state(second) != want
    second.add(books(spark, rows[0]))
    assert state(second) == want
    # a book that goes to another project takes its people along
    second.add(books(spark, ("q", 2, *rows[1][2:])))
    people = {(r.project, r.canonical_name) for r in second.tables()["characters"].collect()}
    assert ("q", "Ilya") in people and ("p", "Ilya") not in people
