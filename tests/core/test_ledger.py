import json
import os
import threading
import time

import pytest
from pyarrow import fs

from fabula.operators import graph as G
from fabula.operators.extraction import Clock, Hanging, extract_facts
from fabula.operators.ledger import Ledger, fingerprint, write_whole


def counting(folder, hurt=None):
    class Counting:
        """Leaves a file for each call; ends its process once, in the middle of a task."""

        def complete(self, text, family):
            with open(f"{folder}/{time.time_ns()}-{threading.get_ident()}", "w") as f:
                f.write(text)
            if text == hurt and not os.path.exists(f"{folder}.hurt"):
                open(f"{folder}.hurt", "w").close()
                os._exit(1)
            if text == "bad":
                return "no json"
            return json.dumps({"facts": [{"type": "CHARACTER_MENTION", "entityName": text, "value": {"summary": text}, "confidence": 1}]})

    return Counting()


def asked(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def test_a_task_that_fails_asks_nothing_twice(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    ledger = Ledger(f"file://{tmp_path}/ledger", "model-1")
    chunks = spark.createDataFrame([(f"c{i}", i, f"text {i}") for i in range(6)], "chunk_id string, doc_id bigint, text string").coalesce(1)
    # local mode repeats no task, so the run is repeated as a cluster would repeat the task
    provider = counting(calls, "text 4")
    with pytest.raises(Exception, match="."):
        extract_facts(chunks, provider, ledger=ledger).collect()
    before = asked(calls)
    assert before == [f"text {i}" for i in range(5)]
    assert len(extract_facts(chunks, provider, ledger=ledger).collect()) == 6
    assert asked(calls) == sorted([*before, "text 4", "text 5"])  # the fourth had no answer yet
    assert len(extract_facts(chunks, provider, ledger=ledger, in_flight=4).collect()) == 6 and len(asked(calls)) == 7
    extract_facts(chunks, provider, ledger=Ledger(f"file://{tmp_path}/ledger", "model-2")).collect()
    assert len(asked(calls)) == 13


def test_answers_that_are_not_valid_are_not_kept(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    ledger = Ledger(f"file://{tmp_path}/ledger")
    chunks = spark.createDataFrame([("c", 1, "bad"), ("d", 1, None)], "chunk_id string, doc_id bigint, text string").coalesce(1)
    for n in (1, 2):
        rows = extract_facts(chunks, counting(calls), attempts=1, ledger=ledger).collect()
        assert [r.error is None for r in sorted(rows, key=lambda r: r.chunk_id)] == [False, False]  # an empty name isn't valid either
        assert asked(calls) == sorted(["", "bad"] * n)
    assert ledger.get("bad", "character") is None and fingerprint("a", "b") != fingerprint("ab", "")


def test_calls_that_hang_are_bounded():
    clock, go = Clock(0.02, most=3), threading.Event()
    for _ in range(3):
        with pytest.raises(TimeoutError):
            clock(lambda: go.wait(30))
    with pytest.raises(Hanging):
        clock(lambda: 1)
    go.set()
    time.sleep(0.3)
    assert clock(lambda: 1) == 1


def test_a_file_is_whole_or_not_there(tmp_path):
    path = f"{tmp_path}/x/name"
    write_whole(fs.LocalFileSystem(), path, b"one")
    write_whole(fs.LocalFileSystem(), path, b"two")
    assert open(path, "rb").read() == b"two" and os.listdir(f"{tmp_path}/x") == ["name"]
    with pytest.raises(TypeError):
        write_whole(fs.LocalFileSystem(), f"{tmp_path}/x/other", None)
    assert os.listdir(f"{tmp_path}/x") == ["name"]


def test_later_rows_of_nodes_stay_and_edges_merge_by_name(spark):
    make = spark.createDataFrame
    first = make([("a", "X", "zz", 1, 5), ("a", "X", "aa", 2, None), ("b", "X", "b", 1, 1)], "key string, label string, name string, position int, age int")
    got = {r.key: (r.name, r.age) for r in G.nodes(first).collect()}
    assert got == {"a": ("aa", None), "b": ("b", 1)}
    nodes = G.nodes(first, make([("a", "X", "0", "later")], "key string, label string, name string, note string"))
    assert nodes.where("key = 'a'").first().asDict() == {"key": "a", "label": "X", "name": "0", "age": None, "note": "later"}
    one = make([("a", "R", "b", 1, 9), ("a", "R", "b", 2, 3)], "source string, type string, target string, position int, weight int")
    two = make([("a", "R", "b", "said")], "source string, type string, target string, note string")
    assert [tuple(r) for r in G.edges(nodes, one, two).collect()] == [("a", "R", "b", 3, "said")]
    gone = make([("a", "R", "b", None)], "source string, type string, target string, weight int")
    assert [tuple(r) for r in G.edges(nodes, one, gone).collect()] == [("a", "R", "b", None)]
