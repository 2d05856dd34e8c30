import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from fabula.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, node string"


def rows():
    r = random.Random(6)
    out = []
    say = lambda: r.choice(["hi", "a\\b", "<|im_end|>", "<\\|", "x<", "", "é" * 9, "\n"])
    first = [("user", "common first turn"), ("assistant", "common answer")]
    for c in range(120):
        turns = first[: r.choice([0, 1, 2])] + [(r.choice(["user", "assistant", "system", "a\nb"]), say()) for _ in range(r.randrange(1, 5))]
        out += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    same = [("user", "same"), ("assistant", "answer")]
    out += [(c, i, role, text) for c in range(200, 260) for i, (role, text) in enumerate(same)]
    out += [(300, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(300)]
    out += [(301, i, ["user", "assistant"][i % 2], f"turn {i}" if i < 200 else "x") for i in range(300)]
    out += [(400, 0, None, None), (401, 0, "assistant", None), (402, 0, "user", "twice"), (402, 0, "user", "twice"), (402, 0, "assistant", "b"), (None, 0, "user", "same"), (None, None, "assistant", "q")]
    out += [(403, 0, "assistant", "long " * 100_000)]
    r.shuffle(out)
    return out


def brute(data):
    conv = {}
    for c, t, role, text in data:
        conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        n = sum(len(C.render(role, t)[0]) for _, role, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), n)
    return out


@given(st.text(alphabet="<|\\n\nab", max_size=30), st.text(alphabet="<|\\n\nab", max_size=30))
def test_turns_are_reversible_and_closed(role, text):
    turn, begin, end = C.render(role, text)
    assert C.parse(turn) == (role, text) and C.unescape(turn[begin:end]) == text
    assert turn.count("<|") == 2 and turn.index(C.CLOSE) == len(turn) - len(C.CLOSE) - 1


def test_conversations_read_back_equal_brute_force(spark):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows()], SCHEMA).repartition(5)
    got = C.read_conversations(C.format_conversations(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows()) and len(got) == len(brute(rows()))


def test_nodes_are_emitted_once_with_places_and_ancestors(spark):
    data = rows()
    df = spark.createDataFrame([(*x, "", "") for x in data], SCHEMA).repartition(3)
    forest = C.format_conversations(df)
    nodes = sorted(forest.nodes.collect(), key=lambda r: r.begin)
    whole = "".join(r.text for r in nodes)
    at = 0
    for r in nodes:  # places follow each other, and nothing is emitted twice
        assert r.begin == at and r.n_tokens == len(r.text)
        at += r.n_tokens
    assert len({r.node for r in nodes}) == len(nodes)
    prefixes, texts = set(), {}
    conv = {}
    for c, t, role, text in data:
        conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in conv.items():
        said = [C.render(role, t)[0] for _, role, t in sorted(turns)]
        texts[c] = "".join(said)
        prefixes |= {tuple(said[: n + 1]) for n in range(len(said))}
    assert len(nodes) == len(prefixes)
    by_node = {bytes(r.node): r for r in nodes}
    for r in nodes:
        up = bytes(r.parent)
        ancestors = "".join(whole[x.begin : x.end] for x in r.attends)
        assert r.position == len(ancestors) and all(x.end <= r.begin for x in r.attends)
        assert (r.depth == 0) == (up == b"") and (not up or ancestors == "".join(whole[x.begin : x.end] for x in by_node[up].attends) + by_node[up].text)
    got = {r.conv_id: ("".join(whole[x.begin : x.end] for x in r.attends), r.n_tokens, r.n_turns) for r in forest.conversations.collect()}
    assert got == {c: (t, len(t), len(conv[c])) for c, t in texts.items()}


def test_depth_first_order_and_real_tokens(spark):
    from fabula.llm.pieces import Vocabulary, encode_texts

    v = Vocabulary.load()
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "q"), (3, 1, "assistant", "b"), (4, 0, "user", "other")]
    nodes = sorted(C.format_conversations(spark.createDataFrame([(*x, "", "") for x in data], SCHEMA), count=C.pieces(v)).nodes.collect(), key=lambda r: r.begin)
    assert len(nodes) == 5 and all(r.n_tokens == len(encode_texts(v, [r.text])[0]) for r in nodes)
    open_path = []
    for r in nodes:  # each node's parent is on the path from the root to the node before
        while open_path and open_path[-1] != r.parent:
            open_path.pop()
        assert bool(open_path) == bool(r.parent)
        open_path.append(r.node)


def test_empty_table(spark):
    assert C.read_conversations(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def in_order(nodes):
    open_path = []
    for r in nodes:
        while open_path and open_path[-1] != r.parent:
            open_path.pop()
        if bool(open_path) != bool(r.parent):
            return False
        open_path.append(r.node)
    return True


def test_depth_first_order_after_hundreds_of_shared_turns(spark, monkeypatch):
    """Forks at 130 and at 300 shared turns, equal conversations, and more ranges than conversations."""
    shared = [("user", f"t{i}") for i in range(300)]
    ways = [shared + [("user", w), ("assistant", f"{w}{i}")] for i in range(4) for w in ("p", "q", "x")]
    ways += [shared[:130] + [("user", w), ("assistant", str(i))] for i in range(3) for w in ("r", "s")] + [ways[0]] * 5 + [shared[:10]]
    data = [(c, n, *turn, "", "") for c, turns in enumerate(ways) for n, turn in enumerate(turns)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for tied in (1000, 1):
            monkeypatch.setattr(C, "_TIED", tied)
            forest = C.format_conversations(df)
            nodes = sorted(forest.nodes.collect(), key=lambda r: r.begin)
            assert in_order(nodes) and len(nodes) == 300 + 3 + 12 + 2 + 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_of_nodes_put_together_are_those_of_conversations(spark):
    from fabula.llm.pieces import Vocabulary, encode_texts

    v = Vocabulary.load()
    data = rows()
    forest = C.format_conversations(spark.createDataFrame([(*x, "", "") for x in data], SCHEMA), tokens=C.pieces(v))
    whole = [i for r in sorted(forest.nodes.collect(), key=lambda r: r.begin) for i in r.ids]
    conv = {}
    for c, t, role, text in data:
        conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    want = {c: [i for ids in encode_texts(v, [C.render(role, t)[0] for _, role, t in sorted(turns)]) for i in ids] for c, turns in conv.items()}
    got = {r.conv_id: [i for x in r.attends for i in whole[x.begin : x.end]] for r in forest.conversations.collect()}
    assert got == want
