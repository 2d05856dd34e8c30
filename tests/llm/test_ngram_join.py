import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm import ngram_join as J


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, p):
    sets = [grams(t, p.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and p.den * both >= p.num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))}


def corpus(seed, similar):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(30):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 12, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.randrange(int(len(copy) * (1 - similar) / 3) + 2)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "ONE", "one two", "x y z", "x y z", "w1 " * 3000]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "p"), [(1, J.PartEnum()), (2, J.PartEnum(words=5, num=80)), (3, J.PartEnum(words=2, num=60, n2=3))])
def test_components_equal_brute_force(spark, seed, p):
    rows = corpus(seed, p.num / p.den)
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], "doc_id bigint, text string, node string, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, p).collect()}
    assert got == brute(rows, p)


def test_large_groups_are_divided_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(J, "TOGETHER", 1)
    monkeypatch.setattr(J, "GROWTH", 6)
    monkeypatch.setattr(J, "LEADER_TURNS", 1)
    r = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    rows = corpus(4, 0.9)
    for i in range(40):  # unlike documents with one passage, some of them near copies
        own = [f"d{i}x{j}" for j in range(r.choice([4, 10, 30]))]
        rows += [(1000 + 2 * i, " ".join(passage + own)), (1001 + 2 * i, " ".join(passage + own[:-1] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(df).collect()}
    assert got == brute(rows, J.PartEnum())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 300), st.sampled_from([J.PartEnum(), J.PartEnum(num=80), J.PartEnum(num=80, n2=3), J.PartEnum(num=60, k2=2, n2=4)]))
def test_similar_sets_share_a_signature(seed, size, p):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
    # as different as the threshold still allows: x elements exchanged, or only left out
    x = len(a) * (p.den - p.num) // (p.den + p.num)
    y = len(a) - -(-len(a) * p.num // p.den)
    for b in (np.concatenate([a[x:], r.integers(0, 2**63, x).astype(np.uint64)]), a[y:]):
        b = np.sort(b)
        if np.array_equal(a, b):
            continue
        common = np.sort(r.choice(np.union1d(a, b), r.integers(0, len(a)), replace=False))
        key, owner = J.signatures(p, np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), common)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_empty_and_null_ids(spark):
    schema = "doc_id bigint, text string"
    assert J.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s"), (5, None)], schema)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.jaccard_components(df).collect())
    assert got == [(0, 1, 0), (0, 2, 7), (5, 0, 5), (7, 2, 7), (7, 2, 7)]
