import random
from itertools import combinations

import numpy as np
import pytest
from test_ngram_join import brute, corpus

from fabula.llm import minhash as M
from fabula.llm import ngram_join as J


@pytest.mark.parametrize(("seed", "index"), [(1, M.HammingIndex()), (2, M.HammingIndex(words=5)), (3, M.HammingIndex(words=2, num=70))])
def test_components_equal_brute_force(spark, seed, index):
    rows = corpus(seed, index.num / index.den)
    df = spark.createDataFrame([(i, t, "clash", None, 1) for i, t in rows], "doc_id bigint, text string, node string, component string, kept int")
    got = M.near_duplicates(df, index).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, index)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_all_pairs_within_the_distance_share_a_key(monkeypatch):
    """Signatures of every distance, made up, whatever sets they may come from."""
    index, r = M.HammingIndex(places=16), random.Random(1)
    base = np.array([[r.randrange(1, 2**16) for _ in range(16)]] * 600, np.uint16)
    for i in range(1, 600):
        for at in r.sample(range(16), r.randrange(17)):
            base[i, at] ^= np.uint16(r.randrange(1, 2**16))
    monkeypatch.setattr(M.HammingIndex, "minima", lambda *_: base.view(np.uint64).reshape(600, -1))
    keys, owner = index.signatures(np.arange(600, dtype=np.uint64), np.arange(601))
    sets = [set(keys[owner == i].tolist()) for i in range(600)]
    far = lambda a, b: int((base[a] != base[b]).sum())
    seen = {far(0, b) for b in range(600)}
    assert index.distance == 7 and {5, 6, 7, 8, 12} <= seen
    assert all(sets[a] & sets[b] for a, b in combinations(range(600), 2) if far(a, b) <= index.distance)
    assert not all(sets[0] & sets[b] for b in range(600))
    # and each counts under one key, which both have
    words = base.view(np.uint64).reshape(600, -1)
    near = [(a, b) for a, b in combinations(range(600), 2) if far(a, b) <= index.distance]
    first = index.first_key(words[[a for a, _ in near]], words[[b for _, b in near]]).tolist()
    assert all(k in sets[a] & sets[b] for (a, b), k in zip(near, first, strict=True))


def test_places_agree_as_often_as_sets_do_and_slices_change_nothing(monkeypatch):
    index, r = M.HammingIndex(), np.random.default_rng(3)
    pool = r.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [pool[:2000], pool[500:2500], pool[:0], pool[2000:], pool[:1]]
    value, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    words = index.minima(value, first)
    agree = (words[0].view(np.uint16) == words[1].view(np.uint16)).mean()
    assert abs(agree - 1500 / 2500) < 0.2
    assert (words[2] == index.minima(value[:0], np.array([0, 0]))[0]).all()
    monkeypatch.setattr(M, "_AT_ONCE", 7)
    assert (index.minima(value, first) == words).all()


def test_distance_counts_places():
    index, r = M.HammingIndex(places=8), np.random.default_rng(4)
    a = r.integers(0, 2**16, (200, 8), dtype=np.uint16)
    b = np.where(r.random((200, 8)) < 0.45, a ^ r.integers(1, 2**16, (200, 8), dtype=np.uint16), a).astype(np.uint16)
    want = (a != b).sum(1) <= index.distance
    assert (index.within(a.view(np.uint64), b.view(np.uint64)) == want).all() and 0 < want.sum() < 200


def test_a_passage_of_many_unlike_texts_is_compared_in_tiles(spark, monkeypatch):
    """All share most of their words, so that no key tells them apart; only copies link."""
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "TOGETHER", 1 << 20)
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(25)) for _ in range(150)]
    rows += [t + " more" for t in rows[::5]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for index, together in ((M.HammingIndex(), 1 << 20), (J.PartEnum(words=2, num=80), 1 << 20), (M.HammingIndex(), 20)):
        monkeypatch.setattr(J, "TOGETHER", together)
        got = M.near_duplicates(df, index).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, index)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 18])
def test_tiles_hold_every_pair_once_and_no_key_has_many(spark, monkeypatch, at_once):
    monkeypatch.setattr(J, "TILE", 10)
    monkeypatch.setattr(J, "PAIRS_AT_ONCE", at_once)
    rows = [(7, i, i // 2) for i in range(100)] + [(8, i, i) for i in range(5)] + [(9, 1, 1)]
    placed = J._tiled(spark.createDataFrame(rows, "sig bigint, node bigint, component bigint"))
    made = sorted((r.sig, r.low, r.high, r.side, r.component, r.node) for r in placed.collect())
    keys = sorted({x[:3] for x in made})
    key = np.array([keys.index(x[:3]) for x in made])
    seen = [(i, j) for a, b in J._pairs_of_runs(key, *(np.array([x[c] for x in made]) for c in (3, 4))) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    pairs = [(made[i][0], *sorted((made[i][5], made[j][5]))) for i, j in seen]
    assert all(made[i][:3] == made[j][:3] for i, j in seen)
    # pairs of a component are left out where a tile is compared with itself
    assert len(set(pairs)) == len(pairs) and {p for p in pairs if p[0] == 8 or p[1] // 2 != p[2] // 2} >= {(7, i, j) for i in range(100) for j in range(i + 1, 100) if i // 2 != j // 2}
    assert sum(p[0] == 8 for p in pairs) == 10 and len(pairs) <= 100 * 99 // 2 + 10
    assert np.bincount(key[[i for i, _ in seen]]).max() < 500


def test_keys_that_go_on_in_the_next_batch(monkeypatch):
    """Batches of any size give the same pairs."""
    import pyarrow as pa

    index = J.PartEnum()
    r = np.random.default_rng(6)
    sig, component = np.sort(r.integers(0, 9, 60)), r.integers(0, 30, 60)
    component = component[np.lexsort((component, sig))]
    base = r.integers(0, 2**62, J.SKETCH)
    rows = pa.RecordBatch.from_pydict({"sig": sig, "origin": sig, "low": np.zeros(60, int), "high": np.zeros(60, int), "side": np.zeros(60, int), "node": np.arange(60), "component": component, "n": np.full(60, 50), "s": [base.tolist()] * 60})

    def found(size):
        return sorted(x for b in J._compared((rows.slice(i, size) for i in range(0, 60, size)), index) for x in zip(*b.to_pydict().values(), strict=True))

    c = rows.column("component").to_pylist()
    want = sorted((i, j) for i, j in combinations(range(60), 2) if sig[i] == sig[j] and c[i] != c[j])
    assert all(found(size) == want for size in (1, 2, 5, 17, 60))


def test_null_ids_and_an_empty_table(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y z u v w"), (None, None), (5, "")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0, x.kept) for x in got) == [(0, 0, 0, True), (0, 5, 0, True), (0, 5, 4, False), (4, 5, 4, True), (5, 0, 5, True)]
    assert M.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
