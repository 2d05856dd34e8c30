import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fabula.llm import ranked as R
from fabula.llm import words as W


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    tf = [(key, Counter(words(t))) for key, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = defaultdict(set)
    for key, t in items:
        asked[key].update(words(t))
    out = []
    for item, query in asked.items():
        scores = []
        for key, c in tf:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if c[t])
                if s > 0:
                    scores.append((-s, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "x1", "λ"]
    say = lambda n: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(63)], k=n))
    docs = [(i, say(r.randrange(1, 60))) for i in range(150)]
    docs += [(i, docs[i - 150][1]) for i in range(150, 170)] + docs[:10]  # copies tie, repeated rows too
    docs += [(None, say(30)), (None, docs[3][1]), (300, None), (301, ""), (302, "-- ?"), (303, "rare " + "w0 " * 4000)]
    items = [(i, say(r.randrange(1, 12))) for i in range(25)] + [(3, "again W7"), (None, "w1, w2"), (90, None), (91, ""), (92, "unknown"), (93, "rare"), (94, "λ Ünder")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id bigint, text string, term string, rank int, shard string"),
        spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, doc_id int, term string"),
    )


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    docs, items = corpus()
    got = R.rank_documents(*frames(spark, docs, items), 7).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 7)


@pytest.mark.parametrize("block_terms", [10, 10**6])
def test_small_shards_and_blocks_of_queries_change_nothing(spark, block_terms, tmp_path, monkeypatch):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    n_docs, n_terms = R.collection(d)
    monkeypatch.setattr(R, "SHARD_BYTES", 500)
    R.build_index(d, n_docs, n_terms).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.where("term is null").count() > 10
    assert index.where("term is null").selectExpr("sum(size(ids))").first()[0] == len(docs)
    got = R.search_index(index, i, n_docs, 10, block_terms=block_terms).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 10)


def test_postings_are_grouped_by_impact_highest_first(spark):
    docs, items = corpus()
    d, _ = frames(spark, docs, items)
    for row in R.build_index(d, *R.collection(d)).where("term is not null").collect():
        assert row.impacts == sorted(set(row.impacts), reverse=True) and sum(row.sizes) == len(row.docs) == row.n_docs


def test_stops_only_when_the_rest_is_proven_and_scores_stay_whole():
    r = np.random.default_rng(2)
    stopped = 0
    for _ in range(300):
        n, k = int(r.integers(1, 400)), int(r.integers(1, 12))
        lists, want = [], np.zeros(n, np.int64)
        for _ in range(int(r.integers(1, 9))):
            docs = r.permutation(n)[: max(1, int(n * r.random() ** 3))].astype(np.int32)
            impact = r.integers(1, 2000 if r.random() < 0.5 else 4, len(docs)) ** 2
            order = np.lexsort((docs, -impact))
            docs, impact = docs[order], impact[order]
            groups = np.flatnonzero(np.diff(impact, prepend=-1))
            weight = int(r.choice([1, 5, 300, 9000]))
            want[docs] += weight * impact
            lists.append((weight, R.Postings(impact[groups], np.diff(np.append(groups, len(docs))), docs)))
        found, score, added = R.best(lists, n, k)
        assert (score == want[found]).all()
        least = np.sort(want)[::-1][:k].min() if n >= k else 1
        assert set(np.flatnonzero(want >= max(least, 1)).tolist()) <= set(found.tolist())
        stopped += added < sum(len(p.docs) for _, p in lists)
    assert stopped > 30


def test_long_terms_and_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 8)
    text = "A1 b" + "c" * 30 + " d-é" + "f" * 9
    assert [w.decode() for part in W.terms(text.encode(), R._TERM) for w in part] == words(text)


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert R.rank_documents(d.where("false"), i).count() == 0
    assert R.rank_documents(d, i.where("false")).count() == 0
