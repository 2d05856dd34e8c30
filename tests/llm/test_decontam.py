import random
import re

from fabula.llm import decontam as D

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = {}
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            q = words(t)
            for k in [0] if 0 < len(q) < window else range(len(q) - window + 1):
                win = q[k : k + window]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        found.add(item)
        out[key] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def example():
    r = random.Random(3)
    vocabulary = ["the", "of", "É", "x1", *[f"w{i}" for i in range(12)]]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, make(r.choice([3, 14, 30]))) for i in range(12)] + [(50, ""), (51, None), (52, "single"), (53, "... --")]
    items += [(60, items[1][1]), (61, items[1][1])]
    docs = [(i, make(r.randrange(60))) for i in range(60)]
    docs += [(100 + i, make(10) + "! " + (items[i % 12][1] or "").upper() + " (" + make(20)) for i in range(24)]
    docs += [(200, None), (201, ""), (202, "single"), (203, items[2][1] + " " + items[2][1]), (204, ("pad " * 4000) + items[3][1])]
    return docs, items


def test_matches_equal_brute_force(spark):
    docs, items = example()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, spans string, shard int").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in D.contamination(df, it).collect()}
    want = brute(docs, items)
    assert got == want and any(v[1] for v in want.values())


def test_query_blocks_give_the_same(spark):
    docs, items = example()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.find_items(D.build_index(df), it, query_words=20).collect()
    got = {r.doc_id: (r.n_words, sum(s.end - s.begin for s in r.spans), list(r.item_ids)) for r in found}
    assert got == {k: v[:3] for k, v in brute(docs, items).items()}


def test_proximity_allows_words_between(spark):
    df = spark.createDataFrame([(1, "a b c x d e f"), (2, "a b c x y z d e f"), (3, "f e d c b a")], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, "a b c d e f")], "item_id bigint, text string")
    got = lambda slop: {r.doc_id for r in D.contamination(df, it, slop=slop).collect() if r.n_hit}
    assert got(0) == set() and got(1) == {1} and got(3) >= {1, 2}


def near(docs, items, slop, window=13):
    """Every occurrence of the rarest term; the others' first words within reach, in the same document."""
    corpus = [words(t) for _, t in docs]
    count = {}
    for w in corpus:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = {}
    for (key, _), w in zip(docs, corpus, strict=True):
        for item, t in items:
            q = words(t)[:window]
            if not all(x in count for x in q):
                continue
            head = min(range(len(q)), key=lambda k: (count[q[k]], k))
            for i, x in enumerate(w):
                if x == q[head] and all(any(0 <= p < len(w) and w[p] == q[k] for p in range(i + k - head - slop, i + k - head + slop + 1)) for k in range(len(q))):
                    out.setdefault(key, set()).add(item)
    return out


def test_proximity_stays_in_a_document(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    docs = [(1, "a b z"), (2, "c d"), (3, "x a b"), (4, "b c a")]
    items = [(7, "a b c"), (8, "z a b")]
    got = {r.doc_id: r.item_ids for r in D.contamination(one(docs, "doc_id bigint, text string"), one(items, "item_id bigint, text string"), slop=1).collect() if r.n_hit}
    assert 1 not in got and 2 not in got and 3 not in got
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs, items = [(i, prose(r.randrange(1, 14))) for i in range(200)], [(i, prose(r.randrange(2, 5))) for i in range(12)]
    df, it = one(docs, "doc_id bigint, text string"), one(items, "item_id bigint, text string")
    for slop in (0, 1, 2):
        got = {r.doc_id: set(r.item_ids) for r in D.contamination(df, it, slop=slop).collect() if r.n_hit}
        assert got == near(docs, items, slop)


def test_long_items_in_blocks(spark):
    r = random.Random(4)
    docs, items = example()
    items += [(70, " ".join(f"w{r.randrange(12)}" for _ in range(200)))]
    docs += [(300, items[-1][1]), (301, "pad " + " ".join(items[-1][1].split()[60:90]))]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (None, "one of a kind")], "item_id bigint, text string")
    want = brute(docs, items)
    got = {x.doc_id: (x.n_words, sum(s.end - s.begin for s in x.spans), list(x.item_ids)) for x in D.find_items(D.build_index(df), it, query_words=40).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    one = spark.createDataFrame([(1, "it is one of a kind")], "doc_id bigint, text string")
    assert [x.item_ids for x in D.contamination(one, it).collect()] == [[None]]


def test_empty_tables_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, "a b")], "item_id bigint, text string")
    assert [r.n_hit for r in D.contamination(df, it).collect()] == [2, 2, 2]
    assert D.contamination(df.limit(0), it).count() == 0
    assert [r.n_hit for r in D.contamination(df, it.limit(0)).collect()] == [0, 0, 0]
