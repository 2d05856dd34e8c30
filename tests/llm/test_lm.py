import math
import random
import re
import zlib
from collections import Counter

import pytest

from fabula.llm import lm as M


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(rows, least=1):
    """The same model, word by word with dictionaries."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [[*words(t), "END"] for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    total, types = sum(c.values()), len(c)
    grams, context = {1: Counter(), 2: Counter()}, {1: Counter(), 2: Counter()}
    for t in train:
        t = ["END", *t]
        for n in (1, 2):
            for i in range(n, len(t)):
                grams[n][tuple(t[i - n : i + 1])] += 1
                context[n][tuple(t[i - n : i])] += 1
    arcs = {n: {} for n in grams}
    for n in grams:
        for g, k in grams[n].items():
            if k >= least:
                arcs[n].setdefault(g[:-1], {})[g[-1]] = k
    d = M.DISCOUNT
    floor = math.log10(d * types / total) if total else 0.0
    out = {}
    for i, text in rows:
        t = ["END", *words(text), "END"]
        score = base = known = 0
        for k in range(1, len(t)):
            w = t[k]
            base += math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1)))
            known += c[w] > 0
            p = math.log10((c[w] - d) / total) if c[w] else floor
            for n in (1, 2):
                state = tuple(t[max(0, k - n) : k])
                if len(state) == n and context[n][state]:
                    here = arcs[n].get(state, {})
                    weight = 1 - sum(x - d for x in here.values()) / context[n][state]
                    p += math.log10(max(weight, 1e-12))
                    if w in here:
                        p = math.log10((here[w] - d) / context[n][state] + 10**p)
            score += p
        out[i] = held(i), len(t) - 1, known, total, base, score
    return out


def corpus(n=60):
    r = random.Random(8)
    vocabulary = ["the", "of", "A", "Été", "b c", *[f"w{i}" for i in range(40)]]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice([5, 45])]) for _ in range(r.randrange(40)))) for i in range(n)]
    return [*rows, (100, None), (101, ""), (102, " \n"), (103, "never seen wörds zzz"), (104, "the " * 20_000), (None, "the of")]


@pytest.mark.parametrize("least", [1, 3, 10**9])
def test_scores_equal_brute_force(spark, least):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", True) for i, t in rows], "doc_id bigint, text string, score string, block boolean").repartition(3)
    got = {r.doc_id: r for r in M.score_texts(df, least_count=least).collect()}
    for i, want in brute(rows, least).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9) and r.score == pytest.approx(want[5], rel=1e-9)


def test_every_word_seen_is_a_context(spark):
    rows = [*corpus(), (105, "once-a once-b once-a"), (106, "once-b once-c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.score for r in M.score_texts(df).collect()}
    assert got == {i: pytest.approx(want[5], rel=1e-9) for i, want in brute(rows).items()}


def test_probabilities_of_all_next_events_sum_to_one():
    texts = [["a", "b", "END"], ["a", "a", "c", "END"], ["b", "END"]] * 3
    c = Counter(w for t in texts for w in t)
    total, d = sum(c.values()), M.DISCOUNT
    pair = Counter((a, b) for t in texts for a, b in zip(["END", *t], t, strict=False))
    root = {w: (n - d) / total for w, n in c.items()} | {None: d * len(c) / total}
    assert abs(sum(root.values()) - 1) < 1e-12
    triple = Counter(x for t in texts for x in zip(["END", *t], t, t[1:], strict=False))

    def step(arcs, n, below):
        weight = 1 - sum(k - d for k in arcs.values()) / n
        return {w: weight * q + ((arcs[w] - d) / n if w in arcs else 0) for w, q in below.items()}

    one = {state: step({b: n for (a, b), n in pair.items() if a == state}, c[state], root) for state in c}
    assert all(abs(sum(p.values()) - 1) < 1e-12 for p in one.values())
    for state in {x[:2] for x in triple}:
        arcs = {x[2]: n for x, n in triple.items() if x[:2] == state}
        assert abs(sum(step(arcs, sum(arcs.values()), one[state[1]]).values()) - 1) < 1e-12


def test_empty_repeated_and_no_training(spark):
    schema = "doc_id bigint, text string"
    assert M.score_texts(spark.createDataFrame([], schema)).count() == 0
    twice = M.score_texts(spark.createDataFrame([(1, "a b"), (1, "a b")], schema)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = M.score_texts(spark.createDataFrame([(only, "a b")], schema)).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0
    assert r.score == 0.0


def test_held_out_texts_score_above_the_base(spark):
    r = random.Random(1)
    chain = {w: r.sample([f"w{i}" for i in range(50)], 3) for w in [f"w{i}" for i in range(50)]}

    def text():
        w = "w0"
        out = []
        for _ in range(60):
            out.append(w)
            w = r.choice(chain[w])
        return " ".join(out)

    rows = M.score_texts(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id bigint, text string")).where("held_out").collect()
    assert sum(x.score for x in rows) > 0.5 * sum(x.base_score for x in rows)
