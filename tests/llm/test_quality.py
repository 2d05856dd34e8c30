import random
import re

import numpy as np
import pytest

from fabula.llm import quality as Q

SCHEMA = "doc_id bigint, text string, n_words string, words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    r = random.Random(5)
    out = [None, "", "  \n\t ", "one", "a b c d e f g h a b c d e f g h", "x " * 30, "a\na\nb\n \n \na", "é#* €$%&|<>\n", "\u2003a b\u00a0c \x1c d\x0b\x0ce"]
    for _ in range(60):
        words = [r.choice("ab c d éé # \n $x".split(" ")) for _ in range(r.randrange(60))]
        out.append(" ".join(words) + r.choice(["", "\n", " "]))
    base = " ".join(f"w{i}" for i in range(40))
    return [*out, base, base + "\n" + base, "long" * 50_000]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in Q.text_statistics(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), (i, t)


def test_expectation_maximisation_finds_reliable_rules(spark):
    r = random.Random(1)
    catches = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.5, 0.6, 0.7, 0.5]  # of bad documents; 2 % of good ones
    rows = []
    for _ in range(4000):
        good = r.random() < 0.7
        rows.append(([-1 if r.random() < (0.02 if good else c) else r.choice([0, 1, 1]) for c in catches],))
    df = spark.createDataFrame(rows, "pattern array<int>").groupBy("pattern").count().withColumnRenamed("count", "n")
    model = Q.fit_votes(df)
    assert abs(model.prior - 0.7) < 0.05
    assert all(abs(b[0] - c) < 0.08 for b, c in zip(model.bad, catches, strict=True))
    assert all(abs(g[0] - 0.02) < 0.02 for g in model.good) and model.accuracy(0)[1] > 0.9
    assert Q.VoteModel() == Q.fit_votes(df.limit(0))


def test_verdicts_equal_row_by_row_estimation(spark):
    """The same estimation over rows instead of counted patterns, with arrays."""
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "word", "Line", "text.", "some", "more,"]) + r.choice(["", "s", "ed"]) for _ in range(n))
    rows = [(i, r.choice([prose(60), prose(30), prose(25).upper() + "!!!", "# $ % " * 12 + prose(9), "zz qq " * 20, prose(5)])) for i in range(300)]
    got = Q.judge_quality(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    failed = np.array([x.base_failed for x in got])
    assert [x.base_failed for x in got] == [n < 20 or 100 * hit > 30 * n for x in got for n, *_, hit in [brute(dict(rows)[x.doc_id])]]
    votes = np.array([x.votes for x in got])
    seen, rules = votes[~failed], np.arange(len(Q.RULES))
    start = Q.VoteModel()
    prior, kinds = start.prior, np.array([start.good, start.bad])

    def odds(v):
        w = np.log(kinds[0] / kinds[1])
        w = np.stack([np.minimum(w[:, 0], 0), np.zeros(len(rules)), np.maximum(w[:, 2], 0)], 1)
        return np.log(prior / (1 - prior)) + w[rules, v + 1].sum(1)

    for _ in range(100):
        p = 1 / (1 + np.exp(-odds(seen)))
        new = np.ones((2, len(rules), 3))
        for kind, share in enumerate((p, 1 - p)):
            for k in (-1, 0, 1):
                new[kind, :, k + 1] += ((seen == k) * share[:, None]).sum(0)
        new /= new.sum(2, keepdims=True)
        moved = abs(new - kinds).max()
        kinds, prior = new, min(0.98, max(0.02, p.mean()))
        if moved < 1e-7:
            break
    want = 1 / (1 + np.exp(-odds(votes)))
    assert np.allclose([x.posterior for x in got], want, atol=1e-6)
    sure = abs(want - 0.5) > 1e-4
    assert ([x.kept for x in got] == (~failed & (want >= 0.5)))[sure].all() and 0 < sum(x.kept for x in got) < len(got)


def test_verdicts_empty_tables_and_repeated_rows(spark):
    good = " ".join(f"the word{i} of and line{i}." for i in range(30))
    bad = "BUY!!! " * 40
    df = spark.createDataFrame([(1, good, "", ""), (2, bad, "", ""), (None, None, "", ""), (1, good, "", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in Q.judge_quality(df).collect())
    assert got == [(0, True, False), (1, False, True), (1, False, True), (2, True, False)]
    assert Q.judge_quality(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    plan = Q.text_statistics(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


if __name__ == "__main__":
    pytest.main([__file__])
