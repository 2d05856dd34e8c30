import random
import re
from collections import Counter, defaultdict

from fabula.llm import divergence as D
from fabula.llm import words as W

SCHEMA = "doc_id bigint, text string, lang string, source string, p bigint, q bigint, term string, none string, kept bigint, total string"


def brute(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts, everywhere = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        docs[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
        everywhere[lang].update(words(text))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + D.SCALE * (c[t] + 1) // (total + len(kept)) for t in kept}

        q = p(everywhere[lang])
        groups = {s: p(c) for (of, s), c in counts.items() if of == lang}
        far = lambda a, b: (a - b) ** 2 // b
        for s, a in groups.items():
            pairs = [(-sum(far(a[t], b[t]) for t in kept), o.encode()) for o, b in groups.items() if o != s]
            terms = [(-far(a[t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and a[t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(found), 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 1, 2, "x", "y", 3, "z") for i, r in enumerate(rows)], SCHEMA)


def corpus():
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in ("x", "yy", "Zz", "ß", "λ")]
    rows = [(" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(30)], k=r.randrange(40))), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "é", "z", None])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", None, None), ("1 2 3 -", "en", "signs"), ("once", "xx", "one"), ("twice", "xx", "two"), ("l" * 50, "en", "b")]
    return rows + rows[:20]


def test_equals_brute_force_with_ties_nulls_and_groups_without_terms(spark):
    rows = corpus()
    got = [tuple(r) for r in D.audit_sources(frame(spark, rows), 3, 5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 3, 5)
    assert {r[4] for r in got if r[0] == "xx"} == {0}


def test_tiles_and_small_pieces_change_nothing(spark, monkeypatch):
    rows = corpus()
    want = set(map(tuple, D.audit_sources(frame(spark, rows)).collect()))
    monkeypatch.setattr(D, "TILE", 2)
    assert set(map(tuple, D.audit_sources(frame(spark, rows)).collect())) == want


def test_terms_of_long_texts_are_never_cut(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 10)
    text = "Aa bb-cc " + "d" * 35 + " e1f éÉ " + "g" * 12
    want = ["aa", "bb", "cc", "d" * 35, "e", "f", "éÉ", "g" * 12]
    assert [w.decode() for words in W.terms(text.encode(), D._TERM) for w in words] == want
    assert list(W.terms(b"", D._TERM)) == []


def test_what_a_task_gives_early_adds_up(monkeypatch):
    import pyarrow as pa

    rows = corpus()
    batches = [pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (lang or "", source or "", text)], names=["lang", "source", "text"]) for text, lang, source in rows]

    def total():
        out = Counter()
        for b in D._counted(iter(batches)):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += r["n"] + 1000 * r["docs"]
        return out

    want = total()
    monkeypatch.setattr(D, "HELD", 3)
    assert total() == want


def test_large_counts_are_exact(spark):
    row = (10**13, 9 * 10**12, 7 * 10**9)
    got = spark.createDataFrame([row], "c bigint, n bigint, v bigint").select(D.probability("c", "n", "v").alias("p")).first().p
    assert got == 1 + D.SCALE * (row[0] + 1) // (row[1] + row[2])


def test_an_empty_table_gives_none(spark):
    assert D.audit_sources(frame(spark, [])).count() == 0
