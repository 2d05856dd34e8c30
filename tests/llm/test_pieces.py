import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def toy():
    pieces = ["<unk>", "<s>", "</s>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "c", "ab", "ba", "abc", "▁a", "▁ab", "aa", "aaa", "bab", "cab"]
    scores = [0, 0, 0, *[0] * 256, -3, -4, -4, -5, -7, -7, -9, -6, -8, -8, -11, -10, -12]
    return P.Vocabulary(pieces, scores, list(range(3, 259)), list(range(259)))


def fractions():
    v = toy()
    r = random.Random(8)
    return P.Vocabulary(v.pieces, [s + float(np.float32(r.random())) if s else 0.0 for s in v.scores], v.byte_ids, v.special)


def brute(v, text):
    """Plain dynamic programming over the whole text."""
    if not text:
        return []
    c = [chr(x) for x in P.normalized(text).tolist()]
    ids = {v.pieces[i]: i for i in v._normal}
    best, last = [0], [None]
    for t in range(1, len(c) + 1):
        top = (best[t - 1] + v.unknown_score, 1, None)
        for k in range(1, min(t, v.longest) + 1):
            i = ids.get("".join(c[t - k : t]))
            if i is not None and best[t - k] + v.units[i] >= top[0]:
                top = (best[t - k] + v.units[i], k, i)
        best.append(top[0])
        last.append(top[1:])
    out, t = [], len(c)
    while t:
        k, i = last[t]
        out.append([i] if i is not None else P._spelled(v, ord(c[t - 1])))
        t -= k
    return [i for part in reversed(out) for i in part]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc d\né▁\x00", max_size=60))
def test_small_vocabulary_equals_plain_dynamic_programming(text):
    v = toy()
    assert P.encode_texts(v, [text])[0].tolist() == brute(v, text)
    assert P.decode_ids(v, brute(v, text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=80), st.integers(1, 30), st.booleans())
def test_chunks_give_the_path_of_the_whole(text, chunk, whole):
    v = toy() if whole else fractions()
    c = P.normalized(text)
    parts = [(c[s : s + chunk + v.longest - 1], min(chunk, len(c) - s)) for s in range(0, len(c), chunk)]
    products = P.prefix_products(np.stack([P.transfer(v, x, n) for x, n in parts]))
    start = np.full(v.longest, P._NONE)
    start[0] = 0
    scores = [start, *products[:-1, 0]]
    state, out = 0, []
    for (x, n), s in zip(reversed(parts), reversed(scores), strict=True):
        end, state_before, ids = next(o for o in P.backtrace(v, x, n, s) if o[0] == state)
        out.append(ids)
        state = state_before
    assert state == 0 and [i for p in reversed(out) for i in p] == brute(v, text)


def test_composition_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (r.integers(-50, 0, (5, 5)) for _ in range(3))
    assert (P.compose(P.compose(a, b), c) == P.compose(a, P.compose(b, c))).all()


def unigram_file(path):
    """The model file with its kind set to unigram: the library then sums scores as well."""
    data = open(path, "rb").read()

    def varint(i):
        n = s = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << s
            s += 7
            if b < 128:
                return n, i

    i = 0
    while i < len(data):
        tag, j = varint(i)
        size, k = varint(j)
        if tag == 18:  # trainer_spec
            j = k
            while j < k + size:  # to model_type, field 3; 1 is unigram
                tag, value = varint(j)
                if tag == 24:
                    return data[:value] + b"\x01" + data[value + 1 :]
                n, end = varint(value)
                j = {0: end, 2: end + n, 5: value + 4}[tag & 7]
        i = k + size
    raise AssertionError


def test_ids_equal_the_librarys(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_file(P.MODEL))
    r = random.Random(1)
    # the library sums 32-bit floats: no lone marks (-1e9 in this file) and no unknown characters here
    texts = ["Hello world", "Über größe naïve façade", "a", "x" * 40, "antidisestablishmentarianism"]
    texts += [" ".join("".join(r.choice(["th", "er", "ing", "ß", "é", "x1", "Q"]) for _ in range(r.randrange(1, 5))) for _ in range(6)) for _ in range(60)]
    total = lambda ids: sum(vocabulary.scores[i] for i in ids)
    same = 0
    for t, ids in zip(texts, P.encode_texts(vocabulary, texts), strict=True):
        first, second = sp.nbest_encode(t, nbest_size=2)
        assert total(ids.tolist()) == total(first), t
        if total(first) > total(second):
            assert ids.tolist() == first, t
            same += 1
        assert P.decode_ids(vocabulary, ids.tolist()) == t
    assert same > 40


def test_bytes_and_spaces_survive(vocabulary):
    texts = ["the  two   spaces", "tab\tand\nline", "日本語 text 😀", "    ", "▁", " ▁ x", "\x00"]
    for t, ids in zip(texts, P.encode_texts(vocabulary, texts), strict=True):
        assert ids.tolist() == brute(vocabulary, t) and P.decode_ids(vocabulary, ids.tolist()) == t


def test_tables_with_giant_texts(spark, vocabulary):
    r = random.Random(3)
    rows = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, " "), (4, "▁ literal▁mark ﷐\x00"), (5, "word " * 3000), (6, "aaaaab" * 700), (7, "".join(r.choice("etaoin shrdlu\n") for _ in range(5000)))]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id bigint, text string, matrix string, n int").repartition(3)
    out = P.decode(P.encode(df, vocabulary, chunk=700), vocabulary).collect()
    assert len(out) == len(rows)
    for row in out:
        assert row.decoded == row.text and row.matrix == "clash"
        assert row.ids == (None if row.text is None else brute(vocabulary, row.text))
    v = fractions()
    for row in P.encode(df.withColumnRenamed("matrix", "ids"), v, chunk=500).collect():
        assert row.ids == (None if row.text is None else brute(v, row.text))
    empty = df.limit(0)
    assert P.decode(P.encode(empty, vocabulary), vocabulary).count() == 0


def test_rows_of_giant_texts_keep_columns_of_any_names(spark):
    v = P.Vocabulary.load()
    text = "abc def " * 40
    rows = [(1, text, "key", [7], "row", 3), (2, "short", "k", None, None, None), (None, None, "k", None, None, None), (1, text, "other", None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text_key string, _ids array<int>, row string, found int")
    got = P.encode(df, v, chunk=100).collect()
    assert sorted((str(tuple(r)[:6]) for r in got)) == sorted(str(r) for r in rows)
    assert {len(r.ids) if r.ids is not None else None for r in got if r.text == text} == {len(P.encode_texts(v, [text])[0])}
