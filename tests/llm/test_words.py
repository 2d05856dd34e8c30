import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\n\té0.- ", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.sampled_from([5, 64, 2 << 20]))
def test_hashes_tell_words_apart_like_a_regular_expression(texts, segment):
    for table, pattern in ((W.BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, at = W.buffers(pa.array(texts, pa.string()))
        old, W._SEGMENT = W._SEGMENT, segment
        try:
            h, first = W.hash_words(data, at, table)
        finally:
            W._SEGMENT = old
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [re.findall(pattern, t) for t in lower]
        assert np.diff(first).tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert len(h) == len(flat)
        assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_shingles_are_distinct_windows():
    texts = ["a b c a b c", "a b", "", None, "x"]
    h, first = W.hash_words(*W.buffers(pa.array(texts)), W.BLANK_SEPARATED)
    v, at = W.shingles(h, first, 3)
    assert np.diff(at).tolist() == [3, 1, 0, 0, 1]


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "c"]})
    parts = list(W.slices(batch, "text", 20))
    assert sum(map(len, parts)) == 4 and len(parts) > 1
