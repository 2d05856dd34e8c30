"""Words of whole Arrow batches at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes of one class. Both classes treat all bytes of
non-ASCII characters alike, so working on UTF-8 bytes gives the same words as
working on code points. Texts are taken in segments of a few MB cut between
words, so the memory beside the hashes themselves is bounded for any text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[32, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 2**64), _SEGMENT + 1)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives unused memory back to the system. Python workers live long and serve one
    operator after the other, so what each kept for itself would add up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``most`` bytes of text, one row at least."""
    _, at = buffers(batch.column(text))
    row = 0
    while row < len(batch):
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in ``data``; no word crosses a text's border."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    after[ends] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hash_words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts in order, and for each text the
    index of its first word (with one more entry at the end)."""
    parts, counts = [], np.zeros(len(at), np.int64)
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + _SEGMENT)
        if hi < len(data):  # cut after a byte that is in no word, or at a text's border
            border = int(at[np.searchsorted(at, hi, "right") - 1])
            gaps = np.flatnonzero(~is_word[LOWER[data[lo:hi]]])
            cut = max(border, lo + int(gaps[-1]) + 1 if len(gaps) else lo)
            if cut <= lo:  # one word longer than a segment
                rest = np.flatnonzero(~is_word[LOWER[data[hi:]]])
                nxt = at[at > lo]
                hi = min(hi + int(rest[0]) if len(rest) else len(data), int(nxt[0]) if len(nxt) else len(data))
            else:
                hi = cut
        part = LOWER[data[lo:hi]]
        inner = at[(at > lo) & (at < hi)] - lo
        starts, ends = word_spans(part, np.concatenate([[0], inner, [hi - lo]]), is_word)
        parts.append(_hash(part, starts, ends))
        counts += np.searchsorted(starts + lo, np.clip(at, lo, hi)) if len(starts) else 0
        lo = hi
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def _hash(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(part) > _SEGMENT:  # one very long word: the same polynomial, piece by piece
        out = np.zeros(len(starts), np.uint64)
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            total, scale = 0, 1
            for k in range(int(s), int(e), _SEGMENT):
                piece = part[k : min(int(e), k + _SEGMENT)]
                value = int((_BYTE[piece] * _POW[: len(piece)]).sum(dtype=np.uint64))
                total = (total + value * scale) % 2**64
                scale = scale * pow(_BASE, len(piece), 2**64) % 2**64
            out[i] = total
    else:
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POW[: len(part)], out=prefix[1:])
        out = (prefix[ends] - prefix[starts]) * _INV[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and each text's first
    index. A text of fewer than ``n`` words, but not none, has its whole sequence as
    its one shingle."""
    count = np.diff(first)
    width = np.maximum(count - n + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), width)
    begin = np.concatenate([[0], np.cumsum(width)])
    start = first[:-1][owner] + np.arange(len(owner)) - begin[:-1][owner]
    size = np.minimum(count, n)[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(n):
        has = size > k
        idx = start[has] + k
        value[has] = mix(value[has] * np.uint64(_BASE) + words[idx])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


#: Bytes of a text that become terms at once.
PIECE = 1 << 20


def term_table(is_term: Callable[[int], bool]) -> bytes:
    """For bytes.translate: A-Z are lower-cased, and what then is in no term becomes a blank."""
    return bytes(b if is_term(b) else 32 for b in (x + 32 if 65 <= x <= 90 else x for x in range(256)))


def terms(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about PIECE bytes; no term is cut."""
    clean, at = text.translate(table), 0
    while at < len(clean):
        end = len(clean)
        if end - at > PIECE:
            end = clean.rfind(b" ", at, at + PIECE)
            if end < 0:  # a term longer than a piece
                end = clean.find(b" ", at + PIECE)
                end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end + 1
