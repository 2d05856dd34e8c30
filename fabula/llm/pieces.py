"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's best segmentation is the path of the largest sum of piece scores, with
spaces as U+2581, one such mark before the text, and bytes for characters that no
piece has. The vocabulary and its scores are those of a model file; scores are
summed as a unigram model does, and whole numbers stay exact.

Two neighbouring characters that stand together in no piece are always cut, so a
text falls into short stretches that are solved once for each distinct stretch of
a few MB of text, all at once, length by length. Scores that aren't whole numbers are
summed in units of 2 ** -24, about what a 32-bit score has: sums are then exact and
don't depend on how a text is split.

Giant texts are split into chunks across rows. A chunk's transfer matrix has the
best score from each state at its left border to each at its right one, a state
being how many characters of the chunk the piece across the border takes. Matrices
combine associatively in the max-plus semiring; a scan of them gives the scores of
all states at every border, and each chunk is traced back on its own for each
state it may end in. Putting the traces together picks one for each chunk.

Among equal sums the longest last piece is taken. Defined cases: null texts have
null ids, empty ones no ids. A literal U+2581 is spelled in bytes, so decoding
restores every text exactly. Repeated rows and null ids are encoded like any
others; encode() and decode() keep all columns but one of the name of their result,
which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fabula.llm import words as W
from fabula.llm.cluster import materialize

MARK = "▁"
#: Texts with more characters are split into chunks of this many.
CHUNK = 65_536
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NONE = -(1 << 60)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a literal mark; no text has a lone surrogate, and no piece.
_LITERAL = 0xD800


@dataclass
class Vocabulary:
    """Pieces and scores of a model; everything else is derived on each worker."""

    pieces: list[str]
    scores: list[int | float]
    byte_ids: list[int]
    special: list[int]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)]
        return Vocabulary(pieces, [sp.get_score(i) for i in range(n)], byte_ids, special)

    def __reduce__(self):
        # a worker derives the tables of a vocabulary once, not for every task
        return _shared, (self.pieces, self.scores, self.byte_ids, self.special)

    @cached_property
    def _normal(self) -> list[int]:
        special = set(self.special)
        return [i for i in range(len(self.pieces)) if i not in special]

    @cached_property
    def unit(self) -> int:
        """What a score of 1 is in whole units."""
        return 1 if all(float(s).is_integer() for s in self.scores) else 1 << 24

    @cached_property
    def units(self) -> list[int]:
        return [round(s * self.unit) for s in self.scores]

    @cached_property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self._normal)

    @cached_property
    def unknown_score(self):
        """Below all pieces, as in the library: the smallest score less ten."""
        return min(self.units[i] for i in self._normal) - 10 * self.unit

    @cached_property
    def _codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The characters of all pieces one after the other, and where each begins."""
        size = [len(self.pieces[i]) for i in self._normal]
        return codes("".join(self.pieces[i] for i in self._normal)), np.concatenate([[0], np.cumsum(size)])

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces with their ids and scores."""
        c, at = self._codes
        spread, size, h = W.mix(c.astype(np.uint64) + np.uint64(1)), np.diff(at), np.zeros(len(at) - 1, np.uint64)
        for t in range(self.longest):
            live = size > t
            h[live] = h[live] * _BASE + spread[at[:-1][live] + t]
        keys = W.mix(h)
        order = np.argsort(keys)
        assert len(np.unique(keys)) == len(keys)
        return keys[order], np.array(self._normal)[order], np.array([self.units[i] for i in self._normal], np.int64)[order]

    @cached_property
    def first_bits(self) -> np.ndarray:
        """Which first 20 bits some piece's hash has."""
        out = np.zeros(1 << 20, bool)
        out[(self.table[0] >> np.uint64(44)).astype(np.int64)] = True
        return out

    @cached_property
    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character of any piece (the last for all others), by its code,
        and which two stand side by side in a piece."""
        c, at = self._codes
        chars, kind = np.unique(c, return_inverse=True)
        number = np.full(0x110000, len(chars), np.int32)
        number[chars] = np.arange(len(chars))
        inside = np.ones(len(c), bool)
        inside[at[:-1]] = False
        second = np.flatnonzero(inside)
        beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        beside[kind[second - 1], kind[second]] = True
        return number, beside

    @cached_property
    def bytes_of(self) -> list[bytes]:
        out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in self.special:
            out[i] = b""
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


_made: dict[int, Vocabulary] = {}


def _shared(*fields) -> Vocabulary:
    key = hash((tuple(fields[0]), tuple(fields[1])))
    if key not in _made:
        _made[key] = Vocabulary(*fields)
    return _made[key]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def normalized(text: str) -> np.ndarray:
    """Characters with spaces as marks and a mark before them; literal marks become
    a code that no piece has."""
    c = codes(text)
    out = np.empty(len(c) + 1, np.uint32)
    out[0] = ord(MARK)
    out[1:] = np.where(c == 32, ord(MARK), np.where(c == ord(MARK), _LITERAL, c))
    return out


def lookup(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of substrings by hash, -1 where there is no such piece. Most have
    none, which the first bits of the hash already tell."""
    keys, ids, scores = v.table
    out, score = np.full(len(h), -1, np.int64), np.zeros(len(h), scores.dtype)
    rows = np.flatnonzero(v.first_bits[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
    hit = keys[at] == h[rows]
    rows, at = rows[hit], at[hit]
    out[rows], score[rows] = ids[at], scores[at]
    return out, score


def stretches(v: Vocabulary, c: np.ndarray, at: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:  # noqa: B008
    """Where the stretches of ``c`` begin that no piece reaches beyond; and at ``at``."""
    kind, beside = v.together
    k = kind[c]
    cut = np.ones(len(c), bool)
    cut[1:] = ~beside.ravel()[k[:-1] * np.int32(len(beside)) + k[1:]]
    cut[at[at < len(c)]] = True
    return np.flatnonzero(cut)


def solve(v: Vocabulary, c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of the stretches c[begin:begin + size]: lengths and ids of the
    pieces of the one ending at each character, so that a trace can follow them back.

    Returns (length, id) for each character of each stretch, stretches side by side.
    Each step extends all stretches that are long enough by one character.
    """
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    first = np.concatenate([[0], np.cumsum(size)])
    spread = W.mix(c.astype(np.uint64) + np.uint64(1))
    best = np.full(first[-1] + len(size), _NONE, np.int64)  # one more entry each: before its first character
    at0 = first[:-1] + np.arange(len(size))
    best[at0] = 0
    length, piece = np.zeros(first[-1], np.int16), np.full(first[-1], -1, np.int32)
    for t in range(1, int(size[0]) + 1 if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "right"))
        end = begin[:n] + t - 1
        # suffixes ending at t, longest last: hashes grow to the left
        h = np.zeros(n, np.uint64)
        power = np.uint64(1)
        top = best[at0[:n] + t - 1] + v.unknown_score
        take, which = np.ones(n, np.int16), np.full(n, -1, np.int32)
        for k in range(1, min(t, v.longest) + 1):
            h = h + spread[end - k + 1] * power
            power = np.uint64(int(power) * int(_BASE) & (2**64 - 1))
            ids, score = lookup(v, W.mix(h))
            total = best[at0[:n] + t - k] + score
            better = (ids >= 0) & (total >= top)
            top = np.where(better, total, top)
            take[better], which[better] = k, ids[better]
        best[at0[:n] + t] = top
        length[first[:n] + t - 1], piece[first[:n] + t - 1] = take, which
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    # in the order asked for
    where = np.repeat(first[back], size[back]) + np.arange(first[-1]) - np.repeat(np.cumsum(size[back]) - size[back], size[back])
    return length[where], piece[where]


def trace(length: np.ndarray, piece: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follows all stretches back at once: for each piece on a best path its stretch, the
    place of its last character and its id (-1: a character to be spelled)."""
    at = first[1:] - 1
    live = np.arange(len(at))[at >= first[:-1]]
    at = at[live]
    owners, places, ids = [], [], []
    while len(live):
        owners.append(live)
        places.append(at)
        ids.append(piece[at])
        at = at - length[at]
        ok = at >= first[:-1][live]
        live, at = live[ok], at[ok]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    places, ids, owners = join(places), join(ids), join(owners)
    order = np.argsort(places)
    return owners[order], places[order], ids[order]


def _spelled(v: Vocabulary, code: int) -> list[int]:
    raw = MARK.encode() if code == _LITERAL else b" " if code == ord(MARK) else chr(code).encode()
    return [v.byte_ids[b] for b in raw]


def segment(v: Vocabulary, c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentations of the stretches that begin at ``starts``, each distinct one solved
    once: ids (-1: unknown) and characters of the distinct ones' pieces, where each
    distinct one's begin, and which of them every stretch is."""
    size = np.diff(np.append(starts, len(c)))
    spread = W.mix(c.astype(np.uint64) + np.uint64(1))
    key = _stretch_hashes(spread, starts, size)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    length, piece = solve(v, c, starts[one], size[one])
    first = np.concatenate([[0], np.cumsum(size[one])])
    owner, place, ids = trace(length, piece, first)
    char = c[starts[one][owner] + place - first[owner]]
    return ids, char, np.searchsorted(owner, np.arange(len(one) + 1)), which


def encode_codes(v: Vocabulary, c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Ids of many normalized texts, the characters of which follow each other in ``c``."""
    starts = stretches(v, c, at)
    ids, char, begin, which = segment(v, c, starts)
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = {x: _spelled(v, x) for x in np.unique(char[unknown]).tolist()}
        many = np.ones(len(ids), np.int64)
        many[unknown] = [len(spelled[x]) for x in char[unknown].tolist()]
        wide = np.repeat(ids, many)
        total = np.concatenate([[0], np.cumsum(many)])
        for b, x in zip(total[unknown].tolist(), char[unknown].tolist(), strict=True):
            wide[b : b + len(spelled[x])] = spelled[x]
        ids, begin = wide, total[begin]
    n = np.diff(begin)[which]
    total = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.repeat(begin[:-1][which], n) + np.arange(total[-1]) - np.repeat(total[:-1], n)].astype(np.int32)
    border = total[np.searchsorted(starts, at)]
    return [flat[s:e] for s, e in zip(border[:-1], border[1:], strict=True)]


def best_sum(v: Vocabulary, c: np.ndarray) -> int:
    """The largest sum of scores over ``c``."""
    if not len(c):
        return 0
    ids, _, begin, which = segment(v, c, stretches(v, c))
    by_id = np.append(np.array(v.units), v.unknown_score)  # -1 is the last
    total = np.concatenate([[0], np.cumsum(by_id[ids])])
    return int((total[begin[1:]] - total[begin[:-1]])[which].sum())


def _stretch_hashes(spread: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch, in rounds over those that are still long enough."""
    out = size.astype(np.uint64)
    live = np.arange(len(starts))
    for t in range(int(size.max(initial=0))):
        live = live[size[live] > t]
        if len(live) < 64:  # few long ones: each by itself
            for i in live.tolist():
                s = spread[starts[i] + t : starts[i] + size[i]]
                out[i] = np.bitwise_xor.reduce(W.mix(s + np.arange(len(s), dtype=np.uint64) * _BASE)) ^ W.mix(out[i : i + 1])[0] ^ W.mix(s[-1:] ^ s[:1])[0]
            break
        out[live] = out[live] * _BASE + spread[starts[live] + t]
    return W.mix(out)


def encode_texts(v: Vocabulary, texts: list[str | None]) -> list[np.ndarray | None]:
    parts = [normalized(t) if t else np.zeros(0, np.uint32) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    if not at[-1]:
        return [None if t is None else np.zeros(0, np.int32) for t in texts]
    out = encode_codes(v, np.concatenate(parts), at)
    return [None if t is None else ids for t, ids in zip(texts, out, strict=True)]


def decode_ids(v: Vocabulary, ids: list[int] | None) -> str | None:
    if ids is None:
        return None
    if not len(ids):
        return ""
    out = b"".join([v.bytes_of[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


# ---------------------------------------------------------------- the scan


def _edges(v: Vocabulary, c: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """For each end 1..n + longest - 1 the pieces (length, id, score) that end there and
    begin within the first n characters, longest last."""
    spread = W.mix(c.astype(np.uint64) + np.uint64(1))
    out: list[list] = [[] for _ in range(len(c) + 1)]
    h = np.zeros(0, np.uint64)
    power = 1
    for k in range(1, min(v.longest, len(c)) + 1):
        ends = np.arange(k, len(c) + 1)
        h = spread[: len(c) - k + 1] * np.uint64(power) + (h[1:] if k > 1 else np.uint64(0))
        power = power * int(_BASE) % 2**64
        ids, score = lookup(v, W.mix(h))
        hit = np.flatnonzero((ids >= 0) & (ends - k < n))
        for e, i, s in zip(ends[hit].tolist(), ids[hit].tolist(), score[hit].tolist(), strict=True):
            out[e].append((k, i, s))
    return out


def _forward(v: Vocabulary, c: np.ndarray, n: int, entry: np.ndarray) -> tuple[np.ndarray, list]:
    """Best scores at each end for each column of ``entry`` (rows: states at the left border)."""
    edges = _edges(v, c, n)
    width = n + v.longest
    best = np.full((width, entry.shape[1]), _NONE, entry.dtype)
    best[: min(len(entry), width)] = entry[:width]
    for t in range(1, min(len(c), width - 1) + 1):
        if t <= n:
            np.maximum(best[t], best[t - 1] + v.unknown_score, out=best[t])
        for k, _, s in edges[t]:
            np.maximum(best[t], best[t - k] + s, out=best[t])
    return best, edges


def _cuts(v: Vocabulary, c: np.ndarray, n: int) -> tuple[int, int] | None:
    """The first cut that no entry state reaches beyond, and the last in the chunk."""
    cuts = stretches(v, c)
    cuts = cuts[(cuts >= v.longest - 1) & (cuts <= n)]
    return (int(cuts[0]), int(cuts[-1])) if len(cuts) else None


def transfer(v: Vocabulary, c: np.ndarray, n: int) -> np.ndarray:
    """The chunk's matrix: state at the left border to state at the right one. ``c`` has the
    n characters of the chunk and those that a piece across its right border may take.

    Up to the first cut every entry state is carried; from there on all go the same way
    and differ by a constant."""
    m = v.longest
    entry = np.full((m, m), _NONE, np.int64)
    np.fill_diagonal(entry, 0)
    cuts = _cuts(v, c, n)
    if cuts is None:
        return np.maximum(_forward(v, c, n, entry)[0][n : n + m].T, _NONE)
    head = _forward(v, c[: cuts[0]], cuts[0], entry)[0][cuts[0]]
    tail = _forward(v, c[cuts[1] :], n - cuts[1], entry[:1, :1])[0][n - cuts[1] : n - cuts[1] + m, 0]
    return np.maximum(head[:, None] + best_sum(v, c[cuts[0] : cuts[1]]) + tail[None, :], _NONE)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices (or stacks of them)."""
    out = np.full(np.broadcast_shapes(a.shape, b.shape), _NONE, np.int64)
    for j in range(a.shape[-1]):
        np.maximum(out, a[..., :, j, None] + b[..., None, j, :], out=out)
    return np.maximum(out, _NONE)


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """Products of all prefixes, in log2(n) rounds of independent products."""
    out = matrices.copy()
    step = 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def _back(v: Vocabulary, c: np.ndarray, n: int, scores: np.ndarray, ends: range) -> list[tuple[int, int, list[int]]]:
    """For each reachable one of ``ends``: it, the entry state that leads there, and the ids."""
    best, edges = _forward(v, c, n, scores[:, None].astype(np.int64))
    best = best[:, 0]
    out = []
    for end in ends:
        t = end
        if t >= len(best) or best[t] <= _NONE // 2:
            continue
        ids: list[int] = []
        while t > 0:
            if t < len(scores) and scores[t] == best[t] and scores[t] > _NONE // 2:
                break  # the piece across the left border is the longest of those that tie
            for k, i, s in reversed(edges[t] if t < len(edges) else []):
                if best[t - k] + s == best[t]:
                    ids.extend([i])
                    t -= k
                    break
            else:
                ids.extend(reversed(_spelled(v, int(c[t - 1]))))
                t -= 1
        out.append((end, t, ids[::-1]))
    return out


def backtrace(v: Vocabulary, c: np.ndarray, n: int, scores: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """For each state the chunk may end in: (that state, the state it then begins in, ids of
    the pieces that begin in the chunk). ``scores``: best score of each state at its left border."""
    cuts = _cuts(v, c, n)
    if cuts is None:
        return [(e - n, b, ids) for e, b, ids in _back(v, c, n, scores, range(n, n + v.longest))]
    first, last = cuts
    [(_, entry, head)] = _back(v, c[:first], first, scores, range(first, first + 1)) if first else [(0, 0, [])]
    middle = encode_codes(v, c[first:last], np.array([0, last - first]))[0].tolist() if last > first else []
    start = np.zeros(1, np.int64)
    tails = _back(v, c[last:], n - last, start, range(n - last, n - last + v.longest))
    return [(e - (n - last), entry, head + middle + ids) for e, _, ids in tails]


CHUNKS = "text_key string, chunk_no int, n int, codes binary"


def giant_chunks(giants: DataFrame, v: Vocabulary, chunk: int) -> DataFrame:
    """Chunk rows of giant texts: n characters, and those a piece across the border may take."""
    ahead = v.longest - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                key, c = batch.column("text_key")[row].as_py(), normalized(batch.column("text")[row].as_py())
                for i, s in enumerate(range(0, len(c), chunk)):
                    n = min(chunk, len(c) - s)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([c[s : s + n + ahead].tobytes()], pa.binary())], names=["text_key", "chunk_no", "n", "codes"])

    return giants.mapInArrow(cut, CHUNKS)


def scan_chunks(chunks: DataFrame, v: Vocabulary) -> DataFrame:
    """(text_key, ids) of chunked texts: matrices, their scan per text, traces per chunk."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [transfer(v, np.frombuffer(c.as_buffer(), np.uint32), n.as_py()).tobytes() for c, n in zip(batch.column("codes"), batch.column("n"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("chunk_no"), pa.array(m, pa.binary())], names=["text_key", "chunk_no", "matrix"])

    def scan(table: pa.Table) -> pa.Table:
        """About 2 KB a chunk, so a text's matrices are a small part of the text itself."""
        table = table.sort_by("chunk_no")
        m = v.longest
        steps = prefix_products(np.stack([np.frombuffer(x, np.int64).reshape(m, m) for x in table.column("matrix").to_pylist()]))
        start = np.full(m, _NONE, np.int64)
        start[0] = 0
        rows = [start, *steps[:-1, 0]]
        return pa.table({"text_key": table.column("text_key"), "chunk_no": table.column("chunk_no"), "scores": pa.array([r.tobytes() for r in rows], pa.binary())})

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                c, n, s = (batch.column(x)[row] for x in ("codes", "n", "scores"))
                found = backtrace(v, np.frombuffer(c.as_buffer(), np.uint32), n.as_py(), np.frombuffer(s.as_buffer(), np.int64))
                same = pa.array(np.full(len(found), row))
                ends, begins, ids = (pa.array([o[k] for o in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays([batch.column("text_key").take(same), batch.column("chunk_no").take(same), ends, begins, ids], names=["text_key", "chunk_no", "ends", "begins", "ids"])

    def choose(table: pa.Table) -> pa.Table:
        """From the last chunk on, the trace that ends where the next one's begins."""
        begins = {x: b for *x, b in zip(*(table.column(c).to_pylist() for c in ("chunk_no", "ends", "begins")), strict=True) for x in [tuple(x)]}
        state, path = 0, []
        for chunk in range(max(x[0] for x in begins), -1, -1):
            path.append((chunk, state))
            state = begins[chunk, state]
        return pa.table({"text_key": pa.array([table.column("text_key")[0].as_py()] * len(path)), **{c: pa.array(x, pa.int32()) for c, x in zip(("chunk_no", "ends"), zip(*path, strict=True), strict=True)}})

    def assemble(table: pa.Table) -> pa.Table:
        ids = table.sort_by("chunk_no").column("ids").combine_chunks().flatten()
        return pa.table({"text_key": table.column("text_key")[:1], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})

    scores = chunks.mapInArrow(matrices, "text_key string, chunk_no int, matrix binary").groupBy("text_key").applyInArrow(scan, "text_key string, chunk_no int, scores binary")
    traced = chunks.join(scores, ["text_key", "chunk_no"]).select("text_key", "chunk_no", "n", "codes", "scores").mapInArrow(traces, "text_key string, chunk_no int, ends int, begins int, ids array<int>")
    traced = materialize(traced, "traces")
    path = traced.drop("ids").groupBy("text_key").applyInArrow(choose, "text_key string, chunk_no int, ends int")
    chosen = traced.join(path, ["text_key", "chunk_no", "ends"]).select("text_key", "chunk_no", "ids")
    return chosen.groupBy("text_key").applyInArrow(assemble, "text_key string, ids array<int>")


def encode(docs: DataFrame, v: Vocabulary, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """The rows with the ids of their texts, in place of any column of that name. Texts of
    more than ``chunk`` characters go through the scan; they are written once so that both
    uses see the same rows."""
    docs = docs.drop(ids_col)
    schema = StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))])
    at = docs.columns.index(text_col)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in batches:
            keyed = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in W.slices(keyed, f"c{at}", 1 << 20):
                ids = encode_texts(v, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=names)
            del keyed, part, batch
            W.release()

    size = F.coalesce(F.length(text_col), F.lit(0))
    small = docs.where(size <= chunk).mapInArrow(short, schema)
    # the rows' own columns go in a struct, so that they may have any names
    giants = docs.where(size > chunk).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.expr("uuid()").alias("text_key"))
    giants = materialize(giants, "giants")
    chunks = materialize(giant_chunks(giants.select("text_key", F.col("row")[text_col].alias("text")), v, chunk), "chunks")
    found = scan_chunks(chunks, v).select("text_key", F.col("ids").alias("found"))
    large = giants.join(found, "text_key").select("row", "found").select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("found").alias(ids_col))
    return small.union(large)


def decode(rows: DataFrame, v: Vocabulary, ids_col: str = "ids", text_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """The rows with the texts of their ids, in place of any column of that name, and with the
    ids unless told otherwise."""
    at = rows.columns.index(ids_col)
    kept = [i for i, name in enumerate(rows.columns) if (keep_ids or i != at) and name != text_col]
    schema = StructType([*(rows.schema[i] for i in kept), StructField(text_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.slice(s, 500)
                lists = part.column(at)
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                known = lists.is_valid().to_numpy(zero_copy_only=False)
                texts = [decode_ids(v, flat[b:e].tolist()) if k else None for b, e, k in zip(ends[:-1].tolist(), ends[1:].tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(texts, pa.string())], names=[f.name for f in schema])
            del batch
            W.release()

    return rows.mapInArrow(run, schema)
