"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's set holds its distinct word shingles. Each of ``places`` hash functions keeps
b = 16 bits of the least hash in the set, so two sets agree in a place with a chance of
their Jaccard similarity (and of 2 ** -16 besides). The distance of two signatures is the
number of places in which they differ.

Signatures are split into chunks of ``chunk`` places. If two differ in at most
``distance`` = chunks * (errors + 1) - 1 places, some chunk differs in at most ``errors``
(pigeonhole). Errors are enumerated by the places that they are at: with each choice of them left
out, the rest of the chunk is a key, and all pairs within the distance share a key. That holds
for every pair of signatures, whatever the data.

Which pairs of *sets* are within the distance is a matter of chance: with 80 places and a
distance of 39 (half of them less one), a pair of similarity 0.8 is beyond it twice in 10 ** 9,
and a more similar one less often. Pairs within the distance are confirmed on their full sets, so no
link is false; those whose sizes or parities of elements already rule that out aren't fetched for it.

Keys go through the join of ngram_join.py: blocks of documents ask which keys two
different sets have, equal sets are one class, classes meet one leader of each key, links are closed
to components, and what shares a key across components is compared. A key of very many classes is combined
with the keys of further signatures (of hash functions of their own) and cut into tiles. No pairs of a
group are written but links.

Defined cases: texts that are null, empty or blank have no shingles and link with nothing;
a text with fewer words than a shingle has its whole sequence as one. Repeated rows are equal
sets, and of those with one id all are kept if that id is. A null id joins the component of its class, or has
none; it is kept only where it has none. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import words as W
from fabula.llm.ngram_join import jaccard_components, parity, parity_allows

#: 64-bit words of the parity sketch that stands after a signature.
PARITY = 8
#: Elements that go through all hash functions at once.
_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class HammingIndex:
    """Similarity num/den at least, found by signatures of ``places`` places of 16 bits."""

    words: int = 2
    num: int = 80
    den: int = 100
    places: int = 80
    chunk: int = 4
    errors: int = 1
    seed: int = 20241105
    #: Rounds of comparing classes with one leader of each key, before all that is left is compared.
    turns: int = 1

    def __post_init__(self):
        if self.chunk != 4 or self.places % 4:
            raise ValueError("a chunk is 4 places of 16 bits, one 64-bit word")

    @property
    def distance(self) -> int:
        """Places in which signatures may differ and still share a key."""
        return self.chunks * (self.errors + 1) - 1

    @property
    def chunks(self) -> int:
        """One 64-bit word each."""
        return self.places // self.chunk

    @property
    def width(self) -> int:
        return self.chunks + PARITY

    def sketches(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.concatenate([self.minima(value, first), parity(value, first, PARITY)], axis=1)

    def minima(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The signature of each set value[first[i]:first[i + 1]]; of an empty one all ones."""
        factors = np.random.default_rng(self.seed).integers(0, 2**63, self.places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        least = np.full((len(first) - 1, self.places), 2**64 - 1, np.uint64)
        for lo in range(0, len(value), _AT_ONCE):
            part = value[lo : lo + _AT_ONCE]
            begin, end = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, lo + len(part)))
            sets = np.arange(begin, end)
            sets = sets[np.diff(first)[begin:end] > 0]
            at = np.maximum(first[sets] - lo, 0)
            for k, a in enumerate(factors):
                least[sets, k] = np.minimum(least[sets, k], np.minimum.reduceat(part * a, at))
        # the top bits of a least hash are mostly zeros, so they are mixed first
        return W.mix(least).astype(np.uint16).view(np.uint64).reshape(len(least), self.chunks)

    def _choices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key of a signature: its chunk, the places that it keeps, and what tells it
        from other keys of the same value."""
        left_out = list(combinations(range(self.chunk), self.errors))
        masks = [sum(0xFFFF << 16 * i for i in range(self.chunk) if i not in out) for out in left_out]
        chunk = np.repeat(np.arange(self.chunks), len(masks))
        return chunk, np.tile(np.array(masks, np.uint64), self.chunks), W.mix(np.arange(1, len(chunk) + 1, dtype=np.uint64))

    def signatures(self, value: np.ndarray, first: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all sets, and the set of each."""
        some = np.flatnonzero(np.diff(first) > 0)
        chunk, mask, salt = self._choices()
        keys = W.mix((self.minima(value, first)[some][:, chunk] & mask) ^ salt)
        return keys.ravel(), np.repeat(some, len(chunk))

    def first_key(self, s_a: np.ndarray, s_b: np.ndarray) -> np.ndarray:
        """The first key that both of a pair within the distance have."""
        chunk, mask, salt = self._choices()
        at = ((s_a[:, chunk] ^ s_b[:, chunk]) & mask == 0).argmax(1)
        return W.mix((s_a[np.arange(len(s_a)), chunk[at]] & mask[at]) ^ salt[at])

    def within(self, s_a: np.ndarray, s_b: np.ndarray) -> np.ndarray:
        """Whether two signatures are within the distance."""
        return ((s_a ^ s_b).view(np.uint16) != 0).sum(1) <= self.distance

    def may_link(self, n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray) -> np.ndarray:
        at = self.chunks
        ok = parity_allows(self.num, self.den, n_a, s_a[:, at:], n_b, s_b[:, at:])
        ok[ok] = self.within(np.ascontiguousarray(s_a[ok, :at]), np.ascontiguousarray(s_b[ok, :at]))
        return ok

    def find_common(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Shingles that many documents have need no place of their own here."""


def near_duplicates(docs: DataFrame, index: HammingIndex = HammingIndex(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest id that links lead to) and kept, which is
    true for the document of that id alone."""
    found = jaccard_components(docs, index, id_col, text_col)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
