"""Language-model scores from a weighted backoff automaton.

States are the empty context, each word and each pair of words seen in training as a
context. A state's arcs are all the n-grams seen in training with their smoothed
probabilities, up to three words; where no arc fits, a failure arc leads to the context
that is shorter by a word at the cost of its backoff weight, from the empty context at
last to the unknown word. A text is read once from left to right; the last two words are
the next state, and log-probabilities add up. Words that training has not seen are one
event, as in the base score, and its probability is what discounting leaves of the empty
context; so the model's probabilities of all next events add up to 1. ``least_count``
can leave out the longer n-grams that are rare; it is 1, which leaves out none.

Counts cover all training texts and grow with them, so no task holds them all:
blocks of documents ask for the counts of the words, pairs and triples they contain
(exchange.py) and each traverses the part of the automaton that its own texts can
reach. The bucket that counts an n-gram also names one of the blocks that asked for it its
owner. Owners add up the arcs of each context, and in a second exchange blocks ask
for these sums, the backoff weights, of their own contexts. So no list of contexts is sent
to all tasks, and no task gets all n-grams of a frequent context.

Defined cases: a null or empty text has the end token only. Without training texts
every token is the unknown event, with probability 1. Repeated rows count as often
as they come and each gets its score; a null id is never held out. An empty table
gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import exchange as X
from fabula.llm import words as W
from fabula.llm.cluster import block_count, block_of, materialize
from fabula.llm.langid import held_out

#: What each arc's count is discounted by; sums of counts are kept in these parts of one.
_CUT, _PARTS = 3, 4
DISCOUNT = _CUT / _PARTS
END = np.uint64(0x5EED0FE4D)
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts, an end after each text's last; and each text's first index."""
    h, first = W.hash_words(data, at, W.BLANK_SEPARATED)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _documents(docs: DataFrame, id_col: str, text_col: str, of: int, rest: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col, of, rest).alias("held_out"))


@dataclass
class Automaton:
    """What every task needs: the totals, and the least count that makes a pair or triple an arc."""

    total: int
    types: int
    least: int = 1

    @property
    def floor(self) -> float:
        """log10 of the empty context's backoff weight, the unknown word's probability."""
        return float(np.log10(DISCOUNT * self.types / self.total)) if self.total else 0.0


class _Grams:
    """The distinct n-grams of a block: their keys, the tokens they end at, and for each its
    first token; ``at`` are the tokens that have one."""

    def __init__(self, keys: np.ndarray, at: np.ndarray | None = None):
        self.keys, first, self.of = np.unique(keys, return_index=True, return_inverse=True)
        self.at = at
        self.first = first if at is None else at[first]

    def counts(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, train if self.at is None else train[self.at], len(self.keys)).astype(np.int64)


@dataclass
class _Block:
    """Tokens of a block, its distinct words, pairs and triples. A text begins in the state of
    the end token, which is also the block's last; its first word ends no triple."""

    table: pa.Table
    buckets: int

    def __post_init__(self):
        parts = [p for b in self.table.combine_chunks().to_batches() for p in W.slices(b, "text", 1 << 20)]
        got = [tokens(*W.buffers(p.column("text"))) for p in parts]
        self.token = np.concatenate([t for t, _ in got])
        self.size = np.concatenate([np.diff(f) for _, f in got])

    @cached_property
    def words(self) -> _Grams:
        return _Grams(self.token)

    @property
    def _pair(self) -> np.ndarray:
        return W.mix(np.roll(self.token, 1) * np.uint64(W._BASE) + self.token)

    @cached_property
    def pairs(self) -> _Grams:
        return _Grams(self._pair)

    @cached_property
    def triples(self) -> _Grams:
        deep = np.ones(len(self.token), bool)
        deep[np.cumsum(self.size) - self.size] = False
        at = np.flatnonzero(deep)
        return _Grams(W.mix(self._pair[at - 1] * np.uint64(W._BASE) + self.token[at]), at)

    @property
    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The context of each pair, a word, and of each triple, a pair."""
        return self.words.of[self.pairs.first - 1], self.pairs.of[self.triples.first - 1]

    def _asked(self, kind: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        rows = X.asked(self.table.column("block")[0].as_py(), keys, values, self.buckets)
        return rows.set_column(0, X._ASK.field(0), pc.add(rows.column(0), pa.scalar(kind * self.buckets, pa.int32())))

    def _answered(self, answers: pa.Table, kind: int) -> np.ndarray:
        number = answers.column("bucket").to_numpy()
        return X.answered(answers.filter(pa.array(number // self.buckets == kind))).astype(np.int64)

    def ask(self, kinds: tuple[int, ...]) -> pa.Table:
        train = np.repeat(~self.table.column("held_out").to_numpy().astype(bool), self.size)
        grams = ((kind, getattr(self, ("words", "pairs", "triples")[kind])) for kind in kinds)
        return pa.Table.from_batches([self._asked(kind, g.keys, g.counts(train)) for kind, g in grams])

    def counts(self, answers: pa.Table, least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Training counts of the block's words, pairs and triples, those of contexts as they
        are and those of arcs; and which arcs it owns."""
        words, *longer = (self._answered(answers, kind) for kind in range(3))
        arcs = [np.where(x >> 1 >= least, x >> 1, 0) for x in longer]
        return [words, longer[0] >> 1, *arcs], [(x & 1).astype(bool) for x in longer]

    def ask_taken(self, answers: pa.Table, model: Automaton) -> pa.Table:
        """What the block's own arcs take of each context: their counts less what each is
        discounted by, in quarters."""
        (words, pairs, *arcs), own = self.counts(answers, model.least)
        out = []
        for kind, (count, grams, arc, mine, context) in enumerate(zip((words, pairs), (self.words, self.pairs), arcs, own, self.contexts, strict=True)):
            use = mine & (arc > 0)
            taken = np.bincount(context[use], arc[use] * _PARTS - _CUT, len(count)).astype(np.int64)
            out.append(self._asked(3 + kind, grams.keys[count > 0], taken[count > 0]))
        return pa.Table.from_batches(out)

    def scores(self, answers: pa.Table, model: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and model score of each text."""
        (words, pairs, *arcs), _ = self.counts(answers, model.least)
        c = words[self.words.of]
        known = c > 0
        base = np.log10((c + 0.5) / (model.total + 0.5 * (model.types + 1)))
        here = np.full(len(c), model.floor)
        here[known] = np.log10((c[known] - DISCOUNT) / max(model.total, 1))
        for kind, (count, grams, arc, longer) in enumerate(zip((words, pairs), (self.words, self.pairs), arcs, (self.pairs, self.triples), strict=True)):
            left = np.zeros(len(count))  # what the arcs of a state leave is its backoff weight
            left[count > 0] = count[count > 0] - self._answered(answers, 3 + kind) / _PARTS
            at = np.arange(len(c)) if longer.at is None else longer.at
            state, n = grams.of[at - 1], arc[longer.of]
            inside = count[state] > 0
            at, state, n = at[inside], state[inside], n[inside]
            here[at] += np.log10(np.maximum(left[state] / count[state], 1e-12))
            seen = n > 0
            at = at[seen]
            here[at] = np.log10((n[seen] - DISCOUNT) / count[state[seen]] + 10.0 ** here[at])
        ends = np.cumsum(self.size)
        sums = lambda x: np.add.reduceat(x, ends - self.size)
        return sums(known.astype(np.int64)), sums(base), sums(here)


def _counts(d: DataFrame, buckets: int, kinds: tuple[int, ...]) -> DataFrame:
    """Training counts of every block's words, and from bucket ``buckets`` on of its pairs and
    triples, as far as ``kinds`` ask for them, doubled, with 1 more for the owner; rows of block -1 have the tokens and types
    of each bucket of words."""

    def ask(table: pa.Table) -> pa.Table:
        W.release()
        return _Block(table, buckets).ask(kinds)

    def combine(table: pa.Table) -> pa.Table:
        W.release()
        rows = table.select(["block", "bucket", "keys", "values"]).to_pylist()
        keys, first, back = np.unique(np.concatenate([X.unpack_keys(r["keys"]) for r in rows]), return_index=True, return_inverse=True)
        counts = np.bincount(back, np.concatenate([X.unpack_numbers(r["values"]) for r in rows]), len(keys)).astype(np.int64)
        bucket = rows[0]["bucket"]
        per_entry = counts[back]
        out, at = [], 0
        if bucket < buckets:
            out.append({"block": -1, "bucket": bucket, "totals": X.pack_numbers(np.array([counts.sum(), (counts > 0).sum()]))})
        else:
            per_entry *= 2
            per_entry[first] += 1
        for r in rows:
            n = len(r["keys"]) // 8
            out.append({"block": r["block"], "bucket": bucket, "totals": X.pack_numbers(per_entry[at : at + n])})
            at += n
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())]))

    return d.groupBy("block").applyInArrow(ask, X.ASK).groupBy("bucket").applyInArrow(combine, X.ANSWER)


def _automaton(counts: DataFrame, least: int) -> Automaton:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([X.unpack_numbers(t) for t in batch.column("totals").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, j].copy()) for j in range(2)], names=["total", "types"])

    rows = counts.where("block = -1").select("totals").mapInArrow(unpack, "total bigint, types bigint")
    total, types = (int(x or 0) for x in rows.agg(F.sum("total"), F.sum("types")).first())
    return Automaton(total, types, least)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int = 5, rest: int = 1, least_count: int = 1) -> DataFrame:
    """Learns from the rows that are not held out and scores all of them. Pairs and triples
    seen less often than ``least_count`` are no arcs."""
    buckets = block_count(docs, text_col)
    d = _documents(docs, id_col, text_col, of, rest).withColumn("block", block_of(buckets, "doc_id", "text"))
    # one after the other, so that the keys of both are never on disk at once
    counts = materialize(_counts(d, buckets, (0, 1)), "counts")
    model = _automaton(counts, least_count)
    counts = counts.where("block >= 0").union(materialize(_counts(d, buckets, (2,)), "counts"))

    def ask(key: tuple, given: pa.Table, table: pa.Table) -> pa.Table:
        W.release()
        return _Block(table, buckets).ask_taken(given, model)

    asks = counts.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(ask, X.ASK)
    taken = materialize(X.answer(asks, lambda back, values, n: np.bincount(back, values, n).astype(np.int64)), "taken")
    answers = counts.union(taken.select("block", "bucket", "totals"))

    def traverse(key: tuple, given: pa.Table, table: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        W.release()
        if not len(table):
            return schema.empty_table()
        b = _Block(table, buckets)
        known, base, score = b.scores(given, model)
        columns = [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), b.size, known, np.full(len(b.size), model.total), base, score]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return answers.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(traverse, SCORES)
