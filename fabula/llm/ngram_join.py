"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles. Sets fall into bands of sizes;
two sets as similar as asked for are in the same band or in neighbouring ones, and
differ in at most k elements, k depending on the band. The feature domain is
divided into n1 groups of n2 parts. With n1 large enough, some group of two such
sets differs in at most k2 elements, so n2 - k2 of its parts are equal: the hash of
each subset of n2 - k2 parts in each group is a signature, and similar sets share
one. No similar pair is lost, and nothing is drawn at random.

A subset without elements says nothing, and all sets that lack one would meet
there. Each band has m groups more than the argument needs, so a set with at most m
such groups leaves their signatures out; any other set repeats the signatures with
another division of the domain (both sets of a pair have the signatures of the
first division that serves one of them).

The domain may be divided in any way, so the first division sets the shingles that
many documents have apart: a passage that many documents share then makes no
signatures. Sets that consist of such shingles use the next, random, division.

Blocks of documents ask which signatures occur with two different sets anywhere
(exchange.py). Only sets that have such a signature go on, with those signatures.
Equal sets are one class from there on. Each signature's classes are compared with
one leader among them, and links are closed to components, a few times over; then
every two classes that share a signature but no component are compared, so the
components are exact without the pairs within a group. Signatures that many classes still
share by then, like those of a passage in unlike documents, are combined with signatures of
further divisions, and what stays large is compared tile by tile. Pairs of which the parity
sketches differ in more bits than similar sets differ in elements are left out
before the sets themselves are fetched; that loses none.

Defined cases: texts that are null, empty or blank have no shingles and link with
nothing; a text with fewer words than a shingle has its whole sequence as one.
Repeated rows are equal sets. A null id joins the component of its class, or has
none. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import exchange as X
from fabula.llm import words as W
from fabula.llm.cluster import block_count, block_of, materialize, scratch
from fabula.operators.components import stars

FEATURES = "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, signatures array<bigint>, shingles array<bigint>, sketch array<bigint>"
#: 64-bit words of the parity sketch that goes with a set.
SKETCH = 16
#: Documents counted to find common shingles, the share of them that makes one, and how many
#: are used (8 bytes each, sent to every task).
SAMPLE_DOCS, COMMON_SHARE, MOST_COMMON = 20_000, 2e-4, 200_000
#: Bytes of a signature that blocks ask about; should two agree in these, a few sets go on in vain.
KEY_BYTES = 6
#: Rounds of comparing with one leader of each signature, before all that is left is compared.
LEADER_TURNS = 2
#: Classes that are compared with each other because they share one signature; larger groups
#: are divided further. A division makes about GROWTH rows of one, each of which costs as much
#: as some hundred comparisons of sketches; below this size comparing is less work. What a
#: division has left is divided again only where it is so many times larger.
TOGETHER, GROWTH, LEVELS = 1 << 15, 64, 4
#: Classes of one signature that meet under one key when all that are left are compared, and
#: pairs that a task looks at at once.
TILE, PAIRS_AT_ONCE = 2048, 1 << 16


def parity(value: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """For each set value[first[i]:first[i + 1]] the parity of its elements in each of words * 64 cells."""
    n, cells = len(first) - 1, words * 64
    bit = W.mix(value ^ np.uint64(0x7E57)) % np.uint64(cells)
    owner = np.repeat(np.arange(n), np.diff(first))
    count = np.bincount(owner * cells + bit.astype(np.int64), minlength=n * cells)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.uint64).reshape(n, words)


def parity_allows(num: int, den: int, n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray) -> np.ndarray:
    """False only for pairs that can't be similar enough: sketches differ in at most as many
    bits as the sets do in elements, and similar sets differ in few for their sizes."""
    bits = np.bitwise_count(s_a ^ s_b).sum(1, dtype=np.int64)
    return (den + num) * bits <= (den - num) * (n_a + n_b)


@dataclass(frozen=True)
class PartEnum:
    """Similarity num/den at least; k2 and n2 are the second level of the division."""

    words: int = 3
    num: int = 90
    den: int = 100
    k2: int = 1
    n2: int = 2
    divisions: int = 16

    #: 64-bit words of the sketch that goes with a set; rounds of comparing with leaders.
    width, turns = SKETCH, LEADER_TURNS

    def signatures(self, value: np.ndarray, first: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return signatures(self, value, first, common)

    def sketches(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return parity(value, first, SKETCH)

    def may_link(self, n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray) -> np.ndarray:
        """For each pair of sets, by sizes and sketches, whether it may be similar enough."""
        return parity_allows(self.num, self.den, n_a, s_a, n_b, s_b)

    def first_key(self, s_a: np.ndarray, s_b: np.ndarray) -> np.ndarray | None:
        """For each pair of sketches the one signature under which the pair counts, if they tell it."""
        return None

    def find_common(self, docs: DataFrame, id_col: str, text_col: str) -> np.ndarray | None:
        return common_shingles(docs, self, id_col, text_col)

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray]:
        return _bands(self, 1 << max(4, int(largest).bit_length()))

    def band_table(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each band: its first size, k, n1 and the spare groups m."""
        return _table(self, 1 << max(4, int(largest).bit_length()))


@lru_cache(8)
def _bands(p: PartEnum, largest: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = [], []
    size = 1
    while size <= largest:
        low.append(size)
        high.append(max(size, size * p.den // p.num))
        size = high[-1] + 1
    low.append(size)
    high.append(max(size, size * p.den // p.num))
    return np.array(low), np.array(high)


@lru_cache(8)
def _table(p: PartEnum, largest: int):
    low, high = _bands(p, largest)
    k = (p.den - p.num) * 2 * high // (p.den + p.num)
    n1, spare = [], []
    for i in range(len(low)):
        base = -(-(int(k[i]) + 1) // (p.k2 + 1))
        smallest = int(low[max(0, i - 1)])
        best = base // 2
        for m in range(base + 8):
            part = math.exp(-smallest * (p.n2 - p.k2) / ((base + m) * p.n2))  # a subset has no element
            bad = (base + m) * min(1.0, math.comb(p.n2, p.k2) * part)
            if m >= bad:  # every other set at least needs no further division
                best = m
                break
        n1.append(base + best)
        spare.append(best)
    return low, k, np.array(n1), np.array(spare)


def signatures(p: PartEnum, value: np.ndarray, first: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets value[first[i]:first[i + 1]], and the set of each.

    The first division has one group more, which holds the ``common`` elements (sorted)
    and gives no signature: it takes the place of a spare group.
    """
    rare = np.ones(len(value), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] != value
    size = np.diff(first)
    low, k, n1s, spare = p.band_table(int(size.max(initial=1)))
    band = np.searchsorted(low, size, "right") - 1
    keys, owners = [], []
    for step in (0, 1):
        instance = np.clip(band + step, 0, len(low) - 1)
        todo = np.flatnonzero((size > 0) & (k[instance] > 0))  # k = 0: only equal sets
        for division in range(p.divisions):
            if not len(todo):
                break
            last = division == p.divisions - 1
            n1 = n1s[instance[todo]]
            group0 = np.concatenate([[0], np.cumsum(n1)])
            count = size[todo]
            who = np.repeat(np.arange(len(todo)), count)
            at = first[:-1][todo][who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            if not division:
                who, at = who[rare[at]], at[rare[at]]
            v = W.mix(value[at] + np.uint64(0x9E3779B97F4A7C15 * (division + 1) % 2**64))
            group = group0[who] + (v % n1[who].astype(np.uint64)).astype(np.int64)
            part = group * p.n2 + ((v >> np.uint64(40)) % np.uint64(p.n2)).astype(np.int64)
            total = np.zeros(int(group0[-1]) * p.n2, np.uint64)
            np.add.at(total, part, W.mix(value[at] ^ np.uint64(0xA24BAED4963EE407)))
            filled = (np.bincount(part, minlength=len(total)) > 0).reshape(-1, p.n2)
            total = total.reshape(-1, p.n2)
            owner = np.repeat(np.arange(len(todo)), n1)
            name = W.mix((np.repeat(instance[todo], n1).astype(np.uint64) << np.uint64(32)) + np.uint64(division) + ((np.arange(len(owner)) - group0[:-1][owner]).astype(np.uint64) << np.uint64(8)))
            empty = np.zeros(len(owner), bool)
            found = []
            for c, subset in enumerate(combinations(range(p.n2), p.n2 - p.k2)):
                s = name + np.uint64(c)
                some = np.zeros(len(owner), bool)
                for j in subset:
                    s = W.mix(s + total[:, j])
                    some |= filled[:, j]
                empty |= ~some
                found.append((s, some))
            bad = np.bincount(owner, empty, len(todo)) > spare[instance[todo]]
            for s, some in found:
                use = some | bad[owner] if last else some
                keys.append(s[use])
                owners.append(todo[owner[use]])
            todo = todo[bad]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class _Block:
    """The sets of one block of documents."""

    p: PartEnum
    table: pa.Table
    common: np.ndarray | None = None

    def __post_init__(self):
        values, counts, keys, owners, base = [], [], [], [], 0
        for batch in self.table.combine_chunks().to_batches():
            for part in W.slices(batch, "text", 2 << 20):
                h, first = W.hash_words(*W.buffers(part.column("text")), W.BLANK_SEPARATED)
                v, at = W.shingles(h, first, self.p.words)
                k, o = self.p.signatures(v, at, self.common)
                values.append(v)
                counts.append(np.diff(at))
                keys.append(k)
                owners.append(o + base)
                base += len(part)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.value, self.size = join(values, np.uint64), join(counts, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.key, self.owner = join(keys, np.uint64), join(owners, np.int64)
        mark = lambda salt: self._sum(W.mix(self.value ^ np.uint64(salt)))
        self.hi, self.lo = mark(0x1234567), mark(0xFEDCBA9876543)
        order = np.argsort(self.key, kind="stable")
        self.key, self.owner = self.key[order], self.owner[order]
        new = np.ones(len(self.key), bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.start = np.flatnonzero(new)
        self.nth = np.cumsum(new) - 1

    def _sum(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
        return W.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64))

    def sketches(self, keep: np.ndarray) -> np.ndarray:
        return self.p.sketches(self.value[np.repeat(keep, self.size)], np.concatenate([[0], np.cumsum(self.size[keep])]))

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct signatures, and for each 32 bits of its set, or 0 where two sets
        of the block have it. The bits depend on the signature too, so that two sets
        which share several would have to collide in each."""
        if not len(self.key):
            return self.key, np.zeros(0, np.uint32)
        own = W.mix(self.hi[self.owner] ^ self.key).astype(np.uint32) | np.uint32(1)
        least, most = np.minimum.reduceat(own, self.start), np.maximum.reduceat(own, self.start)
        return self.key[self.start], np.where(least == most, least, 0).astype(np.uint32)


def _shared(nth: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    least, most = np.full(n, 2**32 - 1, np.uint64), np.zeros(n, np.uint64)
    np.minimum.at(least, nth, value)
    np.maximum.at(most, nth, value)
    return ((least != most) | (least == 0)).astype(np.uint8)


def common_shingles(docs: DataFrame, p: PartEnum, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Shingles that many documents have, as counted in a sample of about SAMPLE_DOCS.

    They only decide how the domain is divided, and every division finds all links;
    so a sample, and the most frequent ones of each of 16 buckets, will do.
    """
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30))
    sample = docs.where(place < int(share * (1 << 30))).select(F.col(text_col).alias("text"))
    least = max(4, math.ceil(COMMON_SHARE * min(total, SAMPLE_DOCS)))

    def count(batches):
        for batch in batches:
            for part in W.slices(batch, "text", 2 << 20):
                v, _ = W.shingles(*W.hash_words(*W.buffers(part.column("text")), W.BLANK_SEPARATED), p.words)
                keys, n = np.unique(v, return_counts=True)
                yield X.asked(0, keys, n.astype(np.int32), 16)
            W.release()

    def keep(table: pa.Table) -> pa.Table:
        rows = table.select(["keys", "values"]).to_pylist()
        keys, back = np.unique(np.concatenate([X.unpack_keys(r["keys"]) for r in rows]), return_inverse=True)
        n = np.bincount(back, np.concatenate([X.unpack_numbers(r["values"]) for r in rows]), len(keys))
        often = np.flatnonzero(n >= least)
        top = often[np.lexsort((keys[often], -n[often]))[: MOST_COMMON // 16]]
        return pa.table({"keys": pa.array([np.sort(keys[top]).tobytes()], pa.binary())})

    found = sample.mapInArrow(count, X.ASK).groupBy("bucket").applyInArrow(keep, "keys binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in found)]))


def shingle_features(docs: DataFrame, p: PartEnum, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size and fingerprint of each document's set; for those that share a signature with
    a different set also these signatures and the set itself."""
    blocks = block_count(docs, text_col)
    common = p.find_common(docs, id_col, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("block", block_of(blocks, "doc_id", "text"))

    def ask(table: pa.Table) -> pa.Table:
        keys, marks = _Block(p, table, common).marks()
        W.release()
        return pa.Table.from_batches([X.asked(table.column("block")[0].as_py(), keys, marks, blocks, KEY_BYTES)])

    def expand(key: tuple, answers: pa.Table, table: pa.Table) -> pa.Table:
        out = features(answers, table)
        W.release()
        return out

    def features(answers: pa.Table, table: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("signatures", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
        if not len(table):
            return schema.empty_table()
        b = _Block(p, table, common)
        flags = X.answered(answers)
        use = flags[b.nth] > 0 if len(b.nth) else np.zeros(0, bool)
        owner, key64 = b.owner[use], b.key[use]
        order = np.argsort(owner, kind="stable")
        owner, key64 = owner[order], key64[order].view(np.int64)
        n = len(b.size)
        sig_at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        keep = np.diff(sig_at) > 0
        kept = np.repeat(keep, b.size)
        set_at = np.concatenate([[0], np.cumsum(np.where(keep, b.size, 0))]).astype(np.int32)
        return pa.Table.from_arrays(
            [
                table.column("doc_id").combine_chunks().cast(pa.int64()),
                pa.array(b.size, pa.int64()),
                pa.array(b.hi.view(np.int64)),
                pa.array(b.lo.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(sig_at), pa.array(key64, pa.int64())),
                pa.ListArray.from_arrays(pa.array(set_at), pa.array(b.value[kept].view(np.int64), pa.int64())),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep * p.width)]).astype(np.int32)), pa.array(b.sketches(keep).ravel().view(np.int64))),
            ],
            schema=schema,
        )

    asks = d.groupBy("block").applyInArrow(ask, X.ASK)
    answers = X.answer(asks, _shared, KEY_BYTES)
    return answers.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(expand, FEATURES)


def _sketches(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)


def _likely(pairs: DataFrame, p: PartEnum) -> DataFrame:
    """The pairs (a, b, n, s, nb, t) that sizes and sketches don't rule out."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                n, nb = part.column("n").to_numpy(), part.column("nb").to_numpy()
                ok = p.may_link(n, _sketches(part.column("s"), p.width), nb, _sketches(part.column("t"), p.width))
                yield part.select(["a", "b"]).filter(pa.array(ok))
            W.release()

    return pairs.select("a", "b", "n", "s", "nb", "t").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, sets: DataFrame, p: PartEnum) -> DataFrame:
    """The pairs (a, b) of which the exact similarity is high enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = p.den * both >= p.num * (F.size("sa") + F.size("sb") - both)
    return pairs.join(a, "a").join(b, "b").where(enough).select("a", "b")


def _open_signatures(at: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows (sig, node, ...) with each node's component, of signatures that still have two."""
    if parts is None:  # as the blocks gave them, all have two
        return at.withColumn("component", F.col("node"))
    placed = at.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("sig", (F.col("sig") % 2).alias("odd")).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
    return materialize(placed.join(several, "sig", "left_semi"), "open-signatures")


def _to_leaders(placed: DataFrame, sketches: DataFrame, p: PartEnum, turn: int) -> DataFrame:
    """Each node with its signatures' leaders, where a link is possible and not known: first
    the nodes of most shared signatures (what all copies come from), later others."""
    rank = F.col("rank") if turn == 0 else F.xxhash64("node", F.lit(turn))
    leader = F.max(F.struct(rank.alias("rank"), F.col("node"), F.col("component"))).alias("lead")
    lead = placed.groupBy("sig", (F.col("sig") % 2).alias("odd")).agg(leader).select("sig", F.col("lead.node").alias("b"), F.col("lead.component").alias("cb"))
    pairs = placed.join(lead, "sig").where("component <> cb")
    pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    one = sketches.select(F.col("node").alias("a"), "n", "s")
    two = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("t"))
    return _likely(pairs.join(one, "a").join(two, "b"), p)


def _finer_signatures(sets: DataFrame, p: PartEnum, level: int) -> DataFrame:
    """(node, sig2): all signatures of the sets with the domain divided anew for ``level``."""
    salt = np.uint64(0x632BE59BD9B4E019 * (level + 1) % 2**64)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                lists = part.column("shingles")
                value = W.mix(lists.flatten().to_numpy().view(np.uint64) ^ salt)
                first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                key, owner = p.signatures(value, first)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(owner)), pa.array(key.view(np.int64))], names=["node", "sig2"])
            W.release()

    return sets.select("node", "shingles").mapInArrow(run, "node bigint, sig2 bigint")


def _refined(placed: DataFrame, near: DataFrame, p: PartEnum) -> DataFrame:
    """Rows (sig, origin, node, component) in which signatures of more than TOGETHER classes, such as
    those of a passage that unlike documents share, are replaced by their combinations with
    those of further divisions. Similar sets share a signature of every division, so no pair
    is lost, and unlike ones would have to agree in each."""
    placed = placed.select("sig", F.col("sig").alias("origin"), "node", "component")
    for level in range(LEVELS):
        large = materialize(placed.groupBy("sig", (F.col("sig") % 2).alias("odd")).agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER * GROWTH**level).select("sig"), "large-signatures")
        if not large.head(1):
            break
        hot = materialize(placed.join(large, "sig", "left_semi"), "large-groups")
        finer = _finer_signatures(near.join(hot.select("node").distinct(), "node", "left_semi"), p, level)
        finer = hot.join(finer, "node").select(F.xxhash64("sig", "sig2").alias("sig"), "origin", "node", "component")
        several = finer.groupBy("sig", (F.col("sig") % 2).alias("odd")).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
        placed = materialize(placed.join(large, "sig", "left_anti").unionByName(finer.join(several, "sig", "left_semi")), "open-signatures")
    return placed


def _tiled(placed: DataFrame) -> DataFrame:
    """The rows with (low, high, side): those of one signature, low and high are to be compared,
    within themselves where low and high are the same, else those of side 0 with those of side 1. A
    signature of more than TILE classes is cut into tiles, and every two tiles meet under a key of
    their own, so no key compares more than about TILE ** 2 pairs, however many classes share it."""
    size = placed.groupBy("sig", (F.col("sig") % 2).alias("odd")).agg(F.count("*").alias("size"))
    large = size.where(F.col("size") > TILE).select("sig", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    rows = placed.join(large, "sig", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    ends = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).cast("int").alias("side")]
    return rows.select(*placed.columns, *ends)


def _pairs_of_runs(key: np.ndarray, side: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): the rows to be compared, in parts. Rows of one ``key`` stand together, those
    of side 0 first, and within a side those of a component; with one side only, each pair is
    given once, and none within a component."""
    n = len(key)
    begins = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    ends = np.append(begins[1:], n)
    run = np.repeat(np.arange(len(begins)), ends - begins)
    ones = np.add.reduceat(side, begins)
    # the first row that a row meets: of the other side, or the next one of another component
    apart = np.flatnonzero(np.diff(key, prepend=key[:1] - 1) | np.diff(component, prepend=component[:1] - 1))
    after = np.append(apart[1:], n)[np.searchsorted(apart, np.arange(n), "right") - 1]
    first = np.where(ones[run] > 0, (ends - ones)[run], after)
    many = np.where(side == 1, 0, ends[run] - first)
    at = np.concatenate([[0], np.cumsum(many)])
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(row, to), many[row:to])
        yield i, first[i] + np.arange(len(i)) - (at[i] - at[row])
        row = to


def _compared(batches: Iterator[pa.RecordBatch], p: PartEnum) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one (sig, low, high) that lie in two components and may be similar enough.
    Batches are sorted by these, the side and the component."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        sig, origin, low, high, side, node, component, n = (table.column(c).to_numpy() for c in ("sig", "origin", "low", "high", "side", "node", "component", "n"))
        s = _sketches(table.column("s").chunk(0), p.width)
        new = np.zeros(len(sig), bool)
        for x in (sig, low, high):
            new[1:] |= x[1:] != x[:-1]
        for i, j in _pairs_of_runs(np.cumsum(new), side.astype(np.int64), component):
            fits = np.flatnonzero((component[i] != component[j]) & (p.num * np.maximum(n[i], n[j]) <= p.den * np.minimum(n[i], n[j])))
            i, j = i[fits], j[fits]
            for at in range(0, len(i), 1 << 13):
                a, b = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
                ok = p.may_link(n[a], s[a], n[b], s[b])
                a, b = a[ok], b[ok]
                once = p.first_key(s[a], s[b])
                if once is not None:
                    here = once.view(np.int64) == origin[a]
                    a, b = a[here], b[here]
                a, b = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        # the last key of a batch may go on in the next one
        sig, low, high = (batch.column(c).to_numpy() for c in ("sig", "low", "high"))
        same = (sig == sig[-1]) & (low == low[-1]) & (high == high[-1])
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if held:
            before = held[-1]
            goes_on = last == 0 and all(before.column(c)[-1].as_py() == x[0] for c, x in zip(("sig", "low", "high"), (sig, low, high), strict=True))
            if goes_on:
                held.append(batch)
                continue
        yield from compare(pa.Table.from_batches([*held, batch.slice(0, last)])) if held or last else ()
        held = [batch.slice(last)]
        W.release()
    if held:
        yield from compare(pa.Table.from_batches(held))
    W.release()


def _across(placed: DataFrame, sketches: DataFrame, near: DataFrame, p: PartEnum) -> DataFrame:
    """Every possible link between two components that share a signature."""
    keys = ["sig", "low", "high"]
    # sketches join last, so that they are dealt by key once
    rows = _tiled(_refined(placed, near, p)).join(sketches, "node").repartition(*keys).sortWithinPartitions(*keys, "side", "component")
    return rows.mapInArrow(lambda batches: _compared(batches, p), "a bigint, b bigint").distinct()


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have a smaller one in their component."""
    if parts is not None:
        links = links.union(parts.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return stars(links).withColumnRenamed("root", "component")


def jaccard_components(docs: DataFrame, p: PartEnum = PartEnum(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id: the smallest id that links lead to. What is written
    on the way goes once this narrow table is."""
    with scratch(docs.sparkSession):
        return materialize(_linked(docs, p, id_col, text_col), "jaccard-components", kept=True)


def _linked(docs: DataFrame, p: PartEnum, id_col: str, text_col: str) -> DataFrame:
    features = materialize(shingle_features(docs, p, id_col, text_col), "shingle-features")
    classes = (
        features.where("n_shingles > 0 and doc_id is not null")
        .groupBy("hi", "lo", "n_shingles")
        .agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("signatures", "shingles", "sketch")))
    )
    classes = materialize(classes, "shingle-classes")
    near = classes.where(F.size("signatures") > 0)
    sketches = near.select("node", F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    at = near.select("node", F.size("signatures").alias("rank"), F.explode("signatures").alias("sig"))
    parts, placed = None, at
    for turn in range(p.turns):
        placed = _open_signatures(placed if parts is None else placed.drop("component"), parts)
        links = materialize(verify(_to_leaders(placed, sketches, p, turn), near, p), "links")
        if not links.head(1):
            break
        parts = _joined(parts, links)
    else:
        placed = _open_signatures(placed.drop("component"), parts)
    links = materialize(verify(_across(placed, sketches, near, p), near, p), "links")
    if links.head(1):
        parts = _joined(parts, links)
    roots = classes.select("hi", "lo", "node")
    if parts is None:
        roots = roots.withColumn("component", F.col("node"))
    else:
        roots = roots.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = features.select("doc_id", "n_shingles", "hi", "lo").join(roots.drop("node"), ["hi", "lo"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
