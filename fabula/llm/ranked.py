"""Ranked lexical search, score at a time over impact-ordered postings.

A document with tf occurrences of a term and n terms in all has, for that term, the impact
``10 ** 9 * tf div (1000 * tf + 8 * m)`` with ``m = 10 + 90 * n * N div L``; N documents have
terms, L in all. A query's score sums weight times impact over its distinct terms, where the
weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``. All but the logarithm is in whole numbers.

The index is stored and split by documents, without a shuffle of texts: a row holds a term's
postings in a shard of documents, grouped by exact impact, highest first; one row more
has the shard's document ids. Queries go to every shard in blocks of bounded size; a shard
gives only the postings of the block's terms.

Within a shard, a query takes groups of its terms in descending order of weight times impact and
adds them up. What a document that was not met yet can still get is at most the sum of what comes next in
each list. Once that is less than the k-th best sum so far, the best k are among the documents whose sum
and that bound together reach it; their scores are completed from the lists. If it never
is, all postings are taken. The best k of all shards are ranked.

Defined cases: null and empty texts have no terms, are counted nowhere and found by no query. Ties in
score go by ascending document id, nulls last; repeated documents take ranks of their own.
Rows with one item id (null too) are one query of all their terms. An item without a known term has no
result. Terms with weight 0 add nothing. Empty tables give an empty result. Only ids and
texts are read, so other columns don't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm import words as W
from fabula.llm.cluster import materialize, scratch

#: Bytes of text in a shard of the index.
SHARD_BYTES = 8 << 20
#: Terms of queries that go to a shard at once.
BLOCK_TERMS = 200_000
#: Letters, digits and all bytes of non-ASCII characters; A-Z are lower-cased.
_TERM = W.term_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
INDEX = "shard string, term string, n_docs int, impacts array<int>, sizes array<int>, docs array<int>, ids array<bigint>"
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_INDEX = pa.schema([("shard", pa.string()), ("term", pa.string()), ("n_docs", pa.int32()), ("impacts", _INTS), ("sizes", _INTS), ("docs", _INTS), ("ids", _LONGS)])
FOUND = "shard string, item_id bigint, doc_no int, doc_id bigint, score bigint"
_FOUND = pa.schema([("shard", pa.string()), ("item_id", pa.int64()), ("doc_no", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text"):
        yield text.cast(pa.large_binary()).as_py() or b""


def collection(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms of all with repeats."""

    def add(batches):
        n = total = 0
        for batch in batches:
            for text in _bytes(batch):
                many = sum(map(len, W.terms(text, _TERM)))
                n, total = n + (many > 0), total + many
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.select(F.col(text_col).alias("text")).mapInArrow(add, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def _shard_rows(shard: str, ids: list[int | None], tf: list[Counter], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"shard": [shard], "term": [None], "n_docs": [None], "impacts": [None], "sizes": [None], "docs": [None], "ids": [ids]}, schema=_INDEX)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    term = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int32, len(c)) for c in tf])
    times = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in tf])
    doc = np.repeat(np.arange(len(tf), dtype=np.int32), [len(c) for c in tf])
    if not len(term):
        return
    m = np.array([10 + 90 * sum(c.values()) * n_docs // n_terms for c in tf], np.int64)
    impact = 10**9 * times // (1000 * times + 8 * m[doc])
    order = np.lexsort((doc, -impact, term))
    term, impact, doc = term[order], impact[order], doc[order]
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_group = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(impact, prepend=-1) != 0))
    groups = np.searchsorted(new_group, np.append(new_term, len(term))).astype(np.int32)
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
    ends = np.append(new_term, len(term))
    columns = [
        pa.repeat(shard, len(number)),
        pa.array(list(number), pa.binary()).cast(pa.string()),
        pa.array(np.diff(ends).astype(np.int32)),
        lists(groups, impact[new_group]),
        lists(groups, np.diff(np.append(new_group, len(term)))),
        lists(ends, doc),
        pa.nulls(len(number), _LONGS),
    ]
    yield from pa.Table.from_arrays(columns, schema=_INDEX).to_batches(1 << 14)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows of every document; ``n_docs`` and ``n_terms`` are those of collection(). Write
    them to reuse them."""

    def run(batches):
        made, ids, held, size = count(), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), _bytes(batch), strict=True):
                counts: Counter = Counter()
                for words in W.terms(text, _TERM):
                    counts.update(words)
                ids.append(key)
                held.append(counts)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield from _shard_rows(f"{TaskContext.get().partitionId()}-{next(made)}", ids, held, n_docs, n_terms)
                    ids, held, size = [], [], 0
                    W.release()
        if ids:
            yield from _shard_rows(f"{TaskContext.get().partitionId()}-{next(made)}", ids, held, n_docs, n_terms)

    return _texts(docs, id_col, text_col).mapInArrow(run, INDEX)


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), _bytes(batch), strict=True):
                for words in W.terms(text, _TERM):
                    distinct = list(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(distinct), pa.int64()), pa.array(distinct, pa.binary()).cast(pa.string())], names=["item_id", "term"])

    return _texts(items, id_col, text_col).mapInArrow(run, "item_id bigint, term string").distinct()


class Postings:
    """A term's postings in a shard, highest impact first."""

    def __init__(self, impacts: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        self.impacts, self.docs = np.repeat(impacts.astype(np.int64), sizes), docs
        self.falling = -self.impacts
        self._by_doc: tuple[np.ndarray, np.ndarray] | None = None

    def above(self, least: int) -> int:
        """How many postings have an impact of more than ``least``."""
        return int(np.searchsorted(self.falling, -least))

    def find(self, docs: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``docs`` have a posting from ``start`` on, and its impact."""
        if self._by_doc is None:
            order = np.argsort(self.docs, kind="stable")
            self._by_doc = order, self.docs[order]
        order, known = self._by_doc
        at = np.minimum(np.searchsorted(known, docs), len(known) - 1)
        there = np.flatnonzero((known[at] == docs) & (order[at] >= start))
        return there, self.impacts[order[at[there]]]


def best(lists: list[tuple[int, Postings]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the best ``k``, with their whole scores, and how many postings
    were added before the rest was only looked up. ``lists`` has weights above 0."""
    total = np.zeros(n_docs, np.int64)
    place = [0] * len(lists)
    ahead = np.array([w * int(p.impacts[0]) for w, p in lists], np.int64)
    bound, kth, added = int(ahead.sum()), 0, 0
    while bound and bound >= kth:
        # groups within a factor of 2 of the highest one are taken between two looks at the bound
        level = int(ahead.max()) // 2
        for t in np.flatnonzero(ahead > level):
            w, p = lists[t]
            end = p.above(level // w)
            total[p.docs[place[t] : end]] += w * p.impacts[place[t] : end]
            added += end - place[t]
            place[t] = end
            ahead[t] = w * int(p.impacts[end]) if end < len(p.docs) else 0
        bound = int(ahead.sum())
        kth = int(np.partition(total, -k)[-k]) if n_docs >= k else 0
    found = np.flatnonzero(total + bound >= max(kth, 1)) if bound else np.flatnonzero(total >= max(kth, 1))
    score = total[found]
    for (w, p), start in zip(lists, place, strict=True):
        if start < len(p.docs):
            at, impact = p.find(found, start)
            score[at] += w * impact
    return found, score, added


def _search(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[1].as_py()
        table = table.combine_chunks()
        rows = {t: i for i, t in enumerate(table.column("term").to_pylist())}
        head = rows.pop(None)
        ids = table.column("ids")[head].values
        asked = table.column("queries")[head].values
        weight = asked.field("weight").to_numpy(zero_copy_only=False)
        terms = asked.field("term").to_pylist()
        of_item: defaultdict[int | None, list[int]] = defaultdict(list)
        for n, item in enumerate(asked.field("item_id").to_pylist()):
            if weight[n] > 0 and terms[n] in rows:
                of_item[item].append(n)
        column = lambda name, i: table.column(name)[i].values.to_numpy()
        known = {t: Postings(column("impacts", i), column("sizes", i), column("docs", i)) for t, i in rows.items()}
        # ids rank documents of one score; nulls last
        rank = np.argsort(pc.sort_indices(ids, null_placement="at_end").to_numpy(), kind="stable")
        parts = []
        for item, places in of_item.items():
            doc, score, _ = best([(int(weight[n]), known[terms[n]]) for n in places], len(ids), k)
            top = np.lexsort((rank[doc], -score))[:k]
            doc = doc[top].astype(np.int32)
            parts.append(pa.Table.from_arrays([pa.repeat(shard, len(doc)), pa.array([item] * len(doc), pa.int64()), pa.array(doc), ids.take(pa.array(doc)), pa.array(score[top])], schema=_FOUND))
        W.release()
        return pa.concat_tables(parts).combine_chunks() if parts else _FOUND.empty_table()

    return run


def search_index(index: DataFrame, items: DataFrame, n_docs: int, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``k`` indexed documents of each item."""
    terms = materialize(query_terms(items, id_col, text_col), "query-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    postings = index.where("term is not null")
    df = postings.select("term", "n_docs").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("weight")
    asked = terms.join(df, "term").select(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), "item_id", "term", weight)
    asked = materialize(asked, "weighted-query-terms")
    packed = asked.groupBy("block").agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("queries"))  # block_terms of them, or one item
    heads = index.where("term is null").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "ids").join(packed, "block")
    hits = postings.join(asked.select("block", "term").distinct(), "term").select("block", "shard", "term", "impacts", "sizes", "docs")
    rows = hits.unionByName(heads, allowMissingColumns=True)
    found = rows.groupBy("block", "shard").applyInArrow(_search(k), FOUND)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "doc_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` documents of each item; what is written on the way goes with the index."""
    with scratch(docs.sparkSession):
        n_docs, n_terms = collection(docs)
        index = materialize(build_index(docs, n_docs, n_terms), "impact-index")
        return materialize(search_index(index, items, n_docs, k), "ranked-documents", kept=True)
