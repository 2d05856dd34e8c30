"""Benchmark decontamination with a positional inverted index.

The index is stored, split by documents: a row holds one shard of documents with the
sorted tokens, their posting lists of word positions, and where each document
begins. A test phrase is looked up by its rarest term in the shard; its posting
list, less the term's offset, is intersected with the offset-adjusted lists of
the other terms, rarest first. With a slop of 0 that finds exact phrases. With a
larger one every term may stand that many words before or after its place, as
counted from the rarest term, in the same document; a word may serve two terms.

Test phrases go to the shards in blocks of bounded size, each of which is one pass over
the index; neither the driver nor a task holds more than one block.

Defined cases: a null or empty text has no words, is indexed with length 0 and
never matches; an item without words is no query; a null item id is reported as null.
Repeated documents and items are all kept. Empty tables give empty results, and
documents without a match are returned with zeros. Only ids and texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import words as W
from fabula.llm.cluster import materialize

INDEX_SCHEMA = "shard string, doc_ids array<bigint>, begins binary, tokens binary, lists binary, postings binary"
MATCH_SCHEMA = "shard string, doc_no int, doc_id bigint, n_words bigint, spans array<struct<begin:int,end:int>>, item_ids array<bigint>"
WINDOW = 13
#: Words before A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of test items that are searched for at once, 4 bytes for each place in a window;
#: more are taken in blocks of this size.
QUERY_WORDS = 400_000


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = count()
    for batch in batches:
        for part in W.slices(batch, "text", 2 << 20):
            token, first = W.hash_words(*W.buffers(part.column("text")), W.ALPHANUMERIC)
            order = np.argsort(token, kind="stable").astype(np.int32)
            tokens, lists = np.unique(token[order], return_index=True)
            lists = np.append(lists, len(token)).astype(np.int32)
            row = [f"{TaskContext.get().partitionId()}-{next(made)}", part.column("doc_id").to_pylist(), first.astype(np.int32).tobytes(), tokens.tobytes(), lists.tobytes(), order.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4], strict=True)], names=["shard", "doc_ids", "begins", "tokens", "lists", "postings"])
        W.release()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows, one for each few MB of documents, without a shuffle. Write them
    to reuse them."""
    return _texts(docs, id_col, text_col).mapInArrow(_shards, INDEX_SCHEMA)


class Phrases:
    """Test phrases as arrays: for each the terms (-1: none), its length and item."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        token, first = W.hash_words(*W.buffers(pa.array([t for _, t in items], pa.string())), W.ALPHANUMERIC)
        self.vocabulary, term = np.unique(token, return_inverse=True)
        words = np.diff(first)
        width = np.where(words >= window, words - window + 1, np.minimum(words, 1))
        owner = np.repeat(np.arange(len(items)), width)
        begin = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        size = np.minimum(words, window)[owner]
        terms = np.full((len(owner), window), -1, np.int32)
        for k in range(window):
            has = size > k
            terms[has, k] = term[begin[has] + k]
        # the same phrase is looked up once; every item that has it is reported
        self.terms, back = np.unique(terms, axis=0, return_inverse=True) if len(terms) else (terms, np.zeros(0, np.int64))
        back = back.ravel()
        self.ids = [i for i, _ in items]
        order = np.argsort(back, kind="stable")
        self.items, self.item_at = owner[order].astype(np.int32), np.searchsorted(back[order], np.arange(len(self.terms) + 1))

    def find(self, tokens: np.ndarray, lists: np.ndarray, postings: np.ndarray, begins: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first word, one after the last) for each match in a shard."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(tokens) or not len(self.terms):
            return none
        rank = np.minimum(np.searchsorted(tokens, self.vocabulary), len(tokens) - 1)
        size = np.where(tokens[rank] == self.vocabulary, lists[rank + 1] - lists[rank], 0)
        size = np.append(size, np.iinfo(np.int32).max)  # no term
        live = np.flatnonzero((size[self.terms] > 0).all(1))
        if not len(live):
            return none
        rarest = np.argsort(size[self.terms[live]], axis=1, kind="stable")
        head = rarest[:, 0]
        term = self.terms[live, head]
        many = size[term]
        phrase = np.repeat(np.arange(len(live)), many)
        nth = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
        at = postings[lists[rank[term]][phrase] + nth].astype(np.int64)
        doc = np.searchsorted(begins, at, "right") - 1
        start, low, high = at - head[phrase], at, at
        keys = np.repeat(np.arange(len(tokens), dtype=np.int64), np.diff(lists)) << 32 | postings
        for k in range(1, rarest.shape[1]):
            if not len(phrase):
                break
            place = rarest[phrase, k]
            other = self.terms[live[phrase], place]
            of = rank[other].astype(np.int64) << 32
            want = start + place
            got = keys[np.minimum(np.searchsorted(keys, of + np.maximum(want - slop, begins[doc])), len(keys) - 1)] - of
            ok = (other < 0) | ((got >= np.maximum(want - slop, begins[doc])) & (got <= np.minimum(want + slop, begins[doc + 1] - 1)))
            low, high = np.where(other < 0, low, np.minimum(low, got)), np.where(other < 0, high, np.maximum(high, got))
            phrase, start, doc, low, high = (x[ok] for x in (phrase, start, doc, low, high))
        return live[phrase], low, high + 1


def _matches(phrases: Phrases, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begins = np.frombuffer(row["begins"], np.int32).astype(np.int64)
                lists, postings = np.frombuffer(row["lists"], np.int32), np.frombuffer(row["postings"], np.int32)
                phrase, start, end = phrases.find(np.frombuffer(row["tokens"], np.uint64), lists, postings, begins, slop)
                n = len(begins) - 1
                doc = np.searchsorted(begins, start, "right") - 1
                spans: list[list] = [[] for _ in range(n)]
                items: list[list] = [[] for _ in range(n)]
                if len(start):
                    order = np.lexsort((end, start))
                    for s, e, d in zip(start[order].tolist(), end[order].tolist(), doc[order].tolist(), strict=True):
                        s, e = s - int(begins[d]), e - int(begins[d])
                        if spans[d] and s <= spans[d][-1]["end"]:
                            spans[d][-1]["end"] = max(e, spans[d][-1]["end"])
                        else:
                            spans[d].append({"begin": s, "end": e})
                    for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
                        items[d] += [phrases.ids[i] for i in phrases.items[phrases.item_at[p] : phrases.item_at[p + 1]].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.string()),
                        pa.array(range(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(np.diff(begins), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                        pa.array([sorted(set(x) - {None}) + [None] * (None in x) for x in items], pa.list_(pa.int64())),
                    ],
                    names=["shard", "doc_no", "doc_id", "n_words", "spans", "item_ids"],
                )

    return search


def _query_blocks(items: DataFrame, id_col: str, text_col: str, most: int, window: int) -> Iterator[list[tuple[int | None, str]]]:
    block: list[tuple[int | None, str]] = []
    size = 0
    for key, text in items.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        words = _WORD.findall(text)
        for at in range(0, max(1, len(words) - window + 1), most):  # parts of a long item share the words of a window but one
            part = words[at : at + most + window - 1]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((key, " ".join(part)))
            size += len(part)
    yield block


def find_items(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "item_id", text_col: str = "text", query_words: int = QUERY_WORDS) -> DataFrame:
    """One row per indexed document: merged word spans that match a window of some
    item, and the items' ids.

    The windows go to every shard with the task, at most ``query_words`` words of
    them at a time; a larger set is searched block by block, and the
    blocks' spans are merged per document.
    """
    search = lambda block: index.mapInArrow(_matches(Phrases(block, window), slop), MATCH_SCHEMA)
    blocks = _query_blocks(items, id_col, text_col, query_words, window)
    out = search(next(blocks))
    several = False
    for block in blocks:
        out = (out if several else materialize(out, "matches")).union(materialize(search(block), "matches"))
        several = True
    if not several:
        return out
    both = out.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.array_sort(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    return both.withColumn("spans", _merged("spans"))


def _merged(col: str):
    """Sorted spans with those that meet joined."""
    nothing = F.array().cast("array<struct<begin:int,end:int>>")
    span = lambda b, e: F.struct(b.alias("begin"), e.alias("end"))
    size = F.size

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), size(acc) - 1), F.array(span(last["begin"], F.greatest(last["end"], s["end"]))))
        return F.when((size(acc) > 0) & (s["begin"] <= F.get(acc, size(acc) - 1)["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(col, nothing, add)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with ``n_hit`` words inside matches; contaminated where those are at
    least a twentieth of the words. The index is written and stays in the shared folder."""
    index = materialize(build_index(docs, id_col, text_col), "postings")
    found = find_items(index, items, window, slop)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long")
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
