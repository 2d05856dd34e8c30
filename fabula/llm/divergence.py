"""Source divergence audit: how far the sources of a language are from each other in words.

A term's probability in a group is ``1 + floor(SCALE * (count + 1) / (N + V))``, with N all
counts of the group and V the kept terms of its language, in whole numbers. The distance of
group a from b is the sum of ``floor((p - q) ** 2 / q)`` over all V terms, those that neither
has included, and no pair of groups looks at all V of them:

* a histogram of each group's counts prices its terms as if the other group had none of
  them; that depends on the other group by its probability of no occurrence alone, so
  it is priced once for each different one;
* a join of the sparse postings finds the terms that both have; there the two one-sided
  prices are taken back and the true one is added (inclusion and exclusion);
* what is left, V less the union of both supports, costs the same constant for each term.

Texts become counts where they are read, with what repeats in a task already added up, so
no term or source is hot. Posting lists of many sources are joined tile by tile.

Defined cases: null texts have no terms, null languages and sources are ''. A group without
terms, or of a language that keeps none, is compared all the same (0 if nothing is kept).
Repeated rows are documents of their own. Ties in value go by the item's UTF-8 bytes. An empty
table gives an empty result. Only language, source and text are read, so other columns don't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm import words as W
from fabula.llm.cluster import materialize, scratch

SCALE = 1_000_000_000
#: Documents of a language that a kept term is in, and ranks of terms that are returned.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Counters that a task holds.
HELD = 400_000
#: Sources of a language in one tile of the join of postings.
TILE = 1024
#: Letters and all bytes of non-ASCII characters; A-Z are lower-cased.
_TERM = W.term_table(lambda b: 97 <= b <= 122 or b >= 128)
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        n = len(counts)
        columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
        yield from pa.Table.from_arrays(columns, schema=_COUNTS).to_batches(1 << 16)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in W.terms(text.cast(pa.large_binary()).as_py() or b"", _TERM):
                counts.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield from _rows(held)
            held = {}
    yield from _rows(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up over all rows."""
    rows = docs.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str, total: str, kept: str) -> Column:
    """In decimals, which hold any product of two counts; null where nothing is kept."""
    return F.expr(f"1 + ({SCALE}BD * ({count} + 1)) div nullif({total} + {kept}, 0)")


def price(p: str, q: str) -> Column:
    """``floor((p - q) ** 2 / q)``; p and q are at most SCALE + 1, so the square is a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _exact_sum(x: Column) -> list[Column]:
    """Sums of the high and the low bits of longs, which together can't overflow."""
    return [F.sum(F.shiftright(x, 31)), F.sum(x.bitwiseAND(F.lit((1 << 31) - 1)))]


def _total(high: str, low: str) -> Column:
    return F.col(high).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(20,0)") + F.col(low)


def _groups(docs: DataFrame, held: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, support, none, kept, lang_total, tiles) of every group that occurs:
    all counts, terms, and the probability of no occurrence; and those of its language."""
    languages = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = docs.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg((1 + F.count("*") / TILE).cast("int").alias("tiles"))
    out = groups.join(tiles, "lang").join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
    return out.withColumn("zero", F.lit(0)).withColumn("none", F.coalesce(probability("zero", "total", "kept"), F.lit(1))).drop("zero")


def _term_part(postings: DataFrame, top: int) -> DataFrame:
    rows = postings.withColumn("q", probability("lang_n", "lang_total", "kept")).where("p > q").select("lang", "source", F.col("term").alias("item"), price("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))


def _one_sided(histogram: DataFrame, nones: DataFrame, p: str, q: str, name: str) -> DataFrame:
    """A group's terms priced against each probability of no occurrence in its language."""
    rows = histogram.join(nones, "lang")
    return rows.groupBy("lang", "source", "other_none").agg(F.sum(price(p, q).cast("decimal(20,0)") * F.col("terms")).alias(name))


def _overlaps(postings: DataFrame) -> DataFrame:
    """(lang, source, other, both, high, low): the terms that two sources have, and what their
    true prices differ from the one-sided ones, for either direction."""
    tile = F.pmod(F.xxhash64("source"), "tiles").cast("int")
    places = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    side = postings.select("lang", "term", "source", "p", "none", tile.alias("tile"), places.alias("place"))
    a = side.withColumnRenamed("place", "other_tile")
    b = side.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("none").alias("other_none"), F.col("tile").alias("other_tile"), F.col("place").alias("tile"))
    both = a.join(b, ["lang", "term", "tile", "other_tile"]).where("source < other")
    there = price("p", "q") - price("p", "other_none") - price("none", "q")
    back = price("q", "p") - price("q", "none") - price("other_none", "p")
    (h1, l1), (h2, l2) = _exact_sum(there), _exact_sum(back)
    found = both.groupBy("lang", "source", "other").agg(F.count("*").alias("both"), h1.alias("h1"), l1.alias("l1"), h2.alias("h2"), l2.alias("l2"))
    one = found.select("lang", "source", "other", "both", F.col("h1").alias("high"), F.col("l1").alias("low"))
    return one.union(found.select("lang", "other", "source", "both", "h2", "l2"))


def _pair_part(postings: DataFrame, groups: DataFrame) -> DataFrame:
    histogram = materialize(postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "count-histograms")
    nones = groups.select("lang", F.col("none").alias("other_none")).distinct()
    left = _one_sided(histogram, nones, "p", "other_none", "left")
    right = _one_sided(histogram, nones, "other_none", "p", "right").select("lang", F.col("source").alias("other"), F.col("other_none").alias("none"), "right")
    a = groups.select("lang", "source", "none", "kept", "support")
    b = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("support").alias("other_support"))
    # every two sources of a language are the result itself
    pairs = a.join(b, "lang").where("source <> other")
    pairs = pairs.join(left, ["lang", "source", "other_none"], "left").join(right, ["lang", "other", "none"], "left").join(_overlaps(postings), ["lang", "source", "other"], "left").na.fill(0)
    neither = (F.col("kept") - F.col("support") - F.col("other_support") + F.col("both")).cast("decimal(18,0)") * price("none", "other_none").cast("decimal(19,0)")
    value = F.col("left") + F.col("right") + _total("high", "low") + neither
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.select("lang", "source", F.col("other").alias("item"), value.cast("long").alias("value")).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank. Part ``pair`` has all other sources of a
    language by distance; part ``term`` the ``top`` terms that a source has more of than its
    language. Probabilities are those of the group, against those of item or language."""
    with scratch(docs.sparkSession):
        texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
        counts = materialize(term_counts(texts), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = materialize(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
        held = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "kept-postings")
        groups = materialize(_groups(texts, held, kept), "source-groups")
        postings = held.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "kept"))
        postings = materialize(postings.select("lang", "source", "term", "p", "none", "lang_n", "lang_total", "kept", "tiles"), "priced-postings")
        out = _pair_part(postings, groups).unionByName(_term_part(postings, top))
        return materialize(out.select("lang", "source", "part", "item", "value", "rank"), "source-divergence", kept=True)
