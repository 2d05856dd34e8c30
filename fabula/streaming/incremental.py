"""Chunks that arrive as files: their facts replace those of an earlier run, and the books they are
of are merged again.

Facts are kept as a log of commits (sources/snapshots.py), in which a chunk and family is a
scope: a batch writes its own facts and nothing else, and readers take the last commit of each
chunk. ``snapshots.compact`` makes one commit of many from time to time. The tables of a merge are
a store of their own, in which a book is a scope: after a batch the books of its chunks are merged
anew from all their facts, and all tables change at once. Whatever order chunks come in, the
last state is that of one run over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fabula.operators.entities import merge_characters
from fabula.operators.extraction import Provider, extract_facts, fact_values
from fabula.plans.storage import materialize, scratch
from fabula.sources import snapshots

CHUNKS = "chunk_id string, doc_id bigint, text string, chapter_index bigint, order_index bigint"


def watch_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows of Parquet files as they appear; places in the book may be missing."""
    return spark.readStream.schema(CHUNKS).parquet(folder)


def _scope(chunk: str, family: str) -> Column:
    return F.to_json(F.struct(F.col(chunk).alias("c"), F.col(family).alias("f")))


def replace_chunks(chunks: DataFrame, provider: Provider, store: str, families: tuple[str, ...] = ("character",)) -> int:
    """The facts of ``chunks`` in place of those that ``store`` has of the same chunks and
    families; a chunk without facts leaves none. Where extraction failed, the old facts stay.
    Answers are written before anything is made of them, so no provider is asked twice for that."""
    spark = chunks.sparkSession
    with scratch(spark):
        made = materialize(extract_facts(chunks, provider, families), "extracted")
        asked = chunks.select("chunk_id", F.explode(F.array(*map(F.lit, families))).alias("family")).select(_scope("chunk_id", "family").alias("scope"))
        failed = made.where("error is not null").select(_scope("chunk_id", "family").alias("scope"))
        places = chunks.select("chunk_id", *(F.col(c).cast("long") if c in chunks.columns else F.lit(None).cast("long").alias(c) for c in ("chapter_index", "order_index")))
        rows = made.where("error is null").withColumn("scope", _scope("chunk_id", "family"))
        number = Window.partitionBy("scope").orderBy("type", "entity_name", "summary", "value", "quote", "timeline_hint", "confidence")
        rows = rows.withColumn("n", F.row_number().over(number)).drop("error")
        rows = rows.join(places.withColumnRenamed("chunk_id", "_chunk"), F.col("chunk_id").eqNullSafe(F.col("_chunk")), "left").drop("_chunk")
        return snapshots.commit(spark, store, {"facts": rows}, "scope", asked.join(failed, "scope", "left_anti"))


def stored_facts(spark: SparkSession, store: str) -> DataFrame | None:
    """Every chunk's facts as last extracted."""
    return snapshots.snapshot(spark, store).table("facts")


def mergeable(facts: DataFrame) -> DataFrame:
    """Extracted facts as the merge of characters takes them, a book being a scope."""
    place = F.concat_ws("/", F.lpad(F.coalesce("order_index", F.lit(0)).cast("string"), 12, "0"), "chunk_id", F.lpad(F.col("n").cast("string"), 9, "0"))
    return facts.where("family = 'character'").select(
        F.col("doc_id").cast("string").alias("scope"),
        place.alias("id"),
        "type",
        "entity_name",
        fact_values(F.col("value"), "character")["candidateNames"].alias("candidate_names"),
        F.coalesce("chapter_index", F.lit(0)).cast("long").alias("chapter_index"),
        "confidence",
        "timeline_hint",
        "summary",
    )


def merge_books(spark: SparkSession, facts_store: str, merged_store: str, books: DataFrame) -> int:
    """Merges the characters of ``books`` (doc_id) anew; all their tables change in one step."""
    facts = stored_facts(spark, facts_store)
    if facts is None:
        return 0
    books = books.select("doc_id").distinct()
    with scratch(spark):
        own = materialize(mergeable(facts.join(books, "doc_id", "left_semi")), "book-facts")
        return snapshots.commit(spark, merged_store, merge_characters(own), "scope", books.where("doc_id is not null"))


def extract_continuously(chunks: DataFrame, provider: Provider, store: str, checkpoint: str, once: bool = False, families: tuple[str, ...] = ("character",), merged: str | None = None) -> StreamingQuery:
    """Extracts facts of each arriving chunk into ``store``, and keeps the merge of the
    books in ``merged``, if given. A chunk that comes again replaces its own facts, and so does a
    repeated batch; of one that comes twice in a batch one row counts."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            distinct = materialize(batch.dropDuplicates(["chunk_id"]), "arrived")
            replace_chunks(distinct, provider, store, families)
            if merged:
                merge_books(spark, store, merged, distinct)

    stream = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
