"""Chapters and chunks of book texts."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T

TARGET_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 1800, 200, 4


def marked_books(books: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_chars, titles): titles are (title, start) of the title lines of each text,
    found within the row; a line starts after the lengths of those before and their ends."""
    lines = books.select(id_col, text_col, F.length(text_col).cast("long").alias("n_chars"), F.split(text_col, "\n").alias("_lines"))
    line = lambda x, i: F.when(T.may_be_chapter_title(x), F.when(T.is_chapter_title(T.trim_ws(x)), F.struct(i.alias("i"), T.trim_ws(x).alias("title"))))
    before = lambda i: F.aggregate(F.slice("_lines", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 1)
    titled = lines.withColumn("_found", F.filter(F.transform("_lines", line), lambda m: m.isNotNull()))
    titles = F.transform("_found", lambda m: F.struct(m["title"].alias("title"), before(m["i"]).alias("start")))
    return titled.select(id_col, text_col, "n_chars", titles.alias("titles"))


def _ranges() -> Column:
    title = F.lit(None).cast("string").alias("title")
    end = lambda k: F.coalesce(F.get("titles", k + 1)["start"], F.col("n_chars"))
    each = F.transform("titles", lambda t, k: F.struct(k.cast("long").alias("chapter_index"), t["title"].alias("title"), t["start"].alias("start_offset"), end(k).alias("end_offset")))
    whole = F.struct(F.lit(0).cast("long").alias("chapter_index"), title, F.lit(0).cast("long").alias("start_offset"), F.col("n_chars").alias("end_offset"))
    return F.when(F.size("titles") > 1, each).when(F.col("n_chars") > 0, F.array(whole))


def chapters(books: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chapter_index, title, start_offset, end_offset): from title line to title line.
    With fewer than two titles a text is one chapter without a title; before the first
    title nothing belongs to a chapter. Empty texts have none. Nothing is shuffled."""
    return marked_books(books, id_col, text_col).select(id_col, F.inline(_ranges()))


def chunk_text(text: str, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, base: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of overlapping chunks: up to a blank line in the later half, else to white
    space in the last quarter, else to the full size; trimmed, empty ones left out."""
    most = max(1, target) * CHARS_PER_TOKEN
    back = max(0, min(overlap, max(1, target) - 1)) * CHARS_PER_TOKEN
    start, n = 0, len(text)
    while start < n:
        end = hard = min(start + most, n)
        if hard < n:
            paragraph = text.rfind("\n\n", 0, hard + 2)
            if paragraph > start + most // 2:
                end = paragraph
            else:
                word = next((i - 1 for i in range(hard, start, -1) if text[i - 1].isspace()), -1)
                if word > start + most * 3 // 4:
                    end = word
        piece = text[start:end]
        left = len(piece) - len(piece.lstrip())
        if piece.strip():
            yield base + start + left, base + start + len(piece.rstrip())
        if end >= n:
            return
        start = max(start + 1, end - back)


def chunk_settings(environment: Mapping[str, str] | None = None) -> tuple[int, int]:
    """Target and overlap in tokens, by BOOK_CHUNK_TARGET_TOKENS and BOOK_CHUNK_OVERLAP_TOKENS
    where these are positive whole numbers; the overlap is below the target."""
    given = os.environ if environment is None else environment

    def positive(name: str, default: int) -> int:
        try:
            n = float(given.get(name, ""))
        except ValueError:
            return default
        return int(n) if n > 0 and n.is_integer() else default

    target = positive("BOOK_CHUNK_TARGET_TOKENS", TARGET_TOKENS)
    return target, min(positive("BOOK_CHUNK_OVERLAP_TOKENS", OVERLAP_TOKENS), target - 1)


def chunks(books: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of the chapters with stable ids, one row each, numbered through the book. Books
    are cut where they are, by rows; no shuffle, and a batch's chunks leave as they are made."""
    known = chunk_settings()
    target, overlap = known[0] if target is None else target, known[1] if overlap is None else overlap
    schema = f"{id_col} bigint, chapter_index bigint, order_index bigint, start_offset bigint, end_offset bigint, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                order = 0
                for r in ranges or ():
                    begin = r["start_offset"]
                    for s, e in chunk_text(text[begin : r["end_offset"]], target, overlap, begin):
                        out.append((key, r["chapter_index"], order, s, e, text[s:e]))
                        order += 1
            kinds = [pa.int64()] * 5 + [pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    marked = marked_books(books.select(F.col(id_col).cast("long"), text_col), id_col, text_col)
    made = marked.select(id_col, text_col, _ranges().alias("ranges")).mapInArrow(run, schema)
    parts = F.concat_ws(":", F.col(id_col).cast("string"), "order_index", "start_offset", "end_offset", "text")
    return made.withColumn("chunk_id", T.uuid_from_sha256(parts)).withColumn("token_estimate", T.token_estimate(F.col("text")))


def backfilled(chunks: DataFrame) -> DataFrame:
    """Older chunks with the end offset and the estimate that they lack."""
    estimate = F.coalesce("token_estimate", T.token_estimate(F.col("text")))
    return chunks.withColumns({"end_offset": F.coalesce("end_offset", F.length("text").cast("long")), "token_estimate": estimate})


def newest_with_content(incoming: DataFrame, known: DataFrame, *order: Column, hash_col: str = "content_hash") -> DataFrame:
    """Incoming books with the newest known row of the same content, or nulls. Of the known
    rows one for each content is chosen before the join."""
    first = Window.partitionBy(hash_col).orderBy(*order)
    newest = known.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return incoming.join(newest, hash_col, "left")


def deduplicated(books: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, first id, copies) by the SHA-256 of the text."""
    return books.groupBy(F.sha2(text_col, 256).alias("content_hash")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))
