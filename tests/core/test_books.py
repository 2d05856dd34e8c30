import io
import zipfile

from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators import books as B
from fabula.sources import books as S

BOOK = "11111111-1111-4111-8111-111111111111"
TEXT = "First paragraph has useful content.\n\nSecond paragraph has useful content.\n\nThird paragraph closes the sample."


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalization(spark):
    assert one(spark, T.normalize_book_text, "  Hello\t world\r\n\r\n\r\nNext line  ") == "Hello world\n\nNext line"
    assert one(spark, T.normalize_book_text, "  Chapter 1\nHello   world\r\n\r\nChapter 2\nNext page  ") == "Chapter 1\nHello world\n\nChapter 2\nNext page"
    assert one(spark, T.normalize_book_text, "é\x00") == "é"
    assert one(spark, T.strip_xml_tags, "<p>a&amp;lt;<SCRIPT>x</SCRIPT></p>").strip() == "a<"


def test_chapters(spark):
    texts = ["Chapter 1\nHello world\n\nChapter 2\nNext page", "Chapter 1\nPDF text", "", "intro\nГлава 1\na\nГлава 2\nb", "Глава первая\na\nГлава вторая"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {}
    for r in B.chapters(df).orderBy("doc_id", "chapter_index").collect():
        rows.setdefault(r.doc_id, []).append((r.chapter_index, r.title, r.start_offset, r.end_offset))
    assert rows[0] == [(0, "Chapter 1", 0, 23), (1, "Chapter 2", 23, 42)]
    assert rows[1] == [(0, None, 0, len(texts[1]))] and 2 not in rows
    assert [r[2] for r in rows[3]] == [6, 16] and rows[4] == [(0, None, 0, len(texts[4]))]


def test_chunks(spark):
    ranges = list(B.chunk_text(TEXT, 15, 2))
    assert ranges == [(0, 35), (27, 73), (65, 109)]
    words = " ".join(f"word{i}" for i in range(80))
    parts = list(B.chunk_text(words, 8, 2))
    assert len(parts) == 26 and max(e - s for s, e in parts) == 29
    assert list(B.chunk_text(" \n ", 8, 2)) == []
    expected = ["c2fee93e-ed45-4958-affb-70d32063d69d", "1be5d816-971b-4cda-b19a-b57639694996", "b13ed81d-a5d3-4c6e-87df-5c6b2057c344"]
    rows = [(f"{BOOK}:{i}:{s}:{e}:{TEXT[s:e]}",) for i, (s, e) in enumerate(ranges)]
    got = spark.createDataFrame(rows, "x string").select(T.uuid_from_sha256(F.col("x"))).collect()
    assert [r[0] for r in got] == expected
    made = B.chunks(spark.createDataFrame([(1, TEXT), (2, None)], "doc_id bigint, text string"), target=15, overlap=2).orderBy("order_index").collect()
    assert [r.token_estimate for r in made] == [9, 12, 11]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello\r\nworld")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("content.opf", '<package xmlns:dc="d"><metadata><dc:title>Mock EPUB</dc:title><dc:creator>A. Writer</dc:creator><dc:language>en</dc:language></metadata></package>')
        z.writestr("chapter2.xhtml", "<p>Chapter 2</p>\n<p>Second &amp; final.</p>")
        z.writestr("chapter1.xhtml", "<h1>Chapter 1</h1>\n<p>First&nbsp;one</p>")
    (tmp_path / "b.epub").write_bytes(buffer.getvalue())
    (tmp_path / "c.fb2").write_text("<FictionBook><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title><lang>ru</lang></title-info></description><body><p>Text</p></body></FictionBook>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.epub").write_bytes(b"broken")
    rows = {r.path[-5:]: r for r in S.read_books(spark, str(tmp_path), pdf=lambda b: "Chapter 1\nPDF text").collect()}
    assert rows["a.txt"].text == "Hello\nworld"
    assert rows["d.pdf"].text == "Chapter 1\nPDF text" and rows["c.fb2"].author == "A B" and "Text" in rows["c.fb2"].text
    both = S.read_books(spark, str(tmp_path / "*.epub")).orderBy("path").collect()
    assert both[0].title == "Mock EPUB" and both[0].author == "A. Writer" and both[0].language == "en"
    assert "Second & final." in both[0].text and both[0].text.index("Chapter 1") < both[0].text.index("Chapter 2")
    assert both[1].text is None and "BadZipFile" in both[1].error


def test_upload_rules(spark):
    rows = [("a.txt", "text/plain", 5), ("b.exe", "text/plain", 5), ("c.pdf", "image/png", 5), ("d.fb2", "application/x-fictionbook+xml", 60 << 20)]
    df = spark.createDataFrame(rows, "path string, kind string, size bigint")
    got = df.select(S.upload_errors(F.col("path"), F.col("kind"), F.col("size"))).collect()
    assert [r[0] for r in got] == [None, "extension", "media type", "size"]
    kinds = spark.createDataFrame([("a.txt", None), ("x", "application/x-fictionbook+xml"), ("x", None)], "path string, kind string")
    assert [r[0] for r in kinds.select(S.book_format(F.col("path"), F.col("kind"))).collect()] == ["TXT", "FB2", None]


def test_normalized_texts_equal_the_rule_line_by_line(spark):
    import random
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from fabula.functions import text as T

    blanks = " \t\x0b\f\r      　﻿" + "".join(map(chr, range(0x2000, 0x200B)))

    def plain(t):
        t = unicodedata.normalize("NFC", t).replace("\x00", "")
        t = re.sub(r"\n{3,}", "\n\n", re.sub("[  ]+", " ", re.sub(r"[\t\f\x0b]+", " ", re.sub(r"\r\n?", "\n", t))))
        return "\n".join(line.strip(blanks) for line in t.split("\n")).strip(blanks + "\n")

    r = random.Random(1)
    bits = ["a", "b c", " ", "  ", "\t", "\n", "\n\n", "\n\n\n", "\r", "\r\n", "\x0b", "\f", " ", " ", " ", " ", "　", "﻿", "é", "é", "\x00", "\u0085", "$"]
    rows = [("".join(r.choices(bits, k=r.randrange(25))),) for _ in range(3000)]
    got = spark.createDataFrame([*rows, (None,)], "t string").select("t", T.normalize_book_text(F.col("t")).alias("n")).collect()
    assert all(x.n == (None if x.t is None else plain(x.t)) for x in got)
