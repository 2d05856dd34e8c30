import gzip
import hashlib
import io
import itertools
import random
import uuid

import pytest

from fabula.llm import warc as A

SCHEMA = "page_id bigint, url string, html string, digest string, n string"


def brute(rows):
    out = []
    best = {}
    for page_id, _, html, *_ in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and page_id is not None:
            best[p] = max(best.get(p, page_id), page_id)
    for page_id, _, html, *_ in rows:
        p = (html or "").encode()
        full = best.get(p)
        again = full is not None and page_id != full
        out.append((page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", full if again else None))
    return sorted(out, key=str)


def pages():
    r = random.Random(2)
    rows = [(i, f"http://a/{i}", "é" * r.choice([0, 10, 499, 500, 501]) + str(r.randrange(3)) * r.choice([0, 1]), "clash", None) for i in range(80)]
    copy = "<p>" + "copy " * 400
    rows += [(100 + i, None, copy, None, None) for i in range(40)]
    rows += [(200, "http://a/\r\nX: y", None, "", ""), (201, "", "", "", ""), (None, "u", copy, "", ""), (None, None, None, "", "")]
    rows += [(139, None, copy, None, None), (300, "big", "0123456789" * 300_000, "", ""), (301, "crlf", "\r\n\r\nWARC/1.1\r\n\r\n" * 3, "", "")]
    return rows


def test_records_read_back_equal_brute_force(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(5)
    got = A.archive_pages(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages())
    assert all(r.digest_ok for r in got)


def test_chunks_carry_digests_so_far(spark):
    from fabula.llm.cluster import shared_dir

    folder = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "u", "abc" * 1000, "", ""), (2, "u", "", "", "")], SCHEMA)
    manifest = A.write_archives(A.mark_revisits(df), folder, archive_bytes=1)
    assert manifest.count() == 2
    rows = A.read_chunks(manifest, chunk_bytes=700).orderBy("record_id", "chunk_no").collect()
    data = b""
    for r in rows[:5]:
        assert r.offset == len(data)
        data += r.data
        assert r.sha1 == hashlib.sha1(data).hexdigest() and r.last == (len(data) == 3000)
    assert data == b"abc" * 1000 and rows[5].last and rows[5].data == b""
    glob = A.list_archives(spark, folder + "/*.warc.gz")
    assert A.read_chunks(glob).count() == 2


def test_plain_archives_and_other_records_can_be_read():
    block = b"software: x\r\n"
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    rows = list(A.archive_chunks(io.BytesIO(raw * 2), "p", 5))
    assert b"".join(r[7] for r in rows) == block * 2 and [r[1] for r in rows] == [0, 0, 0, 1, 1, 1]


def record(block, kind=b"application/http", length=None, extra=b""):
    length = str(len(block)).encode() if length is None else length
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: " + kind + b"\r\n" + extra
    return head + (b"Content-Length: " + length + b"\r\n" if length else b"") + b"\r\n" + block + b"\r\n\r\n"


GOOD = record(b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<p>good</p>")


@pytest.mark.parametrize("gzipped", [False, True])
@pytest.mark.parametrize("size", [3, 1000])
@pytest.mark.parametrize(
    ("bad", "payload", "error"),
    [
        (record(b"no blank line, but many bytes of it"), b"no blank line, but many bytes of it", None),
        (record(b""), b"", None),
        (record(b"HTTP/1.1 200 OK\r\n\r\n"), b"", None),
        (record(b"HTTP/1.1 200 OK\r\n\r"), b"HTTP/1.1 200 OK\r\n\r", None),
        (record(b"HTTP/1.1 200 OK\r\nY: 2\r\n\r\nfree text", length=b""), b"free text", "no usable Content-Length"),
        (record(b"free\r\n\r\ntext", kind=b"text/plain", length=b"-5"), b"free\r\n\r\ntext", "no usable Content-Length"),
        (record(b"", kind=b"text/plain", length=b"x"), b"", "no usable Content-Length"),
    ],
)
def test_malformed_records_leave_the_next_one_intact(bad, payload, error, size, gzipped):
    pack = gzip.compress if gzipped else bytes
    rows = list(itertools.islice(A.archive_chunks(io.BytesIO(pack(GOOD) + pack(bad) + pack(GOOD)), "p", size), 100))
    told = {n: b"".join(r[7] for r in rows if r[1] == n) for n in range(3)}
    assert told == {0: b"<p>good</p>", 1: payload, 2: b"<p>good</p>"}
    last = [r for r in rows if r[9]]
    assert [r[1] for r in last] == [0, 1, 2] and dict(last[1][4]).get("error") == error and "error" not in dict(last[2][4])
    assert dict(last[0][4])["http-x"] == "1" and last[1][8] == hashlib.sha1(payload).hexdigest()


def test_archives_that_end_early_or_are_none():
    whole = gzip.compress(GOOD) + gzip.compress(record(b"HTTP/1.1 200 OK\r\n\r\n" + b"0123456789" * 50))
    for cut in range(len(gzip.compress(GOOD)) + 1, len(whole)):
        rows = list(itertools.islice(A.archive_chunks(io.BytesIO(whole[:cut]), "p", 100), 100))
        assert b"".join(r[7] for r in rows if r[1] == 0) == b"<p>good</p>" and rows[-1][9]
        assert len(rows) == 1 or "error" in dict(rows[-1][4]) or cut > len(whole) - 30
    plain = GOOD + record(b"0123456789", kind=b"text/plain", length=b"99")
    rows = list(A.archive_chunks(io.BytesIO(plain), "p", 100))
    assert rows[-1][7].startswith(b"0123456789") and dict(rows[-1][4])["error"] == "the archive ends within the record"
    for junk in (b"junk", b"junk\r\n\r\nmore", b"\r\n\r\n\r\nWARC/1.0\r\nno end", b"x" * (3 << 20), gzip.compress(b"junk"), b"\x1f\x8bno gzip"):
        rows = list(A.archive_chunks(io.BytesIO(junk), "p", 100))
        assert len(rows) <= 1 and all("error" in dict(r[4]) and r[9] for r in rows)
    assert list(A.archive_chunks(io.BytesIO(b""), "p", 100)) == [] == list(A.archive_chunks(io.BytesIO(b"\r\n\r\n"), "p", 100))


def test_empty_table(spark):
    assert A.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
