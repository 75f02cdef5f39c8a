import base64
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from turnwise.llm import queries
from turnwise.llm.warc import list_archives, member, read_archives, records, round_trip, write_pages


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= least:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        again = first.get(t or "", i) != i
        out.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", first[t or ""] if again else None))
    return sorted(out, key=str)


def test_whole_table_and_sql(spark):
    got = sorted((tuple(r) for r in queries.op13_warc(spark, "/root/testdata/sf0.01").collect()), key=str)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert got == brute([(r.page_id, r.url, r.html) for r in pages])
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    assert sorted((tuple(r) for r in con.execute(queries.WARC_SQL).fetchall()), key=str) == got


ROWS = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "same"), (4, "http://a/\r\nX: 1", "naïve ☃ \r\n\r\n text"), (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7", "z" * 3_000_000), (8, "http://a/8", "z" * 3_000_000), (-9, "http://a/9", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_revisits(spark, least):
    pages = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "page_id long, url string, html string, id string, n int")
    got = sorted((tuple(r) for r in round_trip(pages, least_bytes=least, archive_bytes=200).collect()), key=str)
    assert got == brute(ROWS, least)
    assert round_trip(pages.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "a")] * 3 + [(1, "t", "a"), (None, "u", "a"), (None, "u", "b"), (None, "u", "b")]
    got = sorted((tuple(r)[0], *tuple(r)[3:]) for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).fillna(-1).collect())
    assert got == [(-1, "response", -1), (-1, "revisit", -1), (-1, "revisit", 1), (1, "response", -1), (1, "revisit", 1), (1, "revisit", 1), (1, "revisit", 1)]


def test_archives_are_plain_warc(spark, tmp_path):
    """One gzip member for each record; payloads and links hold; the archives can be listed and read by path."""
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    written = write_pages(pages, f"file://{tmp_path}", archive_bytes=1000).collect()
    assert sum(r.n_records for r in written) == len(ROWS)
    rows = read_archives(list_archives(spark, f"file://{tmp_path}")).collect()
    assert not [r.error for r in rows if r.error] and sum(r.record_type == "warcinfo" for r in rows) == len(written)
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows)
    texts = {i: t or "" for i, _, t in ROWS}
    for r in rows:
        if r.record_type == "response":
            assert r.payload.decode() == texts[int(r.headers["page-id"])]
        elif r.record_type == "revisit":
            assert ids[r.headers["warc-refers-to"]].payload_digest == r.payload_digest
    for w in written:
        data = open(w.archive.removeprefix("file://"), "rb").read()
        n = 0
        while data:
            z = zlib.decompressobj(31)
            one = z.decompress(data)
            assert z.eof and one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
            data, n = z.unused_data, n + 1
        assert n == w.n_records + 1


def record(kind="response", body=b"hello", extra=(), length=None, tail=b"\r\n\r\n"):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"Content-Type: application/http", b"Content-Length: %d" % (len(block) if length is None else length), *extra]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + tail)


def test_faults_are_named_and_reading_goes_on():
    good = member([("WARC-Type", "resource"), ("WARC-Payload-Digest", f"sha1:{digest('x')}")], b"x")
    wrong = {
        "payload digest": record(extra=[b"WARC-Payload-Digest: sha1:" + digest("other").encode()]),
        "block digest": record(extra=[b"WARC-Block-Digest: sha1:" + digest("other").encode()]),
        "shorter": record(length=4000),
        "more follows": record(tail=b"\r\n\r\nWARC/1.1\r\n"),
        "does not end where": record(length=28),
        "no content length": gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"),
        "no WARC version": gzip.compress(b"HELLO\r\n\r\n"),
        "no colon": gzip.compress(b"WARC/1.1\r\nwhat\r\n\r\n"),
        "does not end": gzip.compress(b"WARC/1.1\r\n" + b"a: b\r\n" * 9),
    }
    for what, data in wrong.items():
        found = list(records(io.BytesIO(good + data + good)))
        assert [r["error"] for r in found][::2] == [None, None] and what in found[1]["error"], what
        assert found[0]["offset"] == 0 and found[1]["offset"] == len(good) and found[2]["offset"] == len(good + data) and found[2]["payload"] == b"x"


def test_damaged_and_cut_members():
    good = member([("WARC-Type", "resource")], b"x" * 50)
    other = bytearray(record(body=bytes(range(256)) * 40))
    other[len(other) // 2] ^= 255
    found = list(records(io.BytesIO(good + bytes(other) + b"\0\0" + good)))
    assert [r["error"] is None for r in found] == [True, False, True] and found[2]["payload"] == b"x" * 50
    found = list(records(io.BytesIO(good + good[:-20])))
    assert [r["error"] for r in found] == [None, "the archive ends within a member"]
    assert [r["error"] is None for r in records(io.BytesIO(b"no archive at all" + good))] == [False, True]
    assert list(records(io.BytesIO(b""))) == []
    digests = [record(extra=[b"WARC-Payload-Digest: " + d]) for d in (b"sha1:" + digest("hello").lower().encode(), b"sha1:" + hashlib.sha1(b"hello").hexdigest().encode(), b"md5:whatever")]
    assert [r["error"] for r in records(io.BytesIO(b"".join(digests)))] == [None] * 3


def test_a_large_record_is_read_in_pieces():
    class Stream(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert 0 < n <= 1 << 18
            return super().read(n)

    body = b"0123456789" * 2_000_000
    found = list(records(Stream(record(body=body)), keep=False))
    assert found[0]["payload"] is None and found[0]["payload_bytes"] == len(body) and found[0]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
