"""WARC archives: pages written as one gzip member each, and archives read member by member, framed and verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot

#: Bytes that are read, and bytes that are decompressed, at once.
BLOCK = 1 << 18
#: Longest header of a record, and of the HTTP message in it.
HEAD = 1 << 20
#: Bytes of payload, or records, after which rows leave the reader.
ROWS_BYTES, ROWS = 4 << 20, 2000

VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, offset long, record_type string, record_id string, target_uri string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string, error string"


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _line(name: str, value: str) -> bytes:
    """A header line; what would end it early is percent-encoded."""
    return f"{name}: {''.join(f'%{ord(c):02X}' if ord(c) < 32 or c == chr(127) else c for c in value)}\r\n".encode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = VERSION + b"".join(_line(*h) for h in headers) + _line("Content-Length", str(len(block))) + b"\r\n"
    return z.compress(head) + z.compress(block) + z.compress(END) + z.flush()


def _uuid(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(key[:32])}>"


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, archive_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write a record for each page to gzip archives in `folder`, and return (archive, n_records, n_bytes), a stored table.

    The payload is the text in UTF-8, a null text an empty one. Of the pages with equal payloads of at least `least_bytes` bytes,
    that with the smallest id is a response and the others are revisits of it, which hold the HTTP head only; a page with a
    shorter payload is a response. Null ids come last; of pages with the same id and payload, the smallest url (null first)
    is the response and of equal rows any one. A null url is written as an empty one. Other columns are ignored.

    A payload moves once for each partition that has it: the smallest page of each is taken before the shuffle and after it.
    A task writes archives under names of its own, and only those of tasks that ended well are in the returned table, so a
    task that runs twice leaves no record twice. An archive ends at the first record beyond `archive_bytes`. `folder` is
    any URI that pyarrow.fs knows (file, hdfs, viewfs, s3, gs).
    """
    tmp = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("by"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    place = F.struct(F.col("by").isNull().alias("last"), "by", "url")
    large = rows.where(F.col("n") >= least_bytes)
    seen = tmp.table(large.select("id", "url", "key", "n", F.sha1("payload").alias("sha1"), place.alias("place"), F.monotonically_increasing_id().alias("u")))
    firsts = seen.groupBy("key").agg(F.min(F.struct("place", "u")).alias("first"))
    responses = large.groupBy("key").agg(F.min_by(F.struct("id", "url", "payload"), place).alias("f")).select("f.*", F.col("key").alias("record"))
    if least_bytes > 0:
        short = rows.where(F.col("n") < least_bytes).select("id", "url", "payload", F.md5(F.concat_ws(" ", "key", F.monotonically_increasing_id().cast("string"))).alias("record"))
        responses = responses.unionByName(short)
    others = join_hot(seen, firsts, ["key"], "u").where("u <> first.u")
    others = others.select("id", "url", "n", "sha1", F.col("key").alias("refers"), F.col("first.place.by").cast("string").alias("refers_id"), F.col("first.place.url").alias("refers_url"), F.md5(F.concat_ws(" ", "key", F.col("u").cast("string"))).alias("record"))
    records = responses.unionByName(others, allowMissingColumns=True)
    schema = "archive string, n_records long, n_bytes long"

    def write(batches):
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, count, size = "", None, 0, 0
        done: list[tuple[str, int, int]] = []

        def close():
            out.close()
            done.append((name, count, size))

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is not None and size >= archive_bytes:
                    close()
                    out = None
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _uuid(uuid.uuid4().hex)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                    out.write(info)
                    size += len(info)
                data = _page(r, date, level)
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "n_records", "n_bytes"])

    written = tmp.table(records.mapInArrow(write, schema))
    tmp.drop(seen)
    return written


def _page(r: dict, date: str, level: int) -> bytes:
    revisit = r["refers"] is not None
    body = b"" if revisit else r["payload"]
    digest = base32_digest(bytes.fromhex(r["sha1"]) if revisit else hashlib.sha1(body).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['n'] if revisit else len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uuid(r["record"])), ("WARC-Date", date), ("WARC-Target-URI", r["url"])]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_digest(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response")]
    headers += [] if r["id"] is None else [("Page-ID", r["id"])]
    if revisit:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _uuid(r["refers"])), ("WARC-Refers-To-Target-URI", r["refers_url"]), ("WARC-Refers-To-Date", date)]
        headers += [] if r["refers_id"] is None else [("Refers-To-Page-ID", r["refers_id"])]
    return member(headers, block, level)


class Broken(Exception):
    """What is wrong with a record."""


class Archive:
    """Members of a gzip file in order, decompressed a piece at a time; memory is bounded by BLOCK and HEAD, whatever a member holds."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at, self.whole = stream, b"", 0, True

    def _fill(self) -> bool:
        more = self.stream.read(BLOCK)
        self.buffer += more
        return bool(more)

    def more(self) -> bool:
        """Whether another member follows; zeros that pad the file are passed over."""
        while True:
            rest = self.buffer.lstrip(b"\0")
            self.at += len(self.buffer) - len(rest)
            self.buffer = rest
            if rest:
                return True
            if not self._fill():
                return False

    def seek_member(self, at: int) -> bool:
        """Go to the first place from `at` on that looks like a member."""
        self.stream.seek(at)
        self.buffer, self.at = b"", at
        while True:
            found = self.buffer.find(b"\x1f\x8b\x08")
            passed = found if found >= 0 else max(0, len(self.buffer) - 2)
            self.buffer, self.at = self.buffer[passed:], self.at + passed
            if found >= 0:
                return True
            if not self._fill():
                return False

    def pieces(self) -> Iterator[bytes]:
        z, self.whole = zlib.decompressobj(31), False
        while not z.eof:
            if not self.buffer and not self._fill():
                raise Broken("the archive ends within a member")
            try:
                data = z.decompress(self.buffer, BLOCK)
            except zlib.error as e:
                raise Broken(f"damaged member: {e}") from None
            rest = z.unused_data if z.eof else z.unconsumed_tail
            self.at += len(self.buffer) - len(rest)
            self.buffer, self.whole = rest, z.eof
            if data:
                yield data


class Member:
    """The decompressed bytes of a member, taken by length or up to a mark."""

    def __init__(self, pieces: Iterator[bytes]):
        self.source, self.held = pieces, b""

    def until(self, mark: bytes, limit: int) -> bytes:
        while (end := self.held.find(mark)) < 0:
            piece = next(self.source, b"")
            if not piece or len(self.held) > limit:
                raise Broken("a header does not end")
            self.held += piece
        head, self.held = self.held[:end], self.held[end + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.source, b"")
                if not self.held:
                    raise Broken("the block is shorter than its length says")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        """What is left, as far as it matters."""
        while len(self.held) <= len(END) and (piece := next(self.source, b"")):
            self.held += piece
        return self.held


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; a line that begins with a blank goes on with the one before, of repeated names the first counts."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("a header line has no colon")
        found.setdefault(name.strip().lower(), value.strip())
    return found


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() and len(text) < 19 else None


def _verify(said: str | None, known: str, what: str) -> None:
    """Compare a digest header with the SHA-1 found; other algorithms are not checked."""
    algorithm, _, value = (said or "").partition(":")
    if algorithm.lower() == "sha1" and value.upper() != known and value.lower() != base64.b32decode(known).hex():
        raise Broken(f"{what} digest differs")


def read_record(member_: Member, keep: bool) -> dict:
    """One record; `error` says what is wrong with it. A record without an HTTP message has its block as payload."""
    found: dict = {"headers": {}, "payload": None, "payload_bytes": None, "payload_digest": None, "error": None}
    try:
        head = member_.until(END, HEAD)
        if not head.startswith(b"WARC/1."):
            raise Broken("no WARC version")
        headers = found["headers"] = _fields(head.partition(b"\r\n")[2])
        length = _number(headers.get("content-length"))
        if length is None:
            raise Broken("no content length")
        block, payload, kept, size, http, inside = hashlib.sha1(), hashlib.sha1(), [], 0, b"", not headers.get("content-type", "").startswith("application/http")
        for piece in member_.take(length):
            block.update(piece)
            if not inside:
                http += piece
                end = http.find(END)
                if end < 0:
                    if len(http) > HEAD:
                        raise Broken("a header does not end")
                    continue
                inside, piece, http = True, http[end + len(END) :], http[:end]
            payload.update(piece)
            size += len(piece)
            if keep:
                kept.append(piece)
        tail = member_.rest()
        if tail != END:
            raise Broken("more follows the record" if tail.startswith(END) else "the block does not end where its length says")
        known = base32_digest(payload.digest())
        said = headers.get("warc-payload-digest")
        _verify(headers.get("warc-block-digest"), base32_digest(block.digest()), "block")
        if headers.get("warc-type", "").lower() == "revisit":
            # the payload is elsewhere: its length and digest are those stated
            found |= {"payload_bytes": _number(_fields(http.partition(b"\r\n")[2]).get("content-length")), "payload_digest": said.partition(":")[2].upper() if said else None}
        else:
            found |= {"payload": b"".join(kept) if keep else None, "payload_bytes": size, "payload_digest": known}
            _verify(said, known, "payload")
    except Broken as e:
        found["error"] = str(e)
    return found


def records(stream, keep: bool = True) -> Iterator[dict]:
    """The records of an archive by offset. A damaged stretch gives one row with an error; reading goes on at the next member that opens with a record."""
    archive, damaged = Archive(stream), False
    while archive.more():
        begin = archive.at
        one = Member(archive.pieces())
        found = read_record(one, keep) | {"offset": begin}
        try:
            for _ in one.source:  # of a record that was given up midway
                pass
        except Broken as e:
            found["error"] = found["error"] or str(e)
        if archive.whole or not damaged:
            yield found
        damaged = not archive.whole
        if damaged and not archive.seek_member(begin + 1):
            return


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, n_bytes) of the files under a path or glob; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), F.col("length").alias("n_bytes"))


def read_archives(archives: DataFrame, payload: bool = True, most_tasks: int = 20_000) -> DataFrame:
    """RECORDS of archives(archive): a task streams through an archive, a quarter of a megabyte at a time.

    headers have lower-cased names. payload (null unless asked for), payload_bytes and payload_digest (bare base32 SHA-1) are of
    the payload found; of a revisit, they are null, the length in its HTTP head and the digest stated. error is null where
    the framing and the SHA-1 digests of block and payload hold; it names the first fault else, and the row stays.
    Only records whose payload is asked for are held whole, one at a time and up to 4 MB more.
    """
    n = max(1, min(most_tasks, archives.count()))

    def read(batches):
        rows: list[dict] = []
        held = 0

        def flush():
            columns = [pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, list(kinds))

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, path = FileSystem.from_uri(name)
                with fs.open_input_file(path) as stream:
                    for r in records(stream, payload):
                        h = r["headers"]
                        r |= {"archive": name, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "headers": list(h.items())}
                        rows.append(r)
                        held += len(r["payload"] or b"")
                        if held >= ROWS_BYTES or len(rows) >= ROWS:
                            yield flush()
                            held = 0
        if rows:
            yield flush()

    kinds = {"archive": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "error": pa.string()}
    return archives.select("archive").repartition(n).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written to the shared folder and read back; a record that fails its check raises."""
    tmp = Scratch(pages.sparkSession)
    folder = f"{tmp.root}/archives"
    written = write_pages(pages, folder, **how)
    found = read_archives(written, payload=False).where("record_type <> 'warcinfo' or error is not null")
    whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("WARC record at"), "archive", F.col("offset").cast("string"), "error")).cast("string"))
    back = tmp.table(found.select(F.col("headers")["page-id"].cast("long").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), F.col("headers")["refers-to-page-id"].cast("long").alias("refers_to")))
    tmp.paths[id(written)] = folder  # the archives are read, their rows stored
    tmp.drop(written)
    return back
