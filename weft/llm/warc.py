"""WARC archives: whole-file gzip in, one gzip member per record and a sidecar offset index out, as files."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import durable, shared_folder, slices, storage

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Every record's date; a rerun writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
ARCHIVE_SCHEMA = "archive string, records bigint, bytes bigint"
ENTRY_SCHEMA = "archive string, offset bigint, length bigint, record_id string, record_type string, uri string"
#: What is appended to an archive's name for its sidecar index, one JSON object a line.
SIDECAR = ".idx"
#: Bytes that are read from a file at a time.
CHUNK = 1 << 20
RECORD_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class Entry(NamedTuple):
    """A line of the sidecar index."""

    offset: int
    length: int
    record_id: str
    record_type: str
    uri: str | None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """The WARC record of a page: a response with its payload, or a revisit of page ``refers_to`` with the
    HTTP header block only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " else " " for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_stream(parts: Iterable[bytes], level: int = 1) -> bytes:
    """One gzip member over all parts, as a careless crawler writes a file."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, parts), z.flush()])


def inflate(chunks: Iterable[bytes], piece: int = 1 << 18) -> Iterator[bytes]:
    """The inflated bytes of a gzip file in pieces, each input byte read once.  A file of many members
    is read as well; bytes after the last member that start no member are ignored, a member that ends
    too early raises."""
    z, open_member = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            if not open_member and not chunk.strip(b"\0"):
                break
            open_member = True
            out = z.decompress(chunk, piece)
            if out:
                yield out
            if z.eof:
                chunk, z, open_member = z.unused_data, zlib.decompressobj(31), False
            else:
                chunk = z.unconsumed_tail
    if open_member:
        raise EOFError("the gzip stream ends inside a member")


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(data: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an inflated stream; holds one record at a time."""
    buffer, source = bytearray(), iter(data)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            if (more := next(source, None)) is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[:1]
        if not buffer:
            return
        searched = 0
        while (at := buffer.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(buffer)
            if not fill(searched + 1):
                raise EOFError("the stream ends inside a record's header")
        head = headers_of(bytes(buffer[:at]))
        end = at + 4 + int(head["content-length"])
        if not fill(end):
            raise EOFError("the stream ends inside a record's block")
        yield head, bytes(buffer[:end]) + b"\r\n\r\n"
        del buffer[:end]


def rewrite(chunks: Iterable[bytes], level: int = 4) -> Iterator[tuple[Entry, bytes]]:
    """Each record of a gzip WARC file, of one member or many, as a member of its own with its index entry.  The
    file is inflated once; one record is held at a time."""
    offset = 0
    for head, record in split_records(inflate(chunks)):
        member = gzip_stream([record], level)
        yield Entry(offset, len(member), head.get("warc-record-id", ""), head.get("warc-type", ""), head.get("warc-target-uri")), member
        offset += len(member)


def normalise(chunks: Iterable[bytes], level: int = 4) -> tuple[bytes, list[Entry]]:
    """A whole small file in memory: (normalised bytes, index)."""
    done = list(rewrite(chunks, level))
    return b"".join(m for _, m in done), [e for e, _ in done]


# Files


def chunks_of(uri: str) -> Iterator[bytes]:
    store, path = storage(uri)
    with store.open_input_stream(path, compression=None) as f:
        while part := f.read(CHUNK):
            yield part


def write_normalised(chunks: Iterable[bytes], archive: str, level: int = 4) -> tuple[str, int, int]:
    """Writes ``archive`` and its sidecar record by record; (archive, records, bytes)."""
    store, path = storage(archive)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    records = size = 0
    with store.open_output_stream(path, compression=None) as body, store.open_output_stream(path + SIDECAR, compression=None) as index:
        for entry, member in rewrite(chunks, level):
            body.write(member)
            index.write(json.dumps(entry._asdict(), ensure_ascii=False).encode("utf-8", "replace") + b"\n")
            records += 1
            size += len(member)
    return archive, records, size


def entries_of(archive: str) -> Iterator[Entry]:
    """The lines of an archive's sidecar."""
    store, path = storage(archive + SIDECAR)
    with store.open_input_stream(path, compression=None) as f:
        for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
            yield Entry(**json.loads(line))


def read_member(body: bytes, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of the record whose member is at ``offset``."""
    record = zlib.decompress(memoryview(body)[offset : offset + length], 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = headers_of(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, headers_of(http), payload


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


class _Crawl:
    """A file as a careless crawler leaves it, one gzip member over all records, written as records come."""

    def __init__(self, folder: str):
        self.archive = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.store, self.path = storage(self.archive + ".crawl")
        self.store.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.file, self.z, self.size = self.store.open_output_stream(self.path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0

    def add(self, record: bytes) -> None:
        self.file.write(self.z.compress(record))
        self.size += len(record)

    def normalised(self) -> tuple[str, int, int]:
        """Ends the file, rewrites it, and drops it."""
        self.file.write(self.z.flush())
        self.file.close()
        done = write_normalised(chunks_of(self.archive + ".crawl"), self.archive)
        self.store.delete_file(self.path)
        return done


def _archive_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])


def _archives(batches: Iterator[pa.RecordBatch], archive_bytes: int, folder: str) -> Iterator[pa.RecordBatch]:
    crawl = None
    for b in slices(batches):
        cols = [b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
        for i in range(b.num_rows):
            page_id, url, html, digest, refers_to = (c[i].as_py() for c in cols)
            crawl = crawl or _Crawl(folder)
            crawl.add(page_record(page_id, url, (html or "").encode(), digest, refers_to))
            if crawl.size >= archive_bytes:
                yield _archive_rows([crawl.normalised()])
                crawl = None
    if crawl:
        yield _archive_rows([crawl.normalised()])


def write_archives(pages: DataFrame, min_bytes: int = 1000, archive_bytes: int = 4 << 20, broadcast_rows: int = 100_000, folder: str | None = None) -> DataFrame:
    """Pages (page_id, url, html) as archives in ``folder`` (by default a new one among the session's shared
    folders, kept until the driver ends): (archive, records, bytes), a row a file.

    A task writes its rows into files of about ``archive_bytes``, each first one monolithic gzip stream as
    crawlers leave it, which is then rewritten with a member for each record and a sidecar index of offsets.
    Of the pages of one payload of at least ``min_bytes``, that with the largest page_id is a response and the
    others revisit it; null page_ids count as smallest, and a group of them alone is all response.  Null html is
    the empty payload.  Only (page_id, digest) is grouped; the text is moved by page_id, or not at all if at
    most ``broadcast_rows`` rows revisit.  Repeated rows give repeated records; an empty table gives no file;
    other columns are ignored.  A task that runs again writes files of its own: those of a lost one are in no
    row of the result.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(text.cast("binary")).alias("digest"))
    keys = durable(pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest")))
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = durable(keys.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct())
    found = revisits.count()
    revisits = revisits.toDF("_page", "_digest", "refers_to")
    if found <= broadcast_rows:
        revisits = F.broadcast(revisits)
    same = rows["page_id"].eqNullSafe(revisits["_page"]) & (rows["digest"] == revisits["_digest"])
    marked = rows.join(revisits, same, "left").select("page_id", "url", "html", "digest", "refers_to")
    return durable(marked.mapInArrow(lambda it: _archives(it, archive_bytes, folder), ARCHIVE_SCHEMA))


def normalise_archives(files: DataFrame, folder: str | None = None, stream: bool = True) -> DataFrame:
    """Gzip WARC files as Spark's binaryFile source lists them (path, content), rewritten into ``folder``:
    (archive, records, bytes).  With ``stream`` workers read the paths, files of any size, a piece at a time;
    without, the content comes through Spark, which ends at 2 GB a file but reaches any store that Spark does.
    No files give no rows; a broken file raises."""
    folder = folder or shared_folder(files.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                archive = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                if stream:
                    chunks = chunks_of(path)
                else:
                    view = memoryview(b.column("content")[i].as_buffer() or b"")
                    chunks = (bytes(view[k : k + CHUNK]) for k in range(0, len(view), CHUNK))
                yield _archive_rows([write_normalised(chunks, archive)])

    return durable(files.select("path", *([] if stream else ["content"])).mapInArrow(run, ARCHIVE_SCHEMA))


def read_index(archives: DataFrame) -> DataFrame:
    """(archive, offset, length, record_id, record_type, uri): the sidecars' lines, none for no archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "length", "record_id", "record_type", "uri"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for archive in b.column("archive").to_pylist():
                lines = entries_of(archive)
                while rows := [(archive, *e) for e in islice(lines, 4096)]:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive").mapInArrow(run, ENTRY_SCHEMA)


def read_archives(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per record of normalised archives, each read from storage by its offset: (page_id, url,
    payload_bytes, payload_digest, record_type, refers_to).  Size and digest of a response are those of the
    payload read; of a revisit, what its headers say of the full payload.  A response whose payload doesn't have
    the digest of its header raises.  With ``tasks`` index lines are dealt out first, for archives that are too
    large for a task.  No archives give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        opened, f = None, None
        for b in slices(batches):
            out = []
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != opened:
                    if f is not None:
                        f.close()
                    store, path = storage(archive)
                    opened, f = archive, store.open_input_file(path)
                head, http, payload = read_member(f.read_at(length, offset), 0, length)
                kind, said = head["warc-type"], base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"{head['warc-record-id']}: payload digest {digest}, header {said}")
                else:
                    size, digest = int(http["content-length"]), said
                out.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, kind, _page(head.get("warc-refers-to"))))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if f is not None:
            f.close()

    entries = read_index(archives)
    return (entries.repartition(tasks) if tasks else entries).mapInArrow(run, RECORD_SCHEMA)
