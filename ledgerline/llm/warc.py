"""WARC archives: written as one gzip stream per file, normalised to one member per record.

``write_archives`` groups pages by payload, gives every payload that is long enough one response
record and its repeats revisit records, and writes archives whose whole file is a single gzip
stream. ``normalise`` inflates such a stream once, front to back, rewrites every record as a gzip
member of its own and keeps an index of their places. ``read_records`` fetches records through the
index. Archives are stored files in the shared folder; workers hold one record and one buffer.

Defined results: a null page is an empty payload; payloads under ``least`` bytes are all responses;
of repeated rows with the smallest id one is the response; a null id ranks last; an empty table
gives no archive and an empty result; line ends in a url are percent-encoded; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepare, Scratch

#: Payload bytes after which a task begins another archive, bytes inflated at a time.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, size long, record_id string, record_type string"


def _record_id(page_id: object) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    return None if not record_id or "null" in record_id else int(record_id[len("<urn:x-page:") : -1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record: an HTTP response, or a revisit that holds its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


class Cutter:
    """Cuts a stream of inflated bytes into whole records."""

    def __init__(self) -> None:
        self._held = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self._held += data
        at = 0
        while (end := self._held.find(b"\r\n\r\n", at)) >= 0:
            size = end + 4 + int(headers(bytes(self._held[at:end]))["content-length"]) + 4
            if size > len(self._held):
                break
            yield bytes(self._held[at:size])
            at = size
        del self._held[:at]

    def close(self) -> None:
        if self._held:
            raise ValueError(f"the archive ends inside a record ({len(self._held)} bytes)")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _files(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


@lean
def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(page_id, url, payload, digest, refers_to, revisit) -> (archive, records), files of one gzip stream."""
    store, path = _files(folder)
    out = packer = name = None
    size = count = 0

    def close() -> pa.RecordBatch:
        out.write(packer.flush())
        out.close()
        return pa.RecordBatch.from_pydict({"archive": [name], "records": [count]})

    for b in batches:
        for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if out is None:
                # a name of its own for every attempt: what a lost task left is never listed
                name, packer, size, count = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(3, zlib.DEFLATED, 31), 0, 0
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            data = record(page_id, url, payload, digest, refers_to, revisit)
            out.write(packer.compress(data))
            size, count = size + len(data), count + 1
            if size >= ARCHIVE_BYTES:
                yield close()
                out = None
    if out is not None:
        yield close()


@lean
def _normalise(batches: Iterator[pa.RecordBatch], source: str, target: str) -> Iterator[pa.RecordBatch]:
    """(archive) -> index rows; beside each new archive goes the index as a sidecar file."""
    store, src = _files(source)
    _, dst = _files(target)
    for b in batches:
        for name in b.column(0).to_pylist():
            inflate, cut, at, fresh = zlib.decompressobj(31), Cutter(), 0, f"{uuid.uuid4().hex}.warc.gz"
            rows: list[tuple] = []
            with store.open_input_stream(f"{src}/{name}", compression=None) as read, store.open_output_stream(f"{dst}/{fresh}", compression=None) as write:
                while data := read.read(CHUNK):
                    while data:
                        for one in cut.feed(inflate.decompress(data, CHUNK)):
                            packed = member(one)
                            h = headers(one[: one.index(b"\r\n\r\n")])
                            rows.append((fresh, at, len(packed), h["warc-record-id"], h["warc-type"]))
                            write.write(packed)
                            at += len(packed)
                        data = inflate.unconsumed_tail
                        if inflate.eof:
                            data = inflate.unused_data
                            if data:  # archives of several members are taken as well
                                inflate = zlib.decompressobj(31)
                if not inflate.eof:
                    raise ValueError(f"{name} is cut short")
                cut.close()
            with store.open_output_stream(f"{dst}/{fresh}.idx", compression=None) as side:
                for row in rows:
                    side.write(("\t".join(map(str, row[1:])) + "\n").encode())
            for a in range(0, len(rows), 5000):
                columns = list(zip(*rows[a : a + 5000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["archive", "offset", "size", "record_id", "record_type"])


@lean
def _read(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Index rows, sorted by archive and offset -> what each record says, payloads checked."""
    store, path = _files(folder)
    name = file = None
    for b in batches:
        out: list[list] = [[] for _ in schema]
        for archive, offset, size in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "size")), strict=True):
            if archive != name:
                if file is not None:
                    file.close()
                name, file = archive, store.open_input_file(f"{path}/{archive}")
            file.seek(offset)
            data = zlib.decompress(file.read(size), 31)
            head, _, block = data.partition(b"\r\n\r\n")
            h = headers(head)
            http, _, payload = block[:-4].partition(b"\r\n\r\n")
            full, digest = int(headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha256:")
            revisit = h["warc-type"] == "revisit"
            if not revisit and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{h['warc-record-id']}: its payload is not what was written")
            for column, value in zip(out, (_page_id(h["warc-record-id"]), full, digest, h["warc-type"], _page_id(h.get("warc-refers-to"))), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def mark_repeats(pages: DataFrame, scratch: Scratch, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit) of ``pages`` (page_id, url, html).

    Only digests and ids are counted, before they are shuffled; the table of repeated payloads then
    meets the pages in one join, whose large groups adaptive execution splits.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    ids = own.filter(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = ids.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("nil"), F.col("page_id").alias("id"), "n")).alias("first"), F.sum("n").alias("rows"))
    first = scratch.table(first.filter("rows > 1").select("digest", "first"), "repeats")
    marked = own.join(first, "digest", "left")
    response = F.col("page_id").eqNullSafe(F.col("first.id"))
    if not first.filter("first.n > 1").isEmpty():  # rows repeated with their id: one of them is the response
        each = Window.partitionBy("digest", "page_id").orderBy("url")
        marked = marked.withColumn("place", F.row_number().over(each))
        response &= F.col("place") == 1
    revisit = F.col("first").isNotNull() & ~response
    return marked.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first.id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 100) -> DataFrame:
    """Writes the archives; (archive, records) of each."""
    prepare(pages.sparkSession)
    folder = scratch.path("archives")
    rows = mark_repeats(pages, scratch, least)
    return scratch.table(rows.mapInArrow(lambda b: _write(b, folder), "archive string, records long"), "written")


def normalise(written: DataFrame, scratch: Scratch) -> DataFrame:
    """Rewrites the archives listed with a member per record; the index of the new ones."""
    source, target = scratch.path("archives"), scratch.path("members")
    n = max(1, min(written.count(), 100_000))
    return scratch.table(written.select("archive").repartition(n).mapInArrow(lambda b: _normalise(b, source, target), INDEX), "index")


def read_records(index: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records indexed.

    A revisit holds no payload: its size and digest are those of the response that it refers to, as read;
    the digest and length that its own header names must agree with them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    arrow, folder = to_arrow_schema(schema), scratch.path("members")
    near = index.repartition("archive").sortWithinPartitions("archive", "offset")
    read = scratch.table(near.mapInArrow(lambda b: _read(b, folder, arrow), schema), "read")
    # only responses that are referred to are needed; both sides are stored, so that a hot one is split
    said = read.filter("record_type = 'revisit'")
    names = said.select("refers_to", "payload_digest").distinct()
    own = read.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("held")).distinct()
    held = scratch.table(own.join(names, own.refers_to.eqNullSafe(names.refers_to) & (own.payload_digest == names.payload_digest), "left_semi"), "held")
    met = said.join(held, said.refers_to.eqNullSafe(held.refers_to) & (said.payload_digest == held.payload_digest), "left")
    lost = F.concat(F.lit("no response of this payload: "), F.coalesce(said.page_id.cast("string"), F.lit("null")))
    resolved = F.when(held.held == said.payload_bytes, held.held).otherwise(F.raise_error(lost).cast("long"))
    met = met.select(said.page_id, resolved.alias("payload_bytes"), held.payload_digest, said.record_type, said.refers_to)
    return read.filter("record_type <> 'revisit'").unionByName(met)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes, normalises and reads back an archive of ``pages``."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_records(normalise(write_archives(pages, scratch, least), scratch), scratch)
