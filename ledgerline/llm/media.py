"""Media columns: content-addressed payloads in tar shards, metadata from range reads of headers.

``store`` writes each distinct payload once, under its SHA-256, into tar files in the shared folder; the
index has (digest, shard, offset, length), and a row of the caller carries its payload's digest. What a
format's header tells fills columns of the index by reads of HEAD bytes at each payload's place
(``fill_metadata``); whole payloads are read only where they are asked for (``read_back``).

Shards have a name of their own for every attempt at a task, so what a lost task left is never listed. A
task holds one payload and the digests of one shard. Payloads that come twice, in different tasks, are
found by their digests when the index is made: one place counts.

``text_payloads`` makes a payload of a text: its UTF-8 bytes and bytes 255 up to a positive multiple of
UNIT, stored as an 8-bit grayscale PNG of UNIT columns.

Defined results: a null text counts as empty, which is one line of 255; a null payload is not stored; equal payloads have
one digest and place; a header of no known format gives a null format and null columns; an empty table gives no shard and
an empty index; other columns are kept by the caller.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean, prepare, text_or_empty
from .exact_dedup import drop_copies

#: Bytes after which a task begins another shard, and bytes of a header read.
SHARD_BYTES, HEAD = 64 << 20, 4096
#: Bytes of a line of pixels, and zlib's level.
UNIT, LEVEL = 576, 6
INDEX = "digest string, shard string, offset long, length long"
METADATA = "format string, width long, height long, channels int, bits int, rate long"


def _files(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def png(samples: bytes, width: int) -> bytes:
    """An 8-bit grayscale PNG of the lines of ``width`` samples."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.frombuffer(samples, np.uint8).reshape(-1, width)
    plain = np.zeros((len(lines), width + 1), np.uint8)  # a line begins with its filter, 0
    plain[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def samples(data: bytes) -> bytes:
    """The samples of a PNG that ``png`` wrote; chunks' checksums must hold."""
    width, height = struct.unpack(">II", data[16:24])
    if data[24:29] != b"\x08\0\0\0\0":
        raise ValueError("not an 8-bit grayscale image")
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum does not hold")
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:].tobytes()


def _jpeg(head: bytes) -> tuple | None:
    at = 2
    while at + 9 < len(head) and head[at] == 0xFF:
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):
            bits, height, width, channels = struct.unpack(">BHHB", head[at + 4 : at + 10])
            return "jpeg", width, height, channels, bits, None
        at += 2 + size
    return "jpeg", None, None, None, None, None


def metadata(head: bytes) -> tuple:
    """(format, width, height, channels, bits, rate) from a file's first bytes; nulls where they do not say."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
            width, height, bits, color = struct.unpack(">IIBB", head[16:26])
            return "png", width, height, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color), bits, None
        if head[:6] in (b"GIF87a", b"GIF89a"):
            width, height, flags = struct.unpack("<HHB", head[6:11])
            return "gif", width, height, 1, (flags & 7) + 1, None
        if head[:2] == b"BM" and len(head) >= 30:
            width, height, _, depth = struct.unpack("<iiHH", head[18:30])
            return "bmp", width, abs(height), max(1, depth // 8), min(depth, 8), None
        if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
            at = head.index(b"fmt ", 12)
            channels, rate = struct.unpack("<HI", head[at + 10 : at + 16])
            return "wav", None, None, channels, struct.unpack("<H", head[at + 22 : at + 24])[0], rate
        if head[:3] == b"\xff\xd8\xff":
            return _jpeg(head)
    except (struct.error, ValueError, IndexError):  # cut short
        pass
    return None, None, None, None, None, None


@lean
def _write(batches: Iterator[pa.RecordBatch], folder: str, encode: Callable[[bytes], bytes] | None) -> Iterator[pa.RecordBatch]:
    """(payload) -> index rows; files are tar archives of members named by digest."""
    store, path = _files(folder)
    out = name = None
    at, rows, seen = 0, [], set()

    def close() -> pa.RecordBatch:
        out.write(b"\0" * 1024)
        out.close()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["digest", "shard", "offset", "length"])

    for b in batches:
        for value in b.column(0):
            if not value.is_valid:
                continue
            data = value.as_py() if encode is None else encode(value.as_py())
            digest = hashlib.sha256(data).hexdigest()
            if digest in seen:
                continue
            if out is None:
                name, at, rows = f"{uuid.uuid4().hex}.tar", 0, []
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            member = tarfile.TarInfo(f"{digest[:2]}/{digest}")
            member.size = len(data)
            head = member.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
            out.write(head + data + b"\0" * (-len(data) % 512))
            rows.append((digest, name, at + len(head), len(data)))
            seen.add(digest)
            at += len(head) + len(data) + -len(data) % 512
            if at >= SHARD_BYTES:
                yield close()
                out = None
                seen.clear()
    if out is not None:
        yield close()


def store(rows: DataFrame, payload: Column, scratch: Scratch, encode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Writes the payloads of ``rows``, each first through ``encode`` if given; the index, a row a digest."""
    prepare(rows.sparkSession)
    folder = scratch.path("shards")
    written = scratch.table(rows.select(payload.alias("payload")).mapInArrow(lambda b: _write(b, folder, encode), INDEX), "written")
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    return written.groupBy("digest").agg(place).select("digest", "at.*")


@lean
def _ranges(batches: Iterator[pa.RecordBatch], folder: str, most: int | None, names: list[str], of: Callable[[bytes, str], tuple], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Index rows by shard and offset -> their columns and what ``of`` makes of the bytes at their place and the digest."""
    store_, path = _files(folder)
    name = file = None
    for b in batches:
        found = []
        for digest, shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
            if shard != name:
                if file is not None:
                    file.close()
                name, file = shard, store_.open_input_file(f"{path}/{shard}")
            found.append(of(file.read_at(length if most is None else min(most, length), offset), digest))
        columns = list(zip(*found, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)
    if file is not None:
        file.close()


def _mapped(index: DataFrame, scratch: Scratch, most: int | None, of: Callable[[bytes, str], tuple], columns: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType.fromDDL(columns)
    schema = T.StructType([*index.schema.fields, *new.fields])
    types, folder = to_arrow_schema(new).types, scratch.path("shards")
    return index.mapInArrow(lambda b: _ranges(b, folder, most, schema.names, of, types), schema)


def near(index: DataFrame) -> DataFrame:
    """The index dealt by shard, in the order of the places, as the range reads take it."""
    return index.repartition("shard").sortWithinPartitions("shard", "offset")


def fill_metadata(index: DataFrame, scratch: Scratch) -> DataFrame:
    """``index`` with the columns of METADATA, from HEAD bytes of each payload."""
    return _mapped(index, scratch, HEAD, lambda data, _: metadata(data), METADATA)


def read_back(index: DataFrame, scratch: Scratch, of: Callable[[bytes], tuple], columns: str) -> DataFrame:
    """``index`` with ``columns``, what ``of`` makes of each whole payload; it must be the one that was stored."""

    def checked(data: bytes, digest: str) -> tuple:
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"{digest}: the stored bytes are others")
        return of(data)

    return _mapped(index, scratch, None, checked, columns)


def text_payload(col: str = "text") -> Column:
    """UTF-8 bytes, then bytes 255 up to a positive multiple of UNIT."""
    data = F.encode(text_or_empty(col), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(UNIT))).cast("int") * UNIT
    return F.rpad(data, size, F.lit(b"\xff"))


def sample_features(data: bytes) -> tuple[str, int, int, str]:
    """(digest, CRC of the last 32, size, feature) of an image's samples.

    The feature: the mean of the samples in thousandths and, as 64 bits, which 64ths of them are as light
    as the mean at least.
    """
    own = samples(data)
    parts = np.frombuffer(own, np.uint8).reshape(64, -1).sum(1, dtype=np.int64)
    total = int(parts.sum())
    light = np.packbits(64 * parts >= total).tobytes().hex()
    return hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(own), f"mean={1000 * total // len(own)} light={light}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) per row of ``docs``.

    Each distinct text is stored once; rows find their payload's features by its digest.
    """
    scratch = Scratch(docs.sparkSession, "media")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = scratch.table(store(drop_copies(own), text_payload(), scratch, lambda b: png(b, UNIT)), "index")
    scratch.free("written")
    columns = "payload_sha256 string, tail_crc32 long, payload_bytes long, feature string"
    read = read_back(fill_metadata(near(index), scratch), scratch, sample_features, columns)
    look = F.concat_ws(" ", "format", F.concat("width", F.lit("x"), "height"), F.concat("channels", F.lit("x"), "bits"), "feature").alias("feature")
    features = scratch.table(read.select("payload_sha256", "tail_crc32", "payload_bytes", F.col("length").alias("media_bytes"), F.col("digest").alias("media_sha256"), look), "features")
    rows = scratch.table(own.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), F.sha2(text_payload(), 256).alias("own")), "rows")
    # both sides are stored, so that rows of a text with many copies are dealt over several tasks
    met = rows.join(features, rows.own == features.payload_sha256, "left")
    return met.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
