import hashlib
import io
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import media, queries as corpus
from ledgerline.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def png_samples(data):
    """The samples of a grayscale PNG without filters, read by its public layout."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]
        head, packed, at = body if kind == b"IHDR" else head, packed + body * (kind == b"IDAT"), at + 12 + size
    width, height = struct.unpack(">II", head[:8])
    plain = zlib.decompress(packed)
    return width, height, b"".join(plain[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


def expected(text):
    data = (text or "").encode()
    full = data + b"\xff" * (-len(data) % 576 if data else 576)
    return len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])


def check(got, rows):
    want = sorted(((i, *expected(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == want
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
        assert r.feature.startswith(f"png 576x{r.payload_bytes // 576} 1x8 ")
    assert all(len(v) == 1 for v in by.values())


def test_the_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = corpus.op11_media_columns(spark, SF).collect()
    check(got, docs)
    text = {r.doc_id: r.text or "" for r in docs}
    for r in got:
        data = text[r.doc_id].encode()
        stored = media.png(data + b"\xff" * (-len(data) % 576 if data else 576), 576)
        assert (len(stored), hashlib.sha256(stored).hexdigest()) == (r.media_bytes, r.media_sha256)


def test_odd_rows(spark, odd_docs, no_docs):
    clashing = odd_docs.withColumns({n: F.lit(n) for n in ("digest", "shard", "own", "payload", "feature", "n_bytes")})
    check(media.text_media(clashing).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert media.text_media(no_docs).count() == 0


def test_shards_are_tar_files_with_each_payload_once(spark, monkeypatch):
    rows = [(bytes([i % 7]) * (100 * (i % 7)),) for i in range(400)] + [(None,)] * 3
    scratch = Scratch(spark, "media-test")
    index = media.store(spark.createDataFrame(rows, "payload binary").repartition(5), F.col("payload"), scratch).collect()
    assert {r.digest for r in index} == {hashlib.sha256(r[0]).hexdigest() for r in rows if r[0] is not None} and len(index) == 7
    held = {r.path.rsplit("/")[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(scratch.path("shards")).collect()}
    for r in index:
        assert hashlib.sha256(held[r.shard][r.offset : r.offset + r.length]).hexdigest() == r.digest
    for data in held.values():
        for m in (files := tarfile.open(fileobj=io.BytesIO(data))).getmembers():
            assert m.name.split("/")[1] == hashlib.sha256(files.extractfile(m).read()).hexdigest()


def test_a_changed_payload_is_told(spark):
    scratch = Scratch(spark, "media-test")
    index = scratch.table(media.store(spark.createDataFrame([(b"abc",), (b"defg",)], "payload binary"), F.col("payload"), scratch), "index")
    moved = index.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception, match="the stored bytes are others"):
        media.read_back(media.near(moved), scratch, lambda d: (len(d),), "n long").collect()


def test_headers_alone_fill_the_columns(spark):
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + b"\0" * 9000
    gif = b"GIF89a" + struct.pack("<HHB", 320, 200, 0xF7) + b"\0" * 40
    bmp = b"BM" + b"\0" * 16 + struct.pack("<iiHH", 64, -48, 1, 24) + b"\0" * 40
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 600, 800, 3) + b"\0" * 40
    rows = [wav, gif, bmp, jpeg, media.png(b"\1" * 24, 6), b"plain text", b"", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"]
    scratch = Scratch(spark, "media-test")
    index = media.store(spark.createDataFrame([(r,) for r in rows], "payload binary"), F.col("payload"), scratch)
    got = {r.digest: tuple(r)[4:] for r in media.fill_metadata(media.near(index), scratch).collect()}
    want = [("wav", None, None, 2, 16, 44100), ("gif", 320, 200, 1, 8, None), ("bmp", 64, 48, 3, 8, None), ("jpeg", 800, 600, 3, 8, None), ("png", 6, 4, 1, 8, None)] + [(None,) * 6] * 3
    assert got == {hashlib.sha256(r).hexdigest(): w for r, w in zip(rows, want, strict=True)}


def test_images_hold_their_samples():
    for n in (1, 7):
        data = bytes(range(256)) * 9 * n
        width, height, own = png_samples(media.png(data, 576))
        assert (width, height, own) == (576, 4 * n, data) and media.samples(media.png(data, 576)) == data
    with pytest.raises(ValueError, match="checksum"):
        media.samples(media.png(b"\1" * 576, 576)[:-14] + b"\0" * 14)
