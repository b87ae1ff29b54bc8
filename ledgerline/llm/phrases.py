"""Phrase collocation mining by count-min sketches and an exact second pass.

Texts (A-Z in lower case) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
``[^\\x20\\x09]+``; all counts are by language. A phrase of 2 to ``longest`` words that occurs at least
``least`` times is a candidate.

1. Tasks count hashed n-grams into count-min sketches, one a length, of two rows each; only cells that
   a task met travel, cut into blocks, and a block's counts are merged in one task, each capped at
   ``least``, beyond which they do not matter. What the driver gets and broadcasts is a bit a cell. Words and pairs are
   sketched first, then longer n-grams whose pairs may all be frequent. Sketches only overestimate, so
   no frequent n-gram is lost.
2. The second pass counts the survivors exactly, by their words: in the task, then by blocks of phrases, which travel
   as arrays; a task adds up a few blocks at a time.
3. Every cut of a candidate into two parts is scored, floor(1000 * a * n / (l * r)), in decimals that
   cannot overflow; the lowest counts. A candidate inside a longer one that occurs ``share`` percent as
   often goes: by monotony of counts only those longer by one word need to be looked at.
4. Ranks are settled among the best of many small groups of phrases first, so that a language that has most
   of the candidates is not one sort.

A sketch has a cell for every LOAD words, up to 2**CELL_BITS; beyond that more survive, and are counted and
dropped by the second pass: the result stays exact.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each; equal scores
go by count, then by the phrase's bytes; ties between cuts go to the shortest first part; an empty table
gives an empty result; ids and other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, partitions, prepare, text_or_empty
from .shingles import mix

U = np.uint64
#: Occurrences that make a candidate, words of the longest phrase, rows of a language's report, and the
#: percentage of a phrase's count at which a longer one subsumes it.
LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Words a cell of a sketch, bounds of its cells as powers of two, rows of a sketch, blocks of a row.
LOAD, CELL_BITS, ROWS, BLOCKS = 16, (16, 27), 2, 64
#: Languages whose word counts are broadcast, at most.
LANGUAGES = 1 << 16
#: Groups of a language's phrases whose best are found first.
GROUPS = 64
#: Survivors whose counts a task keeps before it hands them on, and blocks that they are handed on in.
HELD, PACKS = 300_000, 1024
COUNTED = ["lang", "size", "phrase", "f"]
#: Bytes of text that a task counts at a time; longer texts are cut between pieces.
FLUSH = 6 << 20
UNKNOWN = "und"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"\n" * 9 + b" ")


class _Codes(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) - 2
        return value


def coded(chunks: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of plain chunks, with -1 between pieces, and the words."""
    code = _Codes({b"": -2, b"\n": -1})
    found = b"\n".join(chunks).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(code.__getitem__, found), np.int64, len(found))
    return ids[ids != -2], list(code)[2:]


def pieces(text: str) -> Iterator[bytes]:
    """A text in lower case, with every separator a line end, whole or in parts that end between pieces."""
    plain = text.encode().translate(_PLAIN)
    while len(plain) > FLUSH and (cut := plain.find(b"\n", FLUSH)) >= 0:
        yield plain[:cut]
        plain = plain[cut + 1 :]
    yield plain


def buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, word numbers, words) of what a task reads, in portions of about FLUSH bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def drain() -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        for lang in list(held):
            yield lang, *coded(held.pop(lang))

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for part in pieces(text.as_py()):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= FLUSH:
                    yield from drain()
                    size = 0
    yield from drain()


class Sieve:
    """The bits of merged sketches: by length, an array (row, cells / 8)."""

    def __init__(self, cells: int):
        self.cells, self.block, self.bits = cells, cells // BLOCKS, {}

    def cell(self, h: np.ndarray, row: int) -> np.ndarray:
        return ((h >> U(32 * row)) & U(self.cells - 1)).astype(np.uint32)

    def passes(self, size: int, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in range(ROWS):
            at = self.cell(h, row)
            out &= (self.bits[size][row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def levels(lang: str, ids: np.ndarray, words: list[bytes], sieve: Sieve, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, where n-grams begin whose parts and, if sketched, which themselves may be frequent, hashes)."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    at = own[ids] if len(own) else np.zeros(len(ids), U)  # what stands between pieces is masked below
    ok, h = ids >= 0, mix(at + U(xxhash.xxh3_64_intdigest(lang.encode())))
    for size in range(1, longest + 1):
        if size > 1:
            ok, h = ok[:-1] & ok[1:], mix(h[:-1] + at[size - 1 :])
        if size in sieve.bits:
            where = np.flatnonzero(ok)
            ok = np.zeros(len(ok), bool)
            ok[where[sieve.passes(size, h[where])]] = True
        yield size, ok, h


def _counted(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell.sort()
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    return cell[first], np.diff(np.append(first, len(cell)))


def _steps(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cells as steps of 16 bits from -1, with stops of no count where a gap is wider."""
    gap = np.diff(cell.astype(np.int64), prepend=-1)
    stops = (gap - 1) // 65535
    out = np.full(len(cell) + int(stops.sum()), 65535, np.uint16)
    counts = np.zeros(len(out), n.dtype)
    at = np.cumsum(stops + 1) - 1
    out[at], counts[at] = gap - 65535 * stops, n
    return out, counts


def _sketch(sieve: Sieve, sizes: tuple[int, ...], least: int):
    """(language, text) -> (block, steps, counts): the cells of the n-grams of ``sizes``, counts capped at ``least``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in buffered(batches):
            out: list[tuple[int, bytes, bytes]] = []
            for size, ok, h in levels(lang, ids, words, sieve, sizes[-1]):
                for row in range(ROWS) if size in sizes else ():
                    cell, n = _counted(sieve.cell(h[ok], row))
                    n = np.minimum(n, least).astype(np.uint32 if least > 255 else np.uint8)
                    block = cell // sieve.block
                    ends = np.flatnonzero(np.diff(block)) + 1
                    for a, b in zip(np.append(0, ends), np.append(ends, len(cell)), strict=True) if len(cell) else ():
                        steps, counts = _steps(cell[a:b] % sieve.block, n[a:b])
                        out.append(((size * ROWS + row) * BLOCKS + int(block[a]), steps.tobytes(), counts.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["block", "steps", "counts"])

    return run


def _merge(size: int, least: int):
    """Sums the counts of each block; (block, bits) of those with a cell that reaches ``least``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, steps, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = held.setdefault(block, np.zeros(size, np.uint32 if least > 255 else np.uint16))
                at = np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.int64) - 1
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint32 if least > 255 else np.uint8), least)
        for block, total in held.items():
            if (full := total >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return run


def add_sketches(rows: DataFrame, sieve: Sieve, sizes: tuple[int, ...], least: int) -> None:
    """Sketches the n-grams of ``sizes`` of ``rows`` (lang, text) and puts the merged bits into ``sieve``."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(sieve)  # 2 * 2**CELL_BITS[1] bits a length at most
    met = rows.mapInArrow(lambda b: _sketch(known.value, sizes, least)(b), "block long, steps binary, counts binary")
    merged = met.repartition(partitions(spark), "block").mapInArrow(_merge(sieve.block, least), "block long, bits binary")
    bits = {size: np.zeros((ROWS, sieve.cells // 8), np.uint8) for size in sizes}
    for r in merged.toLocalIterator():
        key, at = r.block // BLOCKS, r.block % BLOCKS * sieve.block // 8
        bits[key // ROWS][key % ROWS, at : at + sieve.block // 8] = np.frombuffer(r.bits, np.uint8)
    sieve.bits |= bits
    known.unpersist()


def _survivors(sieve: Sieve, longest: int):
    """(language, text) -> (block, lang, size, phrase, f): a task's counts of survivors, and of all words of a language as size 0.

    A row holds those of a block of phrases, in arrays.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def drain() -> pa.RecordBatch:
            langs, sizes, phrases = zip(*held, strict=True)
            block = np.fromiter((zlib.crc32(f"{lang} {phrase}".encode()) % PACKS for lang, phrase in zip(langs, phrases, strict=True)), np.int32, len(langs))
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            columns = [pa.array(langs), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(block[order][first]), *[pa.ListArray.from_arrays(ends, c.take(pa.array(order))) for c in columns]], names=["block", *COUNTED])

        for lang, ids, words in buffered(batches):
            held[lang, 0, ""] += int((ids >= 0).sum())
            text = [w.decode() for w in words]
            gram = ids
            for size, ok, _ in levels(lang, ids, words, sieve, longest):
                where = np.flatnonzero(ok)
                # a prefix's number and the last word's make a number of their own: exact, without hashes
                key = ids[where] if size == 1 else gram[where] * max(1, len(words)) + ids[where + size - 1]
                _, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                gram = np.zeros(len(ok), np.int64)
                gram[where] = same
                for p, k in zip(where[first].tolist(), n.tolist(), strict=True):
                    held[lang, size, " ".join([text[i] for i in ids[p : p + size]])] += k
            if len(held) >= HELD:
                yield drain()
        if held:
            yield drain()

    return run


def _settled(least: int):
    """Blocks of counts in order of the block -> (lang, size, phrase, f) that reach ``least``, and size 0."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def drain() -> Iterator[pa.RecordBatch]:
            sums = pa.concat_tables(held).group_by(COUNTED[:3]).aggregate([("f", "sum")]).rename_columns(COUNTED)
            held.clear()
            yield from sums.filter(pc.or_(pc.greater_equal(sums["f"], least), pc.equal(sums["size"], 0))).to_batches()

        last = None
        for b in batches:
            block = b.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for a, z in zip(starts, np.append(starts[1:], len(block)), strict=True):
                if block[a] != last and sum(t.num_rows for t in held) >= HELD:
                    yield from drain()
                last = block[a]
                held.append(pa.Table.from_arrays([c.slice(a, z - a).flatten() for c in b.columns[1:]], names=COUNTED))
        if held:
            yield from drain()

    return run


def frequent(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", load: int = LOAD) -> DataFrame:
    """(lang, size, phrase, f): all n-grams of 1 to ``longest`` words that occur ``least`` times, exactly counted; size 0: all words."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sieve = Sieve(1 << min(max((size // 6 // load).bit_length(), CELL_BITS[0]), CELL_BITS[1]))
    for sizes in ((1, 2), tuple(range(3, longest + 1))):
        if sizes and sizes[0] <= longest:
            add_sketches(rows, sieve, sizes, least)
    known = docs.sparkSession.sparkContext.broadcast(sieve)
    found = rows.mapInArrow(lambda b: _survivors(known.value, longest)(b), "block int, lang array<string>, size array<int>, phrase array<string>, f array<long>")
    found = found.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block")
    return scratch.table(found.mapInArrow(_settled(least), "lang string, size int, phrase string, f long"), "frequent")


def _part(first: str, length: str) -> str:
    return f"array_join(slice(words, {first}, {length}), ' ')"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang", load: int = LOAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    scratch = Scratch(docs.sparkSession, "phrases")
    counts = frequent(docs, scratch, least, longest, text_col, lang_col, load)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    words = F.broadcast(words) if words.count() <= LANGUAGES else words
    phrases = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    longer = phrases.filter("size > 2").selectExpr("lang", f"explode(array({_part('1', 'size - 1')}, {_part('2', 'size - 1')})) as phrase", "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).selectExpr("lang", "phrase", "a", "k", f"{_part('1', 'k')} as head", f"{_part('k + 1', 'size - k')} as tail")
    cuts = scratch.table(cuts, "cuts")
    for side, name in (("head", "l"), ("tail", "r")):
        part = counts.filter("size > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    wide = lambda c: f"cast({c} as decimal(17, 0))"
    cuts = cuts.join(words, "lang").withColumn("score", F.expr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    scored = scratch.table(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
