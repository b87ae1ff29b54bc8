"""Periodic run detection in the words of whole texts by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least
max(``least``, 2 * q) words that no neighbouring word extends keeping q. It has max(q, least - q) matches
or more at lag q, one after another, so only lags with as many matches anywhere can have one:

1. Matches are counted for every lag at once. Words that are frequent within a text count by the exact
   autocorrelation of their places (FFT, rounded to whole numbers), rare ones by the differences of their
   places; what counts as frequent is where the one costs as much as the other.
2. Lags with enough matches are scanned for islands of matches, ascending. A run of period q takes its
   matches off the counts of q's multiples, so these need scans only if matches elsewhere remain: two
   different runs share none at a multiple of either period. A scan probes every q / 8th place; eight
   matches in a row are an island's least sign, and what they point at is read word by word.

Each text is one row's work, in numpy, in tasks of a few hundred texts; nothing is shuffled.

Defined results: a null or empty text has no words and no run; repeated rows each get their result; other
columns are kept or ignored as stated; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean, prepare

#: Words of the shortest run.
LEAST = 12
#: Steps of a pair's difference for which a step of the FFT is had.
FFT_COST = 2.0


def word_codes(words: list[bytes]) -> np.ndarray:
    """Each word's first place."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def lag_counts(x: np.ndarray, most: int) -> np.ndarray:
    """Matches x[i] == x[i + q] for the lags 0 to ``most`` (that of lag 0 is left 0); x: 0 to len(x) - 1."""
    n = len(x)
    total = np.zeros(most + 1, np.int64)
    sizes = np.bincount(x, minlength=n)
    length = 1 << (2 * n - 1).bit_length()
    heavy = sizes > np.sqrt(FFT_COST * length * np.log2(length))
    if heavy.any():
        power = np.zeros(length // 2 + 1)
        for word in np.flatnonzero(heavy):
            power += np.abs(np.fft.rfft((x == word).astype(float), length)) ** 2
        total += np.rint(np.fft.irfft(power, length)[: most + 1]).astype(np.int64)
    own = sizes[x]
    places = np.flatnonzero((own > 1) & ~heavy[x])
    # frequent words first: those that have a step-th successor lead
    places = places[np.argsort((own[places].max(initial=0) - own[places]) * n + x[places], kind="stable")]
    word, own = x[places], own[places]
    step = 1
    while len(places := places[: np.searchsorted(-own, -step)]) > step:
        apart = (places[step:] - places[:-step])[word[step : len(places)] == word[: len(places) - step]]
        total += np.bincount(apart[apart <= most], minlength=most + 1)
        step += 1
    total[0] = 0
    return total


def islands(match: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of at least ``least`` true values that no neighbour extends."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], match, [False])).view(np.int8)))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def scan(x: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Islands [a, b) of at least ``least`` >= q matches at lag ``q``."""
    step = q // 8
    if step < 2:
        return islands(x[:-q] == x[q:], least)
    probes = x[: len(x) - q : step] == x[q::step]
    found: list[tuple[int, int]] = []
    for a, b in islands(probes, least // step):
        lo, hi = max(0, (a - 1) * step), min(len(x) - q, b * step + 1)
        found += [(lo + s, lo + e) for s, e in islands(x[lo:hi] == x[lo + q : hi + q], least)]
    return found


def runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(x)
    if n < least:
        return []
    most = n // 2
    counts = lag_counts(x, most)
    lags = np.arange(most + 1)
    need = np.maximum(lags, least - lags)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero((counts >= need) & (lags > 0)).tolist():
        if counts[q] < need[q]:
            continue
        for a, b in scan(x, q, int(need[q])):
            length = b - a + q
            if (a, length) in found:  # a multiple of the period that the same stretch has
                continue
            found[a, length] = q
            again = np.arange(2 * q, min(most + 1, length), q)
            counts[again] -= length - again
    return sorted((a, length, q) for (a, length), q in found.items())


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run contains after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def planted(words: list, doc_id: int | None) -> list:
    """The query's rule: a tenth of the documents, by a hash of their ids, get a repeated tail."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """(id, runs array<struct<start, length, period>>, collapsed text) per row of ``docs``; the id keeps its name.

    ``plant`` first repeats words of documents with integer ids, as ``planted`` says.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("text"))
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([own.schema[0], T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            every, texts = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_py().split()
                if plant:
                    words = planted(words, doc_id)
                found = runs(word_codes(words), least)
                every.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(every, kind), pa.array(texts, pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def summarise(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, the longest run (ties: first start, then period), digests."""
    best = F.expr("array_max(transform(runs, x -> struct(x.length as length, -x.start as back, -x.period as small)))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    period = -F.col("best.small")
    return detected.select(
        F.col(id_col).alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """``detect``, stored in the shared folder, then ``summarise``."""
    found = summarise(detect(docs, id_col, text_col, least, plant), id_col)
    return Scratch(docs.sparkSession, "periods").table(found, "runs")
