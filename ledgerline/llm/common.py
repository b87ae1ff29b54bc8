"""What the corpus operators share: scratch tables in the shared folder, free column names."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..ship import ship as prepare  # noqa: F401

#: Rows handed to a Python worker at once; texts may be long, so this is far below Spark's default.
ARROW_ROWS = 256
#: Powers of two of the bits of the bitmap that tells which texts a join may need: BITS_A_KEY for each key,
#: within these bounds. Beyond 2**28 / 8 keys more and more rows are joined that need not be; none is lost.
FILTER_BITS, BITS_A_KEY = (20, 28), 8
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Bounds what a Python worker holds at once in the jobs that run inside; the session's setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Caches of the workers that tasks fill and leave empty.
CACHES: list[dict] = []


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of batches after which the worker, which goes on to other tasks, gives back what it held."""

    @functools.wraps(run)
    def whole(*args, **kwargs):
        try:
            yield from run(*args, **kwargs)
        finally:
            for cache in CACHES:
                cache.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return whole


class Scratch:
    """Tables of one operator call, written to the shared folder so that lost executors cost nothing.

    ``table`` writes a frame and reads it back; ``free`` deletes tables that no later step reads. What
    stays behind returned frames goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        where, files = self._at(self.root)
        files.mkdirs(where)
        files.deleteOnExit(where)

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows: int = ARROW_ROWS) -> DataFrame:
        with batches(self.spark, rows):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        for name in names:
            where, files = self._at(self.path(name))
            files.delete(where, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def maybe(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` and a column ``name``: false where ``key`` is surely not in ``keys`` (key), a stored table.

    ``keys`` become a bitmap of 2**FILTER_BITS bits at most, broadcast in words of 64.
    """
    own, at, mask = (free_name(df, f"__{x}") for x in ("key", "word", "mask"))
    bits = min(max((BITS_A_KEY * keys.count() - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    word = lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))
    bit = keys.select(word(F.col("key")).alias(at), F.expr("shiftleft(1L, cast(key & 63L as int))").alias("bit"))
    words = bit.groupBy(at).agg(F.bit_or("bit").alias(mask))
    marked = df.withColumn(own, key)
    joined = marked.join(F.broadcast(words), word(F.col(own)) == F.col(at), "left")
    hit = F.expr(f"(`{mask}` & shiftleft(1L, cast(`{own}` & 63L as int))) <> 0L")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(own, at, mask)


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and xxhash64 of the text are in ``gone`` (id, key), a stored table."""
    own, text, flag = (free_name(docs, f"__{x}") for x in ("own", "text", "gone"))
    key = F.xxhash64(F.col(text_col))
    flagged = maybe(docs, key, gone.select("key"), flag)
    unsure, gone = flagged.filter(flag).drop(flag), gone.select(F.col("id").alias(own), F.col("key").alias(text))
    kept = unsure.join(gone, F.col(id_col).eqNullSafe(F.col(own)) & (key == F.col(text)), "left_anti")
    return flagged.filter(~F.col(flag)).drop(flag).unionByName(kept)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
