"""Stored tables: found by stem, saved as zstd Parquet, converted with a check of every row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def some(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches ``pattern``."""
    fs, where = _fs(spark, pattern)
    return bool(fs.globStatus(where))


def whole(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a file, or a folder whose writing was finished."""
    fs, where = _fs(spark, path)
    return fs.exists(where) and (fs.getFileStatus(where).isFile() or exists(spark, f"{path}/_SUCCESS"))


def find_table(spark: SparkSession, stem: str) -> str | None:
    """``stem``.parquet, or else ``stem``.csv, or None; half-written folders do not count."""
    return next((p for p in (f"{stem}.parquet", f"{stem}.csv") if whole(spark, p)), None)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced whole."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def load_table(spark: SparkSession, stem: str) -> DataFrame:
    path = find_table(spark, stem)
    if path is None:
        raise FileNotFoundError(f"neither {stem}.parquet nor {stem}.csv is there")
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def save_table(df: DataFrame, stem: str, *partition_by: str) -> str:
    """Writes ``stem``.parquet beside the table of that name, if there is one, and then takes its place.

    A run that fails leaves the old table; the two renames at the end are all that a reader can fall between.
    """
    spark, path, mark = df.sparkSession, f"{stem}.parquet", uuid.uuid4().hex
    fresh, old = f"{stem}.new-{mark}", f"{stem}.old-{mark}"
    fs, where = _fs(spark, path)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    out = df.write.option("compression", "zstd")
    try:
        (out.partitionBy(*partition_by) if partition_by else out).parquet(fresh)
    except Exception:
        fs.delete(at(fresh), True)
        raise
    if fs.exists(where):
        fs.rename(where, at(old))
    if not fs.rename(at(fresh), where):
        raise OSError(f"{fresh} could not be renamed to {path}")
    fs.delete(at(old), True)
    return path


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def convert(df: DataFrame, stem: str) -> DataFrame:
    """Stores ``df`` and fails unless what is read back equals it."""
    back = df.sparkSession.read.parquet(save_table(df, stem))
    if not same_rows(df, back):
        raise ValueError(f"{stem}.parquet differs from its source")
    return back


def convert_folder(spark: SparkSession, folder: str, delete: bool = False) -> list[str]:
    """Stores every CSV below ``folder`` that has no Parquet twin; the stems that were converted."""
    fs, where = _fs(spark, folder)
    found, done = fs.listFiles(where, True), []
    paths = []
    while found.hasNext():
        paths.append(found.next().getPath().toString())
    for path in sorted(p for p in paths if p.endswith(".csv")):
        stem = path.removesuffix(".csv")
        if not exists(spark, f"{stem}.parquet"):
            convert(spark.read.csv(path, header=True, inferSchema=True), stem)
            done.append(stem)
            if delete:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), False)
    return done


def save_predictions(scores: DataFrame, stem: str, y: str = "y_true") -> str:
    """A wide table of scores; a model without a score for every row is refused."""
    models = [c for c in scores.columns if c.startswith("score_")]
    short = scores.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in models]).first()
    if bad := [c for c in models if short[c]]:
        raise ValueError(f"scores are missing for some rows in {bad}")
    return save_table(scores.withColumn(y, F.col(y).cast("tinyint")), stem)


def load_predictions(spark: SparkSession, stem: str) -> tuple[DataFrame, list[str]]:
    df = load_table(spark, stem)
    return df, [c for c in df.columns if c.startswith("score_")]


def scores_long(df: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """A row per key and model."""
    return df.unpivot(keys, models, "model", "score").withColumn("model", F.expr("substr(model, 7)"))
