"""Row store of snapshots, K-step windows with gaps, temporal bands, train-only scaling.

Windows hold row ids, so the 90 columns are read once per (node, snapshot) and joined late.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import scrub
from ..schema import FEATURES, missing_features
from .graph import KEY
from .pin import Pins, pinned

VERSION = 1


def label_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with the label of (snapshot_id, node); a missing label is 0."""
    return features.join(labels.select(KEY, "node", "label"), [KEY, "node"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def static_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the nodes that have a label, with it; a static table has no snapshots."""
    return features.join(labels.select("node", "label"), "node")


def node_codes(df: DataFrame, column: str = "node") -> DataFrame:
    """(node, node_code): codes 0.. in the order of the nodes.

    Ranges of nodes are numbered on their own and shifted by the rows before them, so no single task
    sees all nodes.
    """
    ranged = pinned(df.select(column).distinct().repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    return numbered(ranged, "__part", [column]).select(column, F.col("__n").cast("int").alias("node_code"))


def numbered(df: DataFrame, part: str, order: list) -> DataFrame:
    """Adds __n, dense numbers from 0 by (part, order); parts are few and counted first."""
    counts = df.groupBy(part).agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    own = df.withColumn("__i", F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return own.join(F.broadcast(before), part).withColumn("__n", F.col("__before") + F.col("__i")).drop("__before", "__i")


def store_rows(labelled: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_id, snapshot_id, node, label, f): ids dense in order of snapshot and node, features as floats."""
    columns = FEATURES if columns is None else columns
    f = F.array(*[scrub(F.col(c).cast("float")) for c in columns])
    own = labelled.select(KEY, F.col("node").cast("string").alias("node"), F.col("label").cast("float").alias("label"), f.alias("f"))
    pins = Pins(own.sparkSession, "rows")
    own = pins.put(own)  # the bounds of the ranges need a pass of their own
    ranged = own.repartitionByRange(KEY, "node").sortWithinPartitions(KEY, "node")  # a snapshot is several tasks
    id_ = F.monotonically_increasing_id()  # the part and the place in it
    ranged = pins.put(ranged.withColumn("__id", id_).withColumn("__part", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))
    pins.drop(own)
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = ranged.groupBy("__part").agg(F.count("*").alias("__c")).select("__part", F.coalesce(F.sum("__c").over(above), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__i")).alias("row_id"), KEY, "node", "label", "f")


def offsets(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, n_rows, offset) for every snapshot of the grid, empty ones too."""
    counts = snapshots.select(KEY).join(rows.groupBy(KEY).agg(F.count("*").alias("n_rows")), KEY, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return counts.withColumn("offset", F.coalesce(F.sum("n_rows").over(Window.orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def write_store(rows: DataFrame, folder: str, snapshots: int) -> None:
    """Rows by snapshot, then the description: a store without one does not exist."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(KEY).parquet(f"{folder}/rows")
    node_codes(rows).write.mode("overwrite").parquet(f"{folder}/nodes")
    meta = {"version": VERSION, "columns": FEATURES, "snapshots": snapshots}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def read_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    from ..sources.tables import exists

    if not all(exists(spark, f"{folder}/{p}/_SUCCESS") for p in ("rows", "nodes", "meta")):
        raise FileNotFoundError(f"no complete store in {folder}")
    meta = json.loads(spark.read.text(f"{folder}/meta").first().value)
    if meta["version"] != VERSION or missing_features(meta["columns"]):
        raise ValueError(f"the store in {folder} has another version or schema")
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/nodes"), meta


def windows(rows: DataFrame, k: int, task: str = "nowcast", snapshots: int | None = None) -> DataFrame:
    """(anchor, node, y, idx): row ids of K steps, -1 where the node is absent.

    nowcast: the steps end at the anchor; forecast: just before it. One range frame finds all steps.
    """
    if task not in ("nowcast", "forecast"):
        raise ValueError(f"unknown task {task!r}: use nowcast or forecast")
    if snapshots is not None and snapshots < (k if task == "nowcast" else k + 1):
        raise ValueError(f"{snapshots} snapshots are too few for {k} steps")
    base, frame = (k - 1, (-(k - 1), 0)) if task == "nowcast" else (k, (-k, -1))
    span = Window.partitionBy("node").orderBy(KEY).rangeBetween(*frame)
    seen = rows.select(KEY, "node", "label", F.map_from_entries(F.collect_list(F.struct(KEY, "row_id")).over(span)).alias("h")).filter(F.col(KEY) >= base)
    slot = lambda s: F.coalesce(F.try_element_at("h", (F.col(KEY) - base + s).cast("int")), F.lit(-1).cast("long"))
    return seen.select(F.col(KEY).alias("anchor"), "node", F.col("label").alias("y"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), slot).alias("idx"))


def mask(idx: Column) -> Column:
    return F.transform(idx, lambda i: i >= 0)


def last_valid_step(m: Column) -> Column:
    """The last true step, 0 if there is none."""
    return F.coalesce(F.array_max(F.filter(F.transform(m, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())), F.lit(0))


def with_history(df: DataFrame) -> DataFrame:
    """Windows with any step present."""
    return df.filter(F.exists("idx", lambda i: i >= 0))


def dense(df: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Adds x, the K feature rows with zeros where absent, and mask. Steps are joined by row id."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    steps = df.select("anchor", "node", "y", F.posexplode("idx").alias("step", "row_id"))
    joined = steps.join(rows.select("row_id", "f"), "row_id", "left")
    packed = joined.groupBy("anchor", "node").agg(F.first("y").alias("y"), F.sort_array(F.collect_list(F.struct("step", F.coalesce("f", zeros).alias("f"), (F.col("row_id") >= 0).alias("m")))).alias("s"))
    return packed.select("anchor", "node", "y", F.col("s.f").alias("x"), F.col("s.m").alias("mask"))


def last_steps(rows: DataFrame, k: int) -> DataFrame:
    """(anchor, node, y, v): ``flatten`` of a nowcast's dense windows of ``k`` steps. They end at the anchor, so v is its own row, and no steps are gathered."""
    return rows.filter(F.col(KEY) >= k - 1).select(F.col(KEY).alias("anchor"), "node", F.col("label").alias("y"), F.col("f").alias("v"))


def flatten(df: DataFrame, task: str = "forecast", local: bool = False) -> DataFrame:
    """(anchor, node, y, v): the last step of a nowcast, all steps of a forecast, or its last if ``local``."""
    if local and task == "nowcast":
        raise ValueError("local features are a forecast's")
    v = F.element_at("x", -1) if task == "nowcast" or local else F.flatten("x")
    return df.select("anchor", "node", "y", v.alias("v"))


def bands(df: DataFrame, n_val: int, n_test: int) -> DataFrame:
    """Adds band: the last ``n_test`` anchors are test, the ``n_val`` before them val, the rest train.

    Too few anchors, or no positive in val or test, is an error, raised here.
    """
    if n_test < 1 or n_val < 0:
        raise ValueError("there must be at least one test anchor")
    counts = {r.anchor: r.p for r in df.groupBy("anchor").agg(F.sum("y").alias("p")).collect()}  # one number a snapshot
    order = sorted(counts)
    if len(order) < n_test + n_val + 1:
        raise ValueError(f"{len(order)} anchors are too few for {n_val} and {n_test}")
    test, val = order[-n_test:], order[len(order) - n_test - n_val : len(order) - n_test]
    for name, own in (("val", val), ("test", test)):
        if own and not any(counts[a] for a in own):
            raise ValueError(f"no positive in the {name} band")
    cut = lambda a: F.lit(a)
    band = F.when(F.col("anchor") >= cut(test[0]), "test")
    if val:
        band = band.when(F.col("anchor") >= cut(val[0]), "val")
    return df.withColumn("band", band.otherwise("train"))


def scaler(df: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(feature, mean, std): over each stored row that windows refer to once; population std, at least 1e-8."""
    used = df.select(F.explode("idx").alias("row_id")).filter("row_id >= 0").distinct()
    own = rows.select("row_id", "f").join(used, "row_id", "left_semi")
    stats = own.agg(*[x for i in range(width) for x in (F.avg(F.col("f")[i].cast("double")).alias(f"m{i}"), F.stddev_pop(F.col("f")[i].cast("double")).alias(f"s{i}"))])
    each = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"m{i}").alias("mean"), F.greatest(F.col(f"s{i}"), F.lit(1e-8)).alias("std")) for i in range(width)])
    return stats.select(F.inline(each))


def scale(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` with standardised f; the scaler is one small row."""
    packed = fitted.agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "std"))).alias("s"))
    joined = rows.crossJoin(F.broadcast(packed))  # one row of at most 90 numbers
    return joined.withColumn("f", F.transform(F.arrays_zip("f", "s"), lambda p: ((p["f"].cast("double") - p["s"]["mean"]) / p["s"]["std"]).cast("float"))).drop("s")


def log_degree_scaler(degrees: DataFrame) -> DataFrame:
    """(mean, std) of log_degree over the train band's nodes; sample std, at least 1e-8."""
    return degrees.agg(F.avg("log_degree").alias("mean"), F.greatest(F.stddev_samp("log_degree"), F.lit(1e-8)).alias("std"))


def class_ratio(df: DataFrame, *keys: str) -> DataFrame:
    """negatives / max(1, positives), by ``keys``."""
    own = (df.groupBy(*keys) if keys else df).agg(F.count_if(F.col("y") > 0).alias("positives"), F.count_if(F.col("y") <= 0).alias("negatives"))
    return own.withColumn("ratio", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))


def hash_split(df: DataFrame, key: str, shares: dict[str, float], stratum: str | None = None, seed: int = 7) -> DataFrame:
    """Adds split: exact shares by the rank of a hash, within each stratum if given."""
    groups = [stratum] if stratum else []
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), key))
    ranged = pinned(hashed.repartitionByRange(*groups, "__h", key).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(*groups).agg(F.count("*").alias("__all")) if groups else ranged.agg(F.count("*").alias("__all"))
    above = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)  # a row a stratum
    sizes = sizes.withColumn("__from", F.coalesce(F.sum("__all").over(above), F.lit(0)) if groups else F.lit(0))
    ranked = numbered(ranged, "__part", [*groups, "__h", key])
    if groups:
        ranked = ranked.join(F.broadcast(sizes.withColumnRenamed(stratum, "__g")), F.col(stratum).eqNullSafe(F.col("__g"))).drop("__g")
    else:
        ranked = ranked.crossJoin(F.broadcast(sizes))  # one row
    ranked = ranked.withColumn("__r", F.col("__n") - F.col("__from") + 1)
    split, upto, names = None, 0.0, list(shares)
    for name in names[:-1]:
        upto += shares[name]
        hit = F.col("__r") <= F.round(F.col("__all") * upto)
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return ranked.withColumn("split", split.otherwise(names[-1])).select(*df.columns, "split")




def encode(df: DataFrame, codes: DataFrame, column: str = "node") -> DataFrame:
    """Adds node_code; a node without a code fails the query and is named."""
    own = df.join(codes.withColumnRenamed("node", column) if column != "node" else codes, column, "left")
    stop = F.raise_error(F.concat(F.lit("unknown node: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int")
    return own.withColumn("node_code", F.coalesce("node_code", stop))


def appearance_codes(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, code): codes 0.. in the order in which values first appear."""
    first = df.groupBy(column).agg(F.min(F.struct(*order)).alias("__first"))
    ranged = pinned(first.repartitionByRange("__first").withColumn("__part", F.spark_partition_id()))
    return numbered(ranged, "__part", ["__first"]).select(column, F.col("__n").cast("int").alias("code"))


def labels_in_order(order: DataFrame, labels: DataFrame, position: str = "position") -> DataFrame:
    """Labels of the nodes of ``order`` (position, node), sorted by position; null where there is none."""
    return order.join(labels, "node", "left").orderBy(position)


def channel_stats(df: DataFrame, column: str, channels: int, size: int = 9) -> DataFrame:
    """(channel, mean, std) over all values of each run of ``size`` of a flat vector; sample std."""
    own = df.select(F.posexplode(F.slice(column, 1, channels * size)).alias("at", "v"))
    return own.groupBy(F.floor(F.col("at") / size).cast("int").alias("channel")).agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("std"))


def rounded_class_ratio(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row: negatives over positives, rounded half to even, times ``scale``."""
    return class_ratio(df).select((F.bround(F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))) * F.lit(float(scale))).alias("weight"))


def cached(spark: SparkSession, folder: str, key: tuple, build) -> DataFrame:
    """The table kept in ``folder`` under ``key``, such as (tag, snapshots, K, task); built on first use."""
    from ..sources.tables import exists

    path = f"{folder}/" + "_".join(map(str, key))
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
