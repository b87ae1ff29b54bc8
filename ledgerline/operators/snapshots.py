"""Time snapshots: a grid of half-open windows, and transactions assigned to every window they lie in.

A transaction finds its windows by arithmetic on its offset from the first one, so assignment is a
projection and an explode, never a range join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MICROS, decay, micros, span


@dataclass(frozen=True)
class Grid:
    """``count`` windows that end every ``step`` after ``first``; all in microseconds since 1970."""

    first: int
    last: int
    step: int
    width: int

    @property
    def count(self) -> int:
        return max(0, (self.last - self.first) // self.step)

    def frame(self, spark) -> DataFrame:
        """(snapshot_id, start_ts, end_ts)."""
        moment = lambda c: F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c / F.lit(1_000_000)).cast("decimal(18,6)"))
        end = F.lit(self.first) + (F.col("id") + 1) * F.lit(self.step)
        return spark.range(self.count).select(F.col("id").cast("int").alias("snapshot_id"), moment(end - F.lit(self.width)).alias("start_ts"), moment(end).alias("end_ts"))


def make_grid(tx: DataFrame, step: float, step_unit: str = "days", width: float | None = None, width_unit: str | None = None) -> Grid:
    """The grid over ``tx``, anchored at its first moment; one aggregate of two numbers is read."""
    ends = tx.agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("z")).first()
    every = span(step, step_unit)
    wide = every if width is None else span(width, width_unit or step_unit)
    return Grid(ends.a or 0, ends.z or 0, every, wide)


def assign(tx: DataFrame, grid: Grid) -> DataFrame:
    """``tx`` with snapshot_id, a row for every window that holds the transaction; offset: µs from the first."""
    offset = micros("ts") - F.lit(grid.first)
    low = F.floor(F.col("offset") / F.lit(grid.step)).cast("long")
    high = F.least(F.floor((F.col("offset") + F.lit(grid.width)) / F.lit(grid.step)).cast("long") - 1, F.lit(grid.count - 1))
    placed = tx.withColumn("offset", offset).withColumn("low", low).withColumn("high", high).filter("low <= high")
    return placed.withColumn("snapshot_id", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int")))).drop("low", "high")


def snapshot_edges(tx: DataFrame, grid: Grid, echo_days: float | None = None) -> DataFrame:
    """Edges of every snapshot: summed amount, number of amounts, weight.

    With ``echo_days`` the windows are that wide and an edge's weight is its latest transaction's decay.
    """
    if echo_days is not None:
        grid = Grid(grid.first, grid.last, grid.step, int(echo_days * MICROS["days"]))
    placed = assign(tx.filter("src is not null and dst is not null"), grid)
    weight = F.lit(1.0)
    if echo_days is not None:
        lag = (F.col("snapshot_id").cast("long") + 1) * F.lit(grid.step) - F.col("offset")
        weight = decay(lag, echo_days)
    return (
        placed.withColumn("weight", weight)
        .groupBy("snapshot_id", "src", "dst")
        .agg(F.max("weight").alias("weight"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount_trans"), F.count("amount").alias("num_trans"))
    )


def node_labels(placed: DataFrame, *keys: str) -> DataFrame:
    """1 for a node with any positive transaction in or out, else 0, by ``keys`` (such as snapshot_id)."""
    ends = placed.select(*keys, F.explode(F.array("src", "dst")).alias("node"), F.col("label").cast("int").alias("label"))
    return ends.filter("node is not null").groupBy(*keys, "node").agg(F.max("label").alias("label"))


def static_edges(tx: DataFrame) -> DataFrame:
    """Edges of all transactions; weight 1."""
    own = tx.filter("src is not null and dst is not null").groupBy("src", "dst")
    return own.agg(F.lit(1.0).alias("weight"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount_trans"), F.count("amount").alias("num_trans"))


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """The windows whose snapshot_id is not stored yet; ids keep their meaning."""
    return grid.join(done.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def positives_per_window(placed: DataFrame) -> DataFrame:
    """Distinct accounts with a positive transaction by snapshot."""
    return node_labels(placed, "snapshot_id").filter("label = 1").groupBy("snapshot_id").agg(F.count("*").alias("positives"))
