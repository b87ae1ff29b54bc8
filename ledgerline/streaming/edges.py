"""Edge and label tables of time windows over a stream of canonical transactions.

The state is a row for every (window, edge) or (window, node): sums, counts, and the latest time, of which an echo's weight
is a function once the window is closed. ``tx.ts`` must be a timestamp with time zone; rows later than ``late`` behind the
latest one seen are dropped if their window is closed. On closed windows the tables equal the batch ones of a grid
that begins at ``start``.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MICROS, decay, micros
from ..operators.snapshots import Grid
from ..shared import shared_folder


def _micros(span: str | int) -> int:
    return span if isinstance(span, int) else pd.Timedelta(span) // pd.Timedelta(microseconds=1)


def _windowed(tx: DataFrame, step: str | int, width: str | int, late: str, start: str | int) -> tuple[DataFrame, Column]:
    """``tx`` with a watermark, of windows narrower than their step only the rows in them; the window."""
    every, wide, first = _micros(step), _micros(width), _micros(start)
    own = tx.withWatermark("ts", late)
    if wide < every:  # a window of a whole step, of which the last part counts
        own = own.filter(F.pmod(F.unix_micros("ts") - F.lit(first), F.lit(every)) >= every - wide)
    spans = (f"{max(wide, every)} microseconds", f"{every} microseconds", f"{(first - max(wide, every)) % every} microseconds")  # windows end on the grid
    return own, F.window("ts", *spans).alias("w")


def _bounds(width: str | int) -> list[Column]:
    end = F.col("w.end")
    return [F.timestamp_micros(F.unix_micros(end) - F.lit(_micros(width))).alias("start_ts"), end.alias("end_ts")]


def streaming_edges(tx: DataFrame, step: str | int = "1 day", width: str | int = "1 day", late: str = "1 day", start: str | int = "0 seconds", echo_days: float | None = None) -> DataFrame:
    """(start_ts, end_ts, src, dst, weight, amount_trans, num_trans) of each closed window, for append mode.

    Spans are texts or microseconds. With ``echo_days`` windows are that wide and an edge's weight is its latest
    transaction's decay; else it is 1.
    """
    if echo_days is not None:
        width = int(echo_days * MICROS["days"])
    own, window = _windowed(tx.filter("src is not null and dst is not null"), step, width, late, start)
    sums = own.groupBy(window, "src", "dst").agg(F.max("ts").alias("last"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount_trans"), F.count("amount").alias("num_trans"))
    weight = F.lit(1.0) if echo_days is None else decay(F.unix_micros(F.col("w.end")) - F.unix_micros("last"), echo_days)
    return sums.select(*_bounds(width), "src", "dst", weight.alias("weight"), "amount_trans", "num_trans")


def streaming_labels(tx: DataFrame, step: str | int = "1 day", width: str | int = "1 day", late: str = "1 day", start: str | int = "0 seconds") -> DataFrame:
    """(start_ts, end_ts, node, label) of each closed window: 1 for a node with any positive transaction in or out."""
    own, window = _windowed(tx, step, width, late, start)
    ends = own.select("ts", F.explode(F.array("src", "dst")).alias("node"), F.col("label").cast("int").alias("label")).filter("node is not null")
    return ends.groupBy(window, "node").agg(F.max("label").alias("label")).select(*_bounds(width), "node", "label")


def replayed(tx: DataFrame, grid: Grid, build, parts: int = 3) -> DataFrame:
    """A stored table of transactions (ts without zone) passed through a stream; ``build(stream)`` is one of the tables above.

    The table arrives in ``parts`` of equal time; the stream is taken up again from its stored state for each.
    snapshot_id is that of ``grid``.
    """
    spark, root = tx.sparkSession, f"{shared_folder(tx.sparkSession)}/stream-{uuid.uuid4().hex}"
    own = tx.withColumn("ts", F.timestamp_micros(micros("ts")))
    part = F.greatest(F.lit(0), F.least(F.floor((F.unix_micros("ts") - F.lit(grid.first)) * F.lit(parts) / F.lit(max(1, grid.last - grid.first))), F.lit(parts - 1)))
    for i in range(parts):
        own.filter(part == i).write.mode("append").parquet(f"{root}/in")
        out = build(spark.readStream.schema(own.schema).parquet(f"{root}/in"))
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    ended = ((F.unix_micros("end_ts") - F.lit(grid.first)) / F.lit(grid.step)).cast("long") - 1
    return spark.read.schema(out.schema).parquet(f"{root}/out").withColumn("snapshot_id", ended.cast("int"))
