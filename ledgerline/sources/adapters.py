"""Canonical transactions from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MICROS, micros


def transfers(events: DataFrame) -> DataFrame:
    """Each event passes its value to the user of the next event of its type.

    Types are few and may be large, so they are cut by the hour: an event's successor is the next of its hour or, for
    the hour's last, the first of the next hour that has any. Only the hours' first events are ordered by type.
    """
    own = events.select("event_type", F.floor(micros("ts") / F.lit(MICROS["hours"])).alias("hour"), "ts", "event_id", "user_id", "value")
    later = Window.partitionBy("event_type").orderBy("hour")
    firsts = own.groupBy("event_type", "hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    onward = firsts.select(F.col("event_type").alias("t"), F.col("hour").alias("h"), F.lead("first").over(later).alias("onward"))
    within = Window.partitionBy("event_type", "hour").orderBy("ts", "event_id")
    near = own.select("*", F.struct(F.lead("user_id").over(within).alias("user"), F.lead(F.lit(1)).over(within).alias("is")).alias("near"))
    both = near.join(onward, F.col("event_type").eqNullSafe(F.col("t")) & F.col("hour").eqNullSafe(F.col("h")), "left")
    dst = F.when(F.col("near.is").isNotNull(), F.col("near.user")).otherwise(F.col("onward"))
    paid = both.select(F.col("user_id").alias("src"), dst.alias("dst"), "ts", F.col("value").alias("amount"), (F.col("value") > 200).alias("label"))
    return paid.filter("dst is not null and src <> dst")


def trade(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers pay suppliers for order lines."""
    lines = lineitem.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), (F.col("l_returnflag") == "R").alias("label"))
    own = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.col("o_orderdate").alias("ts"), "amount", "label")


def scores(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, y, score) with ties: toxic documents against a coarse function of their length."""
    own = labels.join(documents.select("doc_id", "n_chars"), "doc_id")
    return own.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"), ((F.pmod(F.col("n_chars"), F.lit(17)) + 3 * F.col("toxic") + F.col("quality")) / F.lit(20.0)).alias("score"))
