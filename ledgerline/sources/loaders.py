"""Raw transaction files to canonical transactions (src, dst, ts, amount, label)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fx
from ..functions.scalars import label, number
from .tables import exists

# File columns, and the last moments that are kept.
BANK_CSV = "`Timestamp` string, `From Bank` string, `Account` string, `To Bank` string, `Account.1` string, `Amount Received` string, `Receiving Currency` string, `Amount Paid` string, `Payment Currency` string, `Payment Format` string, `Is Laundering` string"
BANK_LAST, MIXED_END = "2022-09-11 00:00:00", "2025-12-31 00:00:00"
CANONICAL = ["src", "dst", "ts", "amount", "label"]


def label_table(df: DataFrame) -> DataFrame:
    """(node, label) of a table of two columns, whatever their names: ids as strings, labels coerced."""
    if len(df.columns) != 2:
        raise ValueError(f"a label table has two columns, not {df.columns}")
    return df.toDF("node", "label").select(F.col("node").cast("string").alias("node"), label("label").alias("label"))


def in_time(tx: DataFrame, *ties: str) -> DataFrame:
    """Transactions ordered by time; ``ties`` (by default all other columns) decide among equal times."""
    return tx.orderBy("ts", *(ties or [c for c in tx.columns if c != "ts"]))


def no_self_loops(df: DataFrame) -> DataFrame:
    return df.filter("src <> dst")


def until(df: DataFrame, last: str, inclusive: bool) -> DataFrame:
    moment = F.lit(last).cast("timestamp_ntz")
    return df.filter(F.col("ts") <= moment if inclusive else F.col("ts") < moment)


def bank(raw: DataFrame) -> DataFrame:
    """Multi-currency bank transfers. Accounts with one name at two banks are one account."""
    own = raw.withColumnsRenamed({"Account": "src", "Account.1": "dst", "Amount Paid": "amount", "Is Laundering": "label"})
    own = no_self_loops(own).withColumn("amount", number("amount")).filter("amount is not null")
    own = fx.to_usd(own, "amount", "Payment Currency", fx.BANK_RATES, fx.CODES)
    own = own.withColumn("ts", F.to_timestamp_ntz("Timestamp", F.lit("yyyy/MM/dd HH:mm"))).withColumn("label", label("label"))
    return until(own, BANK_LAST, True).select(*CANONICAL)


def simulator(raw: DataFrame) -> DataFrame:
    """Simulated transfers whose time is a number of days since 1970; null amounts stay."""
    day = F.make_dt_interval(F.col("TIMESTAMP").cast("int"))
    own = raw.select(
        F.col("SENDER_ACCOUNT_ID").cast("string").alias("src"), F.col("RECEIVER_ACCOUNT_ID").cast("string").alias("dst"),
        (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + day).alias("ts"), F.col("TX_AMOUNT").cast("double").alias("amount"), label("IS_FRAUD").alias("label"),
    )
    return no_self_loops(own)


def mixed_edges(raw: DataFrame) -> DataFrame:
    """The transactions among typed edges, before the cutoff."""
    own = raw.filter((F.col("edge_type") == "transaction") & ~F.col("src").startswith("individual"))
    own = own.withColumnsRenamed({"dest": "dst", "is_fraudulent": "label"})
    own = fx.to_usd(no_self_loops(own).withColumn("amount", F.col("amount").cast("double")), "amount", "currency", fx.MIXED_RATES)
    return own.withColumn("ts", F.col("timestamp").cast("timestamp_ntz")).withColumn("label", label("label")).select(*CANONICAL)


def mixed(df: DataFrame) -> DataFrame:
    """Canonical rows of typed edges (parsed, or a slim stored copy), trimmed."""
    if "edge_type" in df.columns:
        df = mixed_edges(df)
    elif "from_account" in df.columns:
        df = df.withColumnsRenamed({"from_account": "src", "to_account": "dst", "timestamp": "ts", "is_laundering": "label"}).select(*CANONICAL)
    return until(df, MIXED_END, False)


def read_bank(spark: SparkSession, folder: str, kind: str = "HI-Small") -> DataFrame:
    return bank(spark.read.csv(f"{folder}/{kind}_Trans.csv", header=True, schema=BANK_CSV, enforceSchema=True))


def read_simulator(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    return simulator(spark.read.csv(f"{folder}/transactions.csv", header=True).select("TX_ID", "SENDER_ACCOUNT_ID", "RECEIVER_ACCOUNT_ID", "TIMESTAMP", "TX_AMOUNT", "IS_FRAUD"))


def read_mixed(spark: SparkSession, folder: str, kind: str = "HI") -> DataFrame:
    stem = f"{folder}/generated_edges_{kind}"
    if exists(spark, f"{stem}.parquet"):
        return mixed(spark.read.parquet(f"{stem}.parquet"))
    return mixed(spark.read.csv(f"{stem}.csv", header=True).select("src", "dest", "timestamp", "amount", "currency", "is_fraudulent", "edge_type"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"bank": read_bank, "simulator": read_simulator, "mixed": read_mixed}


def load(spark: SparkSession, dataset: str, folder: str, kind: str | None = None) -> DataFrame:
    """Canonical transactions of a data set by name."""
    if dataset not in LOADERS:
        raise ValueError(f"unknown dataset {dataset!r}: use one of {sorted(LOADERS)}")
    return LOADERS[dataset](spark, folder, *([kind] if kind else []))
