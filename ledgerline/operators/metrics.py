"""Ranking metrics of (keys, y, score) tables; equal scores always count together.

Rows are first summed by score, so what is ordered afterwards is one row a distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pin import pinned


def by_score(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, score, n, tp, cum_n, cum_tp, all_n, all_tp, next_n, next_tp): running sums from the highest score
    down, and the counts of the next lower score.

    Scores are dealt by range, summed by part, and the parts' sums (a row a part and key) shift the rest,
    so no task sees all scores of a key.
    """
    sums = df.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("tp"))
    ranged = pinned(sums.repartitionByRange(*keys, F.desc("score")).withColumn("__part", F.spark_partition_id()))
    first = lambda c: F.max_by(c, F.struct(F.col("score").isNotNull(), "score"))
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"), F.sum("tp").alias("__tp"), first("n").alias("__first_n"), first("tp").alias("__first_tp"))
    onward = Window.partitionBy(*keys).orderBy("__part")
    whole, above = Window.partitionBy(*keys), onward.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__up_n"), F.coalesce(F.sum("__tp").over(above), F.lit(0)).alias("__up_tp"),
        F.sum("__n").over(whole).alias("all_n"), F.sum("__tp").over(whole).alias("all_tp"), F.lead("__first_n").over(onward).alias("__next_n"), F.lead("__first_tp").over(onward).alias("__next_tp"),
    )
    order = Window.partitionBy(*keys, "__part").orderBy(F.desc("score"))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select(*keys, "__part", "score", "n", "tp", F.sum("n").over(down).alias("cum_n"), F.sum("tp").over(down).alias("cum_tp"), F.lead("n").over(order).alias("next_n"), F.lead("tp").over(order).alias("next_tp"))
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return own.join(parts, same).select(
        *keys, "score", "n", "tp", (F.col("cum_n") + F.col("__up_n")).alias("cum_n"), (F.col("cum_tp") + F.col("__up_tp")).alias("cum_tp"), "all_n", "all_tp",
        F.coalesce("next_n", "__next_n").alias("next_n"), F.coalesce("next_tp", "__next_tp").alias("next_tp"),
    )


def auc(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, auc_pr, auc_roc, prevalence): average precision; area under ROC with ties shared."""
    own = by_score(df, *keys)
    ap = F.try_divide(F.col("tp").cast("double"), F.col("all_tp")) * F.col("cum_tp") / F.col("cum_n")
    fp = F.col("n") - F.col("tp")
    won = F.col("tp") * (F.col("all_n") - F.col("all_tp") - (F.col("cum_n") - F.col("cum_tp")) + fp / 2)  # negatives below, half of those equal
    return own.groupBy(*keys).agg(
        F.sum(F.when(F.col("all_tp") > 0, ap)).alias("auc_pr"),
        F.try_divide(F.sum(won), F.max(F.col("all_tp") * (F.col("all_n") - F.col("all_tp"))).cast("double")).alias("auc_roc"),
        (F.max("all_tp") / F.max("all_n")).alias("prevalence"),
    )


def pr_curve(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, threshold, precision, recall); the closing point (1, 0) has no threshold."""
    own = by_score(df, *keys)
    points = own.select(*keys, F.col("score").alias("threshold"), (F.col("cum_tp") / F.col("cum_n")).alias("precision"), F.try_divide(F.col("cum_tp").cast("double"), F.col("all_tp")).alias("recall"))
    close = own.select(*keys).distinct() if keys else own.select(F.lit(1)).limit(1)
    return points.unionByName(close.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def roc_curve(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, threshold, fpr, tpr) from (0, 0); points on a straight line between others are left out."""
    own = by_score(df, *keys).withColumn("fp", F.col("cum_n") - F.col("cum_tp"))
    dx, dy = F.col("n") - F.col("tp"), F.col("tp")
    dx2, dy2 = F.col("next_n") - F.col("next_tp"), F.col("next_tp")
    kept = own.filter(dx2.isNull() | (dx * dy2 != dy * dx2))
    points = kept.select(*keys, F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("all_n") - F.col("all_tp")).alias("fpr"), F.try_divide(F.col("cum_tp").cast("double"), F.col("all_tp")).alias("tpr"))
    start = own.select(*keys).distinct() if keys else own.select(F.lit(1)).limit(1)
    return start.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).unionByName(points)


def precision_at(df: DataFrame, k: int | float | Column, *keys: str) -> DataFrame:
    """(keys, k, precision): expected precision of the k best, ties at the cutoff shared; a float is a
    share of the rows, rounded up; null if k is not between 1 and their number."""
    own = by_score(df, *keys)
    size = F.ceil(F.col("all_n") * F.lit(k)).cast("long") if isinstance(k, float) else (k if isinstance(k, Column) else F.lit(k)).cast("long")
    own = own.withColumn("k", size)
    slots = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - (F.col("cum_n") - F.col("n"))))
    held = F.sum(slots * F.col("tp") / F.col("n"))
    return own.groupBy(*keys, "k").agg(F.when((F.max("k") >= 1) & (F.max("k") <= F.max("all_n")), held / F.nullif(F.max("k"), F.lit(0).cast("long"))).alias("precision"))


def r_precision(df: DataFrame, *keys: str) -> DataFrame:
    """Precision at the number of positives."""
    return precision_at(df, F.col("all_tp"), *keys)


def f1(tp: Column, predicted: Column, positives: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, predicted + positives), F.lit(0.0))


def best_f1(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, best_f1, threshold, precision, recall); of equal ones the lowest threshold."""
    return _best(by_score(df, *keys), *keys)


def _best(own: DataFrame, *keys: str) -> DataFrame:
    own = own.withColumn("f1", f1(F.col("cum_tp"), F.col("cum_n"), F.col("all_tp")))
    at = F.struct("score", (F.col("cum_tp") / F.col("cum_n")).alias("precision"), F.coalesce(F.try_divide(F.col("cum_tp").cast("double"), F.col("all_tp")), F.lit(0.0)).alias("recall"))
    found = own.groupBy(*keys).agg(F.max("f1").alias("best_f1"), F.min_by(at, F.struct(-F.col("f1"), "score")).alias("at"))
    return found.select(*keys, "best_f1", F.col("at.score").alias("threshold"), "at.precision", "at.recall")


def f1_at(df: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """(keys, f1) with scores from ``threshold`` up as positive."""
    hit = F.col("score") >= F.lit(threshold)
    sums = (df.groupBy(*keys) if keys else df).agg(F.sum((hit & (F.col("y") > 0)).cast("long")).alias("tp"), F.count_if(hit).alias("p"), F.sum(F.col("y").cast("long")).alias("pos"))
    return sums.select(*keys, f1(F.col("tp"), F.col("p"), F.col("pos")).alias("f1"))


def k_label(k: int | float) -> str:
    """P@100 for a count, P@0.5% for a share of the rows."""
    return f"P@{k * 100:g}%" if isinstance(k, float) and 0 < k < 1 else f"P@{int(k)}"


def extra_metrics(df: DataFrame, *keys: str, at: tuple[int, ...] = (100,), shares: tuple[float, ...] = (), r_precision: bool = False) -> DataFrame:
    """By ``keys``, F1@0.5, F1_best with its threshold, precision and recall, P@k, P@x% and P@R.

    A precision at more rows than there are is null. Equal labels of ``at`` and ``shares`` are given once.
    """
    own = pinned(by_score(df, *keys))
    sizes = {k_label(k): F.lit(int(k)).cast("long") for k in at} | {k_label(float(x)): F.ceil(F.col("all_n") * F.lit(float(x))).cast("long") for x in shares}
    if r_precision:
        sizes["P@R"] = F.col("all_tp").cast("long")
    held = []
    for name, k in sizes.items():
        slots = F.greatest(F.lit(0), F.least(F.col("n"), k - (F.col("cum_n") - F.col("n"))))
        size = F.max(k)
        held.append(F.when((size >= 1) & (size <= F.max("all_n")), F.sum(slots * F.col("tp") / F.col("n")) / F.nullif(size, F.lit(0).cast("long"))).alias(name))
    hit = F.col("score") >= F.lit(0.5)
    sure = f1(F.sum(F.when(hit, F.col("tp")).otherwise(0)), F.sum(F.when(hit, F.col("n")).otherwise(0)), F.max("all_tp")).alias("F1@0.5")
    best = _best(own, *keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("best_f1").alias("F1_best"), F.col("threshold").alias("F1_best_threshold"), F.col("precision").alias("F1_best_precision"), F.col("recall").alias("F1_best_recall"))
    found = own.groupBy(*keys).agg(sure, *held)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(best, same).drop(*[f"__{k}" for k in keys])
