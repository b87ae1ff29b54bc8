"""Result analytics: parsing dumps, keeping the last of repeats, coverage, gaps, best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_metric_blocks(files: DataFrame) -> DataFrame:
    """(path, model, auc_pr, auc_roc, prevalence) of text dumps (path, value), whatever the order of lines.

    A block begins at ``Model:``; prevalence is the first number after ``Precision:``.
    """
    number = r"([-+0-9.eE]+|nan)"
    cut = files.select("path", F.explode(F.split("value", r"(?m)^(?=Model:)")).alias("block")).filter(F.col("block").startswith("Model:"))
    pick = lambda name: F.regexp_extract("block", rf"{name}:\s*\[?\s*{number}", 1).try_cast("double")
    return cut.select("path", F.trim(F.regexp_extract("block", r"Model:\s*([^\n]*)", 1)).alias("model"), pick("AUC[ _]PR").alias("auc_pr"), pick("AUC[ _]ROC").alias("auc_roc"), pick("Precision").alias("prevalence"))


def read_metric_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return parse_metric_blocks(files.select(F.input_file_name().alias("path"), "value"))


def name_parts(path: str = "path") -> list:
    """dataset, run_tag, K, task, kind and models of a dump's file name.

    Names are DATASET_TAG_Kn_TASK_KIND[_MODELS].txt, DATASET_features_MODEL.txt or DATASET_CNN.txt; what a
    name does not hold is null.
    """
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    timed = r"^(.+?)_([a-z][0-9]+_(?:echo|w)[0-9]+)_K([0-9]+)_(nowcast|forecast)_([a-z]+)(?:_([A-Za-z][A-Za-z-]*))?\.txt$"
    still, picture = r"^(.+)_features_([A-Za-z]+)\.txt$", r"^(.+)_(CNN)\.txt$"
    get = lambda pattern, i: F.nullif(F.regexp_extract(last, pattern, i), F.lit(""))
    kind = F.coalesce(get(timed, 5), F.when(last.rlike(still), "features"), F.when(last.rlike(picture), "cnn"))
    return [
        F.coalesce(get(timed, 1), get(still, 1), get(picture, 1)).alias("dataset"), get(timed, 2).alias("run_tag"), get(timed, 3).try_cast("int").alias("K"),
        get(timed, 4).alias("task"), kind.alias("kind"), F.coalesce(get(timed, 6), get(still, 2), get(picture, 2)).alias("models"),
    ]


def _short(values: list) -> str:
    """The first and last three numbers of a long list, as the dumps have them."""
    shown = [f"{v:g}" for v in values]
    return "[" + " ".join(shown if len(shown) <= 6 else [*shown[:3], "...", *shown[-3:]]) + "]"


def metrics_text(model: str, auc_pr: float, auc_roc: float, fpr: list, tpr: list, precision: list, recall: list) -> str:
    """The block that ``parse_metric_blocks`` reads."""
    lists = {"FPR": fpr, "TPR": tpr, "Precision": precision, "Recall": recall}
    return f"Model: {model}\nAUC PR: {auc_pr}\nAUC ROC: {auc_roc}\n" + "".join(f"{k}: {_short(v)}\n" for k, v in lists.items())


def write_metrics(scores: DataFrame, stem: str, model: str = "model") -> DataFrame:
    """Stores areas and prevalence of (model, y, score) as ``stem``.parquet, a row a model, and the curves beside it.

    ``stem``.txt gets a block a model for those who read dumps: curves by their ends, prevalence first.
    """
    from ..sources.tables import save_table, write_text
    from .metrics import auc, pr_curve, roc_curve

    spark = scores.sparkSession
    areas = spark.read.parquet(save_table(auc(scores, model), stem))
    pr, roc = (spark.read.parquet(save_table(curve(scores, model), f"{stem}_{name}")) for name, curve in (("pr", pr_curve), ("roc", roc_curve)))

    def ends(df: DataFrame, columns: list[str], ascending: bool) -> dict:
        """By model the points that are shown of its curve: the first four and the last three.

        Each end is a limit of its own, which Spark takes within tasks before rows meet by model.
        """
        down = Window.partitionBy(model).orderBy(F.asc_nulls_last("threshold") if ascending else F.desc("threshold"))
        up = Window.partitionBy(model).orderBy(F.desc_nulls_first("threshold") if ascending else F.asc("threshold"))
        first = df.withColumn("at", F.row_number().over(down)).filter("at <= 4")
        last = df.withColumn("at", -F.row_number().over(up)).filter("at >= -3")
        found: dict = {}
        for r in sorted(first.unionByName(last).collect(), key=lambda r: (r["at"] < 0, r["at"])):
            found.setdefault(r[model], {}).setdefault(r.threshold, [r[c] for c in columns])  # a short curve's ends overlap
        return {name: list(zip(*points.values(), strict=True)) for name, points in found.items()}

    rows, pr, roc = areas.orderBy(model).collect(), ends(pr, ["precision", "recall"], True), ends(roc, ["fpr", "tpr"], False)  # a few points a model
    blocks = [metrics_text(r[model], r.auc_pr, r.auc_roc, *map(list, roc[r[model]]), *map(list, pr[r[model]])) for r in rows]
    write_text(spark, f"{stem}.txt", "\n".join(blocks))
    return areas


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order given."""
    down = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("__r", F.row_number().over(down)).filter("__r = 1").drop("__r")


def best_per(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The row with the highest value of each key; of equal ones the first in order."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), *order)
    return df.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def sorted_results(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_first(c) for c in columns])


def steps_per_combo(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct K of each combination, sorted."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set("K")).alias("Ks"))


def coverage(have: DataFrame, total: DataFrame, family: str, item: str) -> DataFrame:
    """(family, n_have, n_total): distinct items."""
    a = total.groupBy(family).agg(F.count_distinct(item).alias("n_total"))
    b = have.groupBy(family).agg(F.count_distinct(item).alias("n_have"))
    return a.join(b, family, "left").select(family, F.coalesce("n_have", F.lit(0)).alias("n_have"), "n_total")


def without_predictions(metrics: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.join(predictions.select(*keys).distinct(), keys, "left_anti")


def compare(stored: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float = 1e-4) -> DataFrame:
    """(keys, value, value_again, matches): null where there is nothing to compare with."""
    other = again.select(*keys, F.col(value).alias(f"{value}_again"))
    return stored.select(*keys, value).join(other, keys, "left").withColumn("matches", F.abs(F.col(value) - F.col(f"{value}_again")) <= tolerance)


def sweep_grid(spark: SparkSession, timings: list[str], ks: list[int], tasks: list[str]) -> DataFrame:
    """(cell, timing, K, task): all cells, numbered with the task changing fastest."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    n = len(ks) * len(tasks)
    cell = F.col("id")
    return spark.range(len(timings) * n).select(
        cell.cast("int").alias("cell"), pick(timings, F.floor(cell / n)).alias("timing"), pick(ks, F.pmod(F.floor(cell / len(tasks)), F.lit(len(ks)))).alias("K"), pick(tasks, F.pmod(cell, F.lit(len(tasks)))).alias("task")
    )


def missing_cells(grid: DataFrame, results: DataFrame, keys: list[str], wanted: int = 1) -> DataFrame:
    """Cells with fewer than ``wanted`` results: how many there are and what is to do."""
    have = results.groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.join(have, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < wanted).withColumn("state", F.when(F.col("n") == 0, "missing").otherwise("top-up"))


def unknown_results(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return results.join(grid.select(*keys), keys, "left_anti")


def sample_nodes(df: DataFrame, positives: int, negatives: int, seed: int = 7) -> DataFrame:
    """At most so many positive and negative rows, chosen by a hash of the node."""
    pick = lambda y, n: df.filter(y).orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(n)
    return pick(F.col("label") > 0, positives).unionByName(pick(F.col("label") <= 0, negatives))
