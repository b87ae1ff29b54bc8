"""Models on feature vectors: built-in learners where Spark has them, small numpy ones where not.

Networks are in ``network``, ``sequence`` and ``sage``, second-order boosting is in ``boosting``; ``score_with`` runs any
function of a batch.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .pin import Pins
from .training import chances, log_loss, summed


def _vectors(df: DataFrame, features: str, weight: float | None) -> DataFrame:
    own = df.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))).withColumn("y", F.col("y").cast("double"))
    return own if weight is None else own.withColumn("weight", F.when(F.col("y") > 0, weight).otherwise(1.0))


def _scored(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "weight", "rawPrediction", "probability", "prediction")


def logistic(train: DataFrame, rows: DataFrame, features: str = "f", c: float = 1.0, max_iter: int = 1000) -> DataFrame:
    """``rows`` with score; an L2 penalty of 1 / C on raw features, the intercept free.

    Newton steps: a pass over the training rows adds up loss, gradient and curvature by task, and the driver solves for the
    step, halved while the loss would rise. Without training rows every score is 0.5; with one class, that class.
    """
    ship(train.sparkSession)
    own = Pins(train.sparkSession, "logistic").put(train.select(F.col(features).cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")))
    seen = own.agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("p"), F.max(F.size("x")).alias("width")).first()
    if not seen.n or seen.p in (0, seen.n):
        return rows.withColumn("y", F.col("y").cast("double")).withColumn("score", F.lit(seen.p / seen.n if seen.n else 0.5))
    width, penalty = seen.width + 1, np.append(np.full(seen.width, 1 / c), 0.0)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + width + width * width)
            for b in batches:
                if b.num_rows:
                    x = np.hstack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.ones((b.num_rows, 1))])
                    y = (b.column(1).to_numpy() > 0).astype(float)
                    loss, slope = log_loss(x @ w, y, np.ones(b.num_rows))
                    p = slope + y
                    total += np.concatenate([[loss], x.T @ slope, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["g"])

        out = summed(own.mapInArrow(run, "g array<double>"), 1 + width + width * width)
        return out[0] + (penalty * w * w).sum() / 2, out[1 : 1 + width] + penalty * w, out[1 + width :].reshape(width, width) + np.diag(penalty)

    w = np.zeros(width)
    loss, grad, curve = sums(w)
    for _ in range(max_iter):
        step = np.linalg.lstsq(curve, grad, rcond=None)[0]
        if grad @ step <= 1e-12 * max(1.0, loss):  # twice what a step can gain
            break
        tried = sums(w - step)
        while tried[0] > loss and np.abs(step).max() > 1e-12:
            step = step / 2
            tried = sums(w - step)
        if tried[0] >= loss:
            break
        w, (loss, grad, curve) = w - step, tried
    # an expression of numbers alone: no model goes to the tasks
    at = F.aggregate(F.zip_with(F.col(features), F.array(*map(F.lit, w[:-1].tolist())), lambda x, k: x.cast("double") * k), F.lit(float(w[-1])), lambda a, v: a + v)
    return rows.select("*", (1 / (1 + F.exp(-at))).alias("score")).withColumn("y", F.col("y").cast("double"))


def boosted(train: DataFrame, rows: DataFrame, features: str = "f", trees: int = 20, depth: int = 4, step: float = 0.1, weight: float | None = None, val: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """``rows`` with score; with ``val`` boosting stops when it no longer helps there."""
    from pyspark.ml.classification import GBTClassifier

    own = _vectors(train, features, weight).withColumn("is_val", F.lit(False))
    learner = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    if weight is not None:
        learner = learner.setWeightCol("weight")
    if val is not None:
        own = own.unionByName(_vectors(val, features, weight).withColumn("is_val", F.lit(True)))
        learner = learner.setValidationIndicatorCol("is_val")
    return _scored(learner.fit(own), _vectors(rows, features, weight))


def perceptron(train: DataFrame, rows: DataFrame, width: int, features: str = "f", hidden: tuple[int, ...] = (32,), max_iter: int = 100, seed: int = 7) -> DataFrame:
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    fit = MultilayerPerceptronClassifier(labelCol="y", layers=[width, *hidden, 2], maxIter=max_iter, seed=seed).fit(_vectors(train, features, None))
    return _scored(fit, _vectors(rows, features, None))


def fit_pipeline(train: DataFrame, learner: str = "logistic", features: str = "f", weight: float | None = None, seed: int = 7, **options):
    """A fitted pipeline (vectors, learner), to be stored by ``save_model``; options go to the learner."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    kinds = {"logistic": LogisticRegression, "boosted": GBTClassifier}
    if learner not in kinds:
        raise ValueError(f"unknown learner {learner!r}: use one of {sorted(kinds)}")
    made = kinds[learner](labelCol="y", **({"seed": seed} if learner == "boosted" else {}), **({"weightCol": "weight"} if weight is not None else {}), **options)
    return Pipeline(stages=[made]).fit(_vectors(train, features, weight))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def rescore(path: str, rows: DataFrame, features: str = "f") -> DataFrame:
    """``rows`` with score, by the stored pipeline of ``path``; nothing is fitted."""
    from pyspark.ml import PipelineModel

    return _scored(PipelineModel.load(path), _vectors(rows, features, None))


def cross_validated(train: DataFrame, space: list[dict], folds: int = 5, features: str = "f", seed: int = 7) -> list[dict]:
    """Settings of the boosted trees with their mean area under ROC over ``folds``, best first; folds go by a hash of the row."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    own = _vectors(train, features, None).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(folds)))
    judge = BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderROC")

    def trial(setting: dict) -> float:
        return float(np.mean([judge.evaluate(fit_pipeline(own.filter(F.col("fold") != i).drop("features"), "boosted", features, seed=seed, **setting).transform(own.filter(F.col("fold") == i))) for i in range(folds)]))

    return tune(space, trial)


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
    if depth == 0 or len(x) <= 1 or not len(spread):
        return (len(x),)
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, cut, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1)


def _depths(tree: tuple, x: np.ndarray, at: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), at + _path(tree[0]))
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = _depths(tree[2], x[left], at + 1), _depths(tree[3], x[~left], at + 1)
    return out


def forest_samples(train: DataFrame, features: str, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, h, k, f): for each tree the ``sample`` rows with the smallest (hash by tree, hash of the key), and few more.

    Rows above a bound that about twice as many pass are left out before anything moves; where a tree gets too few, the
    bound is doubled, so what is sampled does not depend on it.
    """
    ship(train.sparkSession)
    own = train.select(F.xxhash64(F.lit(seed), key).alias("k"), F.col(features).cast("array<double>").alias("f"))
    n = own.count()
    bound = min(1.0, 2 * sample / max(1, n))

    def run(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = chances(b.column(0).to_numpy(), trees, seed)
                row, tree = np.nonzero(u < bound) if bound < 1 else np.divmod(np.arange(u.size), trees)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(u[row, tree]), b.column(0).take(at), b.column(1).take(at)], names=["tree", "h", "k", "f"])

    while True:
        met = own.mapInArrow(lambda b, bound=bound: run(b, bound), "tree int, h double, k long, f array<double>")
        if bound >= 1 or met.groupBy("tree").count().filter(F.col("count") >= min(sample, n)).count() == trees:
            return met
        bound = min(1.0, 2 * bound)


def isolation_forest(train: DataFrame, rows: DataFrame, features: str = "f", key: str = "row_id", trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """``rows`` with score in (0, 1), higher for outliers; 1 without training rows.

    Every tree has a sample of its own from all rows and grows in a task of its own; trees alone come to the driver.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k"]).head(sample)
        x, tree = np.stack(pdf["f"].to_numpy()).astype(float), int(pdf["tree"].iloc[0])
        grown = _tree(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(2, len(x))))))
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "grown": [json.dumps(grown)]})

    found = forest_samples(train, features, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, "tree int, size int, grown string").orderBy("tree").collect()
    forest, norm = [json.loads(r.grown) for r in found], (_path(found[0]["size"]) if found else 1.0) or 1.0

    def score(x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-sum((_depths(t, x) for t in forest), np.zeros(len(x))) / max(1, len(forest)) / norm)

    return score_with(rows, score, features)


def score_with(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], features: str = "f") -> DataFrame:
    """``rows`` with score, from a function of a batch of feature vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=score(np.stack(b[features].to_numpy()).astype(float)).astype(float) if len(b) else np.empty(0))

    from pyspark.sql import types as T

    ship(rows.sparkSession)
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def search_space(spec: dict) -> list[dict]:
    """All settings of a specification: lists are choices, {low, high, num[, log]} are grids, else constants."""

    def values(v):
        if isinstance(v, dict) and {"low", "high"} <= set(v):
            n, f = int(v.get("num", 5)), np.geomspace if v.get("log") else np.linspace
            out = f(v["low"], v["high"], n)
            return sorted({int(round(x)) for x in out}) if isinstance(v["low"], int) and isinstance(v["high"], int) else [float(x) for x in out]
        return v if isinstance(v, list) else [v]

    return [dict(zip(spec, p, strict=True)) for p in itertools.product(*map(values, spec.values()))]


def tune(space: list[dict], trial: Callable[[dict], float], done: list[dict] | None = None, most: int | None = None, seconds: float | None = None) -> list[dict]:
    """Runs settings that are not ``done`` until ``most`` trials or the time is up; all trials, best first."""
    import time

    trials, began = list(done or []), time.monotonic()
    seen = [t["setting"] for t in trials]
    for setting in space:
        if (most is not None and len(trials) >= most) or (seconds is not None and time.monotonic() - began > seconds):
            break
        if setting not in seen:
            trials.append({"setting": setting, "value": float(trial(setting))})
    return sorted(trials, key=lambda t: -t["value"])


def pack_bits(df: DataFrame, column: str) -> DataFrame:
    """An array of 0 and 1 as packed bytes, first bit highest."""
    bits = F.array_join(F.col(column).cast("array<string>"), "")
    padded = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    return df.withColumn(column, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(padded) / 4 - 1).cast("int")), lambda i: F.conv(F.substr(padded, i * 4 + 1, F.lit(4)), 2, 16)), "")))


def unpack_bits(df: DataFrame, column: str, size: int) -> DataFrame:
    """The first ``size`` bits of packed bytes as an array of 0 and 1."""
    digits = F.split(F.hex(column), "(?<=.)(?=.)")
    bits = F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    return df.withColumn(column, F.transform(F.slice(F.split(bits, "(?<=.)(?=.)"), 1, size), lambda b: b.cast("int")))
