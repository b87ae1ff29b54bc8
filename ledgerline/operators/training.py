"""Training of small networks on all rows: gradients summed by tasks, steps taken by the driver.

An epoch is one pass over a stored table of the training rows; tasks add up the gradient of their rows in numpy,
and sums of the size of the network come back. Class weight, dropout, weight decay, early stopping by the
area under precision and recall of a validation table, and a state that is stored every few epochs and taken up again.

A model has ``start(rng)`` (its arrays by name), ``logits(p, x, mask)`` and
``gradient(p, x, mask, y, scale, keep) -> (gradients by name, loss)``, summed over rows; ``keep(name, units)`` gives
dropout's multipliers. A model may also sum statistics of a pass and put them into its arrays (``stats``, ``settle``).

Defined results: without training rows every score is 0.5; without positives or negatives the class weight is 1;
ties of the validation measure keep the earlier network; equal rows drop the same units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from ..sources import tables
from . import metrics
from .pin import Pins

Arrays = dict[str, np.ndarray]
_STATE = "epoch int, stale int, best double, weights array<double>, kept array<double>, first array<double>, second array<double>, fixed array<double>"


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_loss(z: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted log loss of logits, summed, and its gradient."""
    return float((scale * (np.logaddexp(0, z) - y * z)).sum()), scale * (sigmoid(z) - y)


def chances(rows: np.ndarray, units: int, *seeds: int) -> np.ndarray:
    """Uniform numbers (rows, units) that a row's hash, a unit and ``seeds`` decide (splitmix64)."""
    U = np.uint64
    with np.errstate(over="ignore"):
        z = rows.astype(np.int64).view(U)[:, None] + U(0x9E3779B97F4A7C15) * np.arange(1, units + 1, dtype=U)[None, :]
        for s in seeds:
            z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9) + U(s)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        z = z ^ (z >> U(31))
    return (z >> U(11)).astype(float) / float(1 << 53)


class Flat:
    """Arrays by name as one array of numbers."""

    def __init__(self, like: Arrays):
        self.shapes = {k: v.shape for k, v in like.items()}
        self.size = sum(v.size for v in like.values())

    def pack(self, p: Arrays) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in self.shapes]) if self.shapes else np.empty(0)

    def unpack(self, flat: np.ndarray) -> Arrays:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[k], at = flat[at : at + n].reshape(shape), at + n
        return out


@dataclass
class Setting:
    weight: float | None = None  # of positives; by default negatives over positives
    dropout: float = 0.0
    decay: float = 1e-5
    step: float = 0.01
    epochs: int = 100
    every: int = 10  # epochs between validations
    patience: int = 3  # validations without a gain that end training
    seed: int = 7
    save_every: int = 10  # epochs between stored states


def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
    """x (rows, width) and mask (rows, steps) or None of a batch (x, mask, ...)."""
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
    mask = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
    return x, mask if mask.size else None


def prepared(df: DataFrame, x: str, mask: str | None) -> DataFrame:
    """(x, mask, y, h): what a pass reads; h: a hash of the row for dropout."""
    own = df.select(F.col(x).cast("array<float>").alias("x"), (F.col(mask) if mask else F.array().cast("array<boolean>")).alias("mask"), F.col("y").cast("double").alias("y"))
    return own.withColumn("h", F.xxhash64("x", "y"))


def descend(spark: SparkSession, begun: Arrays, epoch: Callable, judge: Callable | None, setting: Setting, path: str | None = None, constant: tuple[str, ...] = (), settle: Callable | None = None) -> Arrays:
    """Adam steps from ``begun``; ``epoch(i, arrays)`` gives the mean gradient and sums that ``settle`` turns into the ``constant`` arrays.

    ``judge(arrays)`` is the validation measure. The state is stored at ``path`` and, if there is one, taken up.
    """
    flat, fixed = parts(begun, constant)
    now, held = flat.pack(begun), fixed.pack(begun)
    first, second, best, kept, stale, last = np.zeros_like(now), np.zeros_like(now), -1.0, np.concatenate([now, held]), 0, 0
    if path and tables.find_table(spark, path):
        s = tables.load_table(spark, path).first()
        last, stale, best = s.epoch, s.stale, s.best
        now, kept, first, second, held = (np.array(s[c]) for c in ("weights", "kept", "first", "second", "fixed"))
    whole = lambda flat_, held_: flat.unpack(flat_) | fixed.unpack(held_)
    for i in range(last + 1, setting.epochs + 1):
        if stale >= setting.patience:
            break
        grad, sums = epoch(i, whole(now, held))
        if settle is not None:
            held = fixed.pack(settle(fixed.unpack(held), fixed.unpack(sums)))
        grad = grad + setting.decay * now
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        now = now - setting.step * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
        if judge is not None and (i % setting.every == 0 or i == setting.epochs):
            value = judge(whole(now, held))
            if value is not None and value > best:
                best, kept, stale = value, np.concatenate([now, held]), 0
            else:
                stale += 1
        if path and (i % setting.save_every == 0 or i == setting.epochs or stale >= setting.patience):
            state = [(i, stale, float(best), *[v.tolist() for v in (now, kept, first, second, held)])]
            tables.save_table(spark.createDataFrame(state, _STATE).coalesce(1), path)
    return whole(now, held) if judge is None else whole(kept[: flat.size], kept[flat.size :])


def parts(begun: Arrays, constant: tuple[str, ...]) -> tuple[Flat, Flat]:
    return Flat({k: v for k, v in begun.items() if k not in constant}), Flat({k: v for k, v in begun.items() if k in constant})


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of the arrays g of ``rows``."""
    out = np.zeros(size)
    for r in rows.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = float(f"{r.v:.12g}")  # sums differ in their last digits between runs
    return out


def dropout(setting: Setting, h: np.ndarray, i: int) -> Callable[[str, int], np.ndarray | float]:
    """Multipliers of units for rows of hashes ``h`` in epoch ``i``."""

    def keep(name: str, units: int) -> np.ndarray | float:
        if not setting.dropout:
            return 1.0
        return (chances(h, units, setting.seed, i, sum(name.encode())) >= setting.dropout) / (1 - setting.dropout)

    return keep


def class_weight(setting: Setting, n: int, positive: int) -> float:
    if setting.weight is not None:
        return setting.weight
    return (n - positive) / positive if 0 < positive < n else 1.0


def train(model, rows: DataFrame, val: DataFrame | None, setting: Setting, x: str = "x", mask: str | None = None, path: str | None = None) -> Arrays | None:
    """The trained arrays of ``model``, None without rows (x, mask, y). With ``path`` training goes on from the state stored there."""
    spark = rows.sparkSession
    ship(spark)
    own = Pins(spark, "training").put(prepared(rows, x, mask))
    counted = own.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p")).first()
    if not counted.n:
        return None
    weight = class_weight(setting, counted.n, counted.p)
    begun, constant = model.start(np.random.default_rng(setting.seed)), tuple(getattr(model, "stats", ()))
    flat, fixed = parts(begun, constant)

    def epoch(i: int, p: Arrays) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros(flat.size), np.zeros(fixed.size)
            for b in batches:
                if b.num_rows:
                    (x_, mask_), y = columns(b), b.column(2).to_numpy()
                    total += flat.pack(model.gradient(p, x_, mask_, y, np.where(y > 0, weight, 1.0), dropout(setting, b.column(3).to_numpy(), i))[0])
                    if fixed.size:
                        sums += fixed.pack(model.sums(p, x_, mask_))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, sums])])], names=["g"])

        out = summed(own.mapInArrow(run, "g array<double>"), flat.size + fixed.size)
        return out[: flat.size] / counted.n, out[flat.size :]

    def judge(p: Arrays) -> float | None:
        return area(scored(model, p, val, x, mask))

    settle = (lambda held, sums: model.settle(held, sums, counted.n)) if constant else None
    return descend(spark, begun, epoch, judge if val is not None else None, setting, path, constant, settle)


def area(rows: DataFrame) -> float | None:
    """Area under precision and recall of (score, y); 0 without positives."""
    found = metrics.auc(rows.select("score", "y")).first()
    return None if found is None else found.auc_pr or 0.0


def scored(model, p: Arrays | None, rows: DataFrame, x: str = "x", mask: str | None = None) -> DataFrame:
    """``rows`` with score; 0.5 without a trained model."""
    if p is None:
        return rows.withColumn("score", F.lit(0.5))
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    own = rows.select("*", F.col(x).cast("array<float>").alias("__x"), (F.col(mask) if mask else F.array().cast("array<boolean>")).alias("__mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                last = pa.RecordBatch.from_arrays(b.columns[-2:], names=["x", "mask"])
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sigmoid(model.logits(p, *columns(last))))], names=schema.names)

    return own.mapInArrow(run, schema)


def rescored(model, path: str, rows: DataFrame, x: str = "x", mask: str | None = None) -> DataFrame:
    """``rows`` with score by the best network of the state stored at ``path``; nothing is trained."""
    flat, fixed = parts(model.start(np.random.default_rng(0)), tuple(getattr(model, "stats", ())))
    s = tables.load_table(rows.sparkSession, path).first()
    kept = np.array(s.kept) if s.best >= 0 else np.concatenate([np.array(s.weights), np.array(s.fixed)])
    return scored(model, flat.unpack(kept[: flat.size]) | fixed.unpack(kept[flat.size :]), rows, x, mask)


def differences(loss: Callable[[], float], v: np.ndarray, places: list[int], e: float = 1e-5) -> list[float]:
    """The gradient of ``loss`` at some ``places`` of ``v`` by central differences."""
    out = []
    for j in places:
        own = v.flat[j]
        v.flat[j] = own + e
        up = loss()
        v.flat[j] = own - e
        down = loss()
        v.flat[j] = own
        out.append((up - down) / (2 * e))
    return out
