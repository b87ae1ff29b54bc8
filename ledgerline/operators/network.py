"""A feed-forward network (ReLU) with class weight, dropout, weight decay and early stopping.

Spark's own perceptron has none of these. Features are standardised by the training rows; ``training`` has the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .training import Arrays, Setting, log_loss


@dataclass(frozen=True)
class FeedForward:
    width: int
    hidden: tuple[int, ...] = (32,)

    def start(self, rng: np.random.Generator) -> Arrays:
        sizes, out = [self.width, *self.hidden, 1], {}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            out |= {f"w{i}": rng.normal(0, np.sqrt(2 / a), (a, b)), f"b{i}": np.zeros(b)}
        return out

    def logits(self, p: Arrays, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        for i in range(len(self.hidden)):
            x = np.maximum(x @ p[f"w{i}"] + p[f"b{i}"], 0)
        i = len(self.hidden)
        return (x @ p[f"w{i}"] + p[f"b{i}"])[:, 0]

    def gradient(self, p: Arrays, x: np.ndarray, mask: np.ndarray | None, y: np.ndarray, scale: np.ndarray, keep) -> tuple[Arrays, float]:
        inputs, masks, n = [x], [], len(self.hidden)
        for i in range(n):
            z = inputs[-1] @ p[f"w{i}"] + p[f"b{i}"]
            masks.append((z > 0) * keep(f"layer {i}", z.shape[1]))
            inputs.append(z * masks[-1])
        loss, back = log_loss((inputs[-1] @ p[f"w{n}"] + p[f"b{n}"])[:, 0], y, scale)
        back, out = back[:, None], {}
        for i in range(n, -1, -1):
            out |= {f"w{i}": inputs[i].T @ back, f"b{i}": back.sum(0)}
            if i:
                back = (back @ p[f"w{i}"].T) * masks[i - 1]
        return out, loss


def standardised(df: DataFrame, mean: list[float], std: list[float], features: str) -> DataFrame:
    """``df`` with x, the standardised features."""
    m, s = (F.lit(v).cast("array<double>") for v in (mean, std))
    return df.withColumn("x", F.zip_with(F.zip_with(F.col(features).cast("array<double>"), m, lambda a, b: a - b), s, lambda a, b: a / b))


def network(
    train: DataFrame, rows: DataFrame, width: int, features: str = "f", hidden: tuple[int, ...] = (32,), val: DataFrame | None = None, path: str | None = None, **setting,
) -> DataFrame:
    """``rows`` with score; ``setting`` goes to ``training.Setting``, ``path`` is where the state is stored and taken up."""
    stats = train.select(F.posexplode(F.col(features).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).collect()
    mean, std = [0.0] * width, [1.0] * width
    for r in stats:
        mean[r.i], std[r.i] = r["mean"], r["std"] or 1.0
    ready = lambda df: standardised(df, mean, std, features)
    model = FeedForward(width, hidden)
    p = training.train(model, ready(train), None if val is None else ready(val), Setting(**setting), path=path)
    return training.scored(model, p, ready(rows)).drop("x")
