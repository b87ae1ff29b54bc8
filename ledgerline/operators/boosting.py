"""Second-order histogram boosting of trees for the log loss.

Features are cut into bins at approximate quantiles and rows are stored once as bytes. A level of a tree is one pass: tasks
sum gradients and Hessians of their rows by (leaf, feature, bin), sums of that size meet in one aggregation, and
the driver takes each leaf's best split by the Newton gain. What a pass needs of the trees so far it replays from
the margins that are stored every KEEP trees.

Defined results: without training rows every score is 0.5; NaN and null go right of every cut; equal gains go to
the smaller feature, then to the lower cut; a leaf's value is - step * G / (H + l2); equal rows are drawn alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from ..sources import tables
from .pin import Pins
from .training import area, chances, sigmoid, summed

#: Trees after which margins are stored anew.
KEEP = 10


@dataclass(frozen=True)
class Setting:
    trees: int = 50
    depth: int = 4
    step: float = 0.1
    bins: int = 32  # at most 255
    l2: float = 1.0
    gamma: float = 0.0  # gain that a split must exceed
    least: float = 1.0  # Hessian of each side of a split
    rows: float = 1.0  # share of rows that a tree sees, drawn by a hash
    columns: float = 1.0  # share of features that a tree sees
    weight: float = 1.0  # of positives
    every: int = 5  # trees between validations
    patience: int = 4  # validations without a gain that end training
    seed: int = 7


@dataclass
class Tree:
    """Nodes as in a heap: node i has the children 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node of each row of bins, after ``depth`` levels at most."""
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1 if depth is None else depth):
            f = self.feature[at]
            down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at])
            at = np.where(f >= 0, down, at)
        return at


@dataclass
class Forest:
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of raw features: the first whose cut is not below the value."""
        out = np.empty(x.shape, np.uint8)
        for i, c in enumerate(self.cuts):
            out[:, i] = np.searchsorted(c, x[:, i], side="left")
        return out

    def margins(self, x: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        return sum((t.value[t.leaves(x)] for t in (self.trees if trees is None else trees)), np.zeros(len(x)))

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [{k: v.tolist() for k, v in asdict(t).items()} for t in self.trees]
        tables.write_text(spark, path, json.dumps({"cuts": self.cuts, "trees": trees}))


def load(spark: SparkSession, path: str) -> Forest:
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    kinds = {"feature": np.int64, "cut": np.int64, "value": float}
    return Forest(found["cuts"], [Tree(**{k: np.array(v, kinds[k]) for k, v in t.items()}) for t in found["trees"]])


def quantile_cuts(rows: DataFrame, features: str, bins: int) -> list[list[float]]:
    """Distinct approximate quantiles of each feature, at most ``bins`` - 1."""
    shares = [i / bins for i in range(1, bins)]
    own = rows.select(F.posexplode(F.col(features).cast("array<double>")).alias("i", "v")).filter("v is not null and not isnan(v)")
    found = {r.i: sorted(set(r.q)) for r in own.groupBy("i").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}
    width = max((r.n for r in rows.select(F.size(features).alias("n")).limit(1).collect()), default=0)
    return [found.get(i, []) for i in range(width)]


def _raw(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(n, -1)


def best_splits(sums: np.ndarray, setting: Setting, allowed: np.ndarray) -> list[tuple[int, int, float, float, float, float] | None]:
    """For each leaf of ``sums`` (leaf, feature, bin, 2): (feature, cut, G left, H left, G, H) or None."""
    out: list = []
    for own in sums:
        g, h = own[0, :, 0].sum(), own[0, :, 1].sum()
        left = own.cumsum(1)[:, :-1]
        gl, hl = left[..., 0], left[..., 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (gl**2 / (hl + setting.l2) + (g - gl) ** 2 / (h - hl + setting.l2) - g**2 / (h + setting.l2)) - setting.gamma
        gain[(hl < setting.least) | (h - hl < setting.least) | ~allowed[:, None] | ~np.isfinite(gain)] = -np.inf
        gain = np.round(gain, 9)  # sums differ in their last digits between runs
        k = int(gain.argmax()) if gain.size else 0
        f, b = divmod(k, gain.shape[1]) if gain.size else (0, 0)
        out.append((f, b, float(gl[f, b]), float(hl[f, b]), float(g), float(h)) if gain.size and gain[f, b] > 0 else None)
    return out


def boost(train: DataFrame, setting: Setting, features: str = "f", val: DataFrame | None = None, cuts: list[list[float]] | None = None) -> Forest:
    """Trees for the rows (features, y) of ``train``; with ``val`` those up to its best area under precision and recall."""
    spark = train.sparkSession
    ship(spark)
    forest = Forest(quantile_cuts(train, features, setting.bins) if cuts is None else cuts)
    width, bins = len(forest.cuts), max((len(c) for c in forest.cuts), default=0) + 1
    pins = Pins(spark, "boosting")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = forest.binned(_raw(b.column(0), b.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2), pa.array(np.zeros(b.num_rows))], names=["x", "y", "h", "margin"])

    own = train.select(F.col(features).cast("array<double>").alias("f"), F.col("y").cast("double").alias("y"), F.xxhash64(features, "y").alias("h"))
    kinds = "x binary, y double, h long, margin double"
    data = pins.put(own.mapInArrow(pack, kinds)) if width else None
    if data is None or data.isEmpty():
        return forest
    fresh: list[Tree] = []

    def opened(b: pa.RecordBatch, later: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, width)
        return x, b.column(3).to_numpy() + forest.margins(x, later)

    def level(tree: Tree, depth: int, number: int) -> np.ndarray:
        later, first, leaves = list(fresh), 2**depth - 1, 2**depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width, leaves * bins))
            for b in batches:
                if not b.num_rows:
                    continue
                x, margin = opened(b, later)
                y, h = b.column(1).to_numpy(), b.column(2).to_numpy()
                at = tree.leaves(x, depth)
                use = at >= first
                if setting.rows < 1:
                    use &= chances(h, 1, setting.seed, number)[:, 0] < setting.rows
                p, scale = sigmoid(margin), np.where(y > 0, setting.weight, 1.0)
                g, hess = (scale * (p - y))[use], (scale * p * (1 - p))[use]
                place = (at[use] - first) * bins
                for f in range(width):
                    total[0, f] += np.bincount(place + x[use, f], g, leaves * bins)
                    total[1, f] += np.bincount(place + x[use, f], hess, leaves * bins)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["g"])

        found = summed(data.mapInArrow(run, "g array<double>"), 2 * width * leaves * bins)
        return found.reshape(2, width, leaves, bins).transpose(2, 1, 3, 0)

    best, kept, stale = -1.0, 0, 0
    for number in range(setting.trees):
        n = 2 ** (setting.depth + 1) - 1
        tree = Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))
        draw = np.random.default_rng([setting.seed, number]).permutation(width)[: max(1, round(setting.columns * width))]
        allowed = np.isin(np.arange(width), draw)
        grown = False
        for depth in range(setting.depth):
            first = 2**depth - 1
            if depth and not (tree.feature[(first - 1) // 2 : first] >= 0).any():
                break
            for i, split in enumerate(best_splits(level(tree, depth, number), setting, allowed)):
                at = first + i
                if split is None or (depth and tree.feature[(at - 1) // 2] < 0):
                    continue
                f, b, gl, hl, g, h = split
                tree.feature[at], tree.cut[at], grown = f, b, True
                for child, cg, ch in ((2 * at + 1, gl, hl), (2 * at + 2, g - gl, h - hl)):
                    tree.value[child] = -setting.step * cg / (ch + setting.l2)
        if not grown:
            break
        forest.trees.append(tree)
        fresh.append(tree)
        if len(fresh) >= KEEP:
            later = list(fresh)

            def onward(batches: Iterator[pa.RecordBatch], later: list[Tree] = later) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(opened(b, later)[1])], names=["x", "y", "h", "margin"])

            again = pins.put(data.mapInArrow(onward, kinds))
            pins.drop(data)
            data, fresh = again, []
        if val is not None and ((number + 1) % setting.every == 0 or number + 1 == setting.trees):
            value = area(scored(forest, val, features)) or 0.0
            best, kept, stale = (value, len(forest.trees), 0) if value > best else (best, kept, stale + 1)
            if stale >= setting.patience:
                break
    if val is not None:
        forest.trees = forest.trees[:kept] if best >= 0 else forest.trees
    return forest


def scored(forest: Forest, rows: DataFrame, features: str = "f") -> DataFrame:
    """``rows`` with score; 0.5 without trees."""
    if not forest.trees:
        return rows.withColumn("score", F.lit(0.5))
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = forest.binned(_raw(b.columns[-1], b.num_rows))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sigmoid(forest.margins(x)))], names=schema.names)

    return rows.select("*", F.col(features).cast("array<double>").alias("__raw")).mapInArrow(run, schema)
