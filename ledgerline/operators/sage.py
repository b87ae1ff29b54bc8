"""Training of a neighbour-mean network (one or two layers and a linear head) over edge tables.

A layer is ReLU(mean of the neighbours . near + own . root + bias), as ``graph.sage_layer`` computes it. Means over
neighbours are joins and aggregations; their gradient is a sum over the same arcs, from each node to its neighbours, of what it
sends, divided by its number of neighbours. Dense algebra is numpy in tasks, on one row a node; the gradient of the
weights comes back as sums of the size of the network.

Defined results: a node without neighbours has a mean of 0; nodes without a label take part as neighbours only; without
labelled nodes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .graph import KEY, arcs
from .pin import Pins
from .training import Arrays, Setting, area, class_weight, descend, dropout, log_loss, parts, sigmoid, summed


def started(width: int, hidden: int, layers: int, rng: np.random.Generator) -> Arrays:
    if layers not in (1, 2):
        raise ValueError("one or two layers")
    out: Arrays = {}
    for i in range(layers):
        a = width if i == 0 else hidden
        out |= {f"near{i}": rng.normal(0, np.sqrt(1 / a), (a, hidden)), f"root{i}": rng.normal(0, np.sqrt(1 / a), (a, hidden)), f"bias{i}": np.zeros(hidden)}
    return out | {"w": rng.normal(0, np.sqrt(1 / hidden), hidden), "c": np.zeros(1)}


def over_arcs(arc: DataFrame, values: DataFrame, column: str, width: int, how=F.avg) -> DataFrame:
    """(snapshot_id, node, column): ``how`` of the arrays ``column`` of all neighbours, element by element."""
    met = arc.select(KEY, F.col("u").alias("node"), "v").join(values.select(KEY, F.col("node").alias("v"), column), [KEY, "v"])
    return met.groupBy(KEY, "node").agg(F.array(*[how(F.col(column)[i]) for i in range(width)]).alias(column))


def _matrix(column: pa.Array, n: int, width: int) -> np.ndarray:
    """Rows of an array column, zeros for null."""
    out = np.zeros((n, width))
    full = column.is_valid().to_numpy(zero_copy_only=False)
    if full.any():
        out[full] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _around(p: Arrays, b: pa.RecordBatch, width: int, hidden: int) -> tuple[np.ndarray, ...]:
    """near of a batch's nodes; of their neighbours, as rows hold them: the node's place, x, m, the bend of the first layer; their number."""
    n = b.num_rows
    near, held = _matrix(b.column("near"), n, hidden), b.column("around")
    values = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * width) if width else np.zeros((0, 0))
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(held), 0).to_numpy() // max(1, 2 * width))
    x, m = values[:, :width], values[:, width:]
    z = m @ p["near0"] + x @ p["root0"] + p["bias0"]
    count = np.bincount(row, minlength=n)
    for h in range(hidden):
        near[:, h] += np.bincount(row, np.maximum(z[:, h], 0), n) / np.maximum(count, 1)
    return near, row, x, m, z > 0, np.maximum(count, 1)


#: Numbers that a node's row holds of its neighbours, at most; nodes with more are met by joins in every epoch.
AROUND = 2048


class Graph:
    """Nodes with features, the means of their neighbours' features, and labels, stored once for all epochs."""

    def __init__(self, edges: DataFrame, x: DataFrame, y: DataFrame, column: str = "x"):
        ship(edges.sparkSession)
        self.pins = Pins(edges.sparkSession, "sage")
        self.arc = self.pins.put(arcs(edges).select(KEY, "u", "v"))
        own = self.pins.put(x.select(KEY, "node", F.col(column).cast("array<double>").alias("x")))
        first = own.select(F.size("x").alias("n")).first()
        self.width = first.n if first else 0
        mean = over_arcs(self.arc, own, "x", self.width).withColumnRenamed("x", "m") if self.width else own.limit(0).withColumnRenamed("x", "m")
        degree = self.arc.groupBy(KEY, F.col("u").alias("node")).agg(F.count("*").cast("double").alias("degree"))
        label = y.select(KEY, "node", F.col("y").cast("double").alias("y"))
        met = self.pins.put(own.join(mean, [KEY, "node"], "left"))
        degree = degree.withColumn("heavy", F.col("degree") * (2 * self.width) > AROUND)
        crowd = self.pins.put(degree.filter("heavy").select(KEY, F.col("node").alias("u")))
        self.heavy = None if crowd.isEmpty() else self.pins.put(self.arc.join(crowd, [KEY, "u"], "left_semi").select(KEY, "u", "v"))
        light = self.arc if self.heavy is None else self.arc.join(crowd, [KEY, "u"], "left_anti")
        none = F.array_repeat(F.lit(0.0), self.width)
        sent = met.select(KEY, F.col("node").alias("v"), F.concat("x", F.coalesce("m", none)).alias("xm"))
        around = light.select(KEY, F.col("u").alias("node"), "v").join(sent, [KEY, "v"]).groupBy(KEY, "node").agg(F.flatten(F.collect_list("xm")).alias("around"))
        nodes = met.join(degree, [KEY, "node"], "left").join(around, [KEY, "node"], "left").join(label, [KEY, "node"], "left")
        self.nodes = self.pins.put(nodes.withColumn("h", F.xxhash64(KEY, "node")))
        self.pins.drop(own, met)

    def _first(self, p: Arrays, hidden: int) -> DataFrame:
        """(snapshot_id, node, a): the first layer's output."""
        width, names = self.width, [KEY, "node", "a"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, m = (_matrix(b.column(c), b.num_rows, width) for c in ("x", "m"))
                    a = np.maximum(m @ p["near0"] + x @ p["root0"] + p["bias0"], 0)
                    yield pa.RecordBatch.from_arrays([b.column(KEY), b.column("node"), pa.array(list(a))], names=names)

        kinds = ", ".join(f"{c} {self.nodes.schema[c].dataType.simpleString()}" for c in (KEY, "node"))
        return self.nodes.select(KEY, "node", "x", "m").mapInArrow(run, f"{kinds}, a array<double>")

    def _met(self, p: Arrays, hidden: int, layers: int) -> DataFrame:
        """Nodes and, for two layers, near: the mean of a heavy node's neighbours' first outputs; other rows hold what it takes."""
        if layers == 1 or self.heavy is None:
            return self.nodes.withColumn("near", F.lit(None).cast("array<double>"))
        return self.nodes.join(over_arcs(self.heavy, self._first(p, hidden), "a", hidden).withColumnRenamed("a", "near"), [KEY, "node"], "left")

    def gradient(self, p: Arrays, layers: int, weight: float, setting: Setting, i: int = 0) -> tuple[np.ndarray, float]:
        """Gradient of the summed loss of labelled nodes as one flat array, and the loss."""
        flat, width, hidden = parts(p, ())[0], self.width, len(p["w"])
        kinds = ", ".join(f"{c} {self.nodes.schema[c].dataType.simpleString()}" for c in (KEY, "node"))

        def inward(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            x, m = (_matrix(b.column(c), b.num_rows, width) for c in ("x", "m"))
            z = m @ p["near0"] + x @ p["root0"] + p["bias0"]
            return x, m, z, np.maximum(z, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What each node hands down to its own first output and to its neighbours', then the sums."""
            total, lost = np.zeros(flat.size), 0.0
            names, last = [KEY, "node", "send", "g"], None
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                last = b
                x, m, z, a = inward(b)
                y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
                said, keep = np.isfinite(y), dropout(setting, b.column("h").to_numpy(), i)
                drop0, drop1 = keep("0", hidden), keep("1", hidden)
                if layers == 2:
                    near, row, x1, m1, bend1, count = _around(p, b, width, hidden)
                    a = a * drop0
                    z1 = near @ p["near1"] + a @ p["root1"] + p["bias1"]
                    top, bend, drop = np.maximum(z1, 0), z1 > 0, drop1
                else:
                    top, bend, drop = a, z > 0, drop0
                loss, dz = log_loss((top * drop) @ p["w"] + p["c"][0], np.where(said, y, 0.0), np.where(said, np.where(y > 0, weight, 1.0), 0.0))
                back = dz[:, None] * p["w"] * drop * bend
                out = {k: np.zeros_like(v) for k, v in p.items()}
                out |= {"w": (top * drop).T @ dz, "c": np.array([dz.sum()])}
                if layers == 2:
                    out |= {"near1": near.T @ back, "root1": a.T @ back, "bias1": back.sum(0)}
                    send, direct = back @ p["near1"].T, (back @ p["root1"].T) * drop0 * (z > 0)
                    to = (send / count[:, None])[row] * bend1
                    out |= {"near0": m.T @ direct + m1.T @ to, "root0": x.T @ direct + x1.T @ to, "bias0": direct.sum(0) + to.sum(0)}
                    heavy = np.flatnonzero(b.column("heavy").fill_null(False).to_numpy(zero_copy_only=False))
                    if len(heavy):
                        degree = b.column("degree").to_numpy(zero_copy_only=False).astype(float)[heavy]
                        who = [b.column(c).take(pa.array(heavy)) for c in (KEY, "node")]
                        yield pa.RecordBatch.from_arrays([*who, pa.array(list(send[heavy] / degree[:, None])), pa.nulls(len(heavy), pa.list_(pa.float64()))], names=names)
                else:
                    out |= {"near0": m.T @ back, "root0": x.T @ back, "bias0": back.sum(0)}
                total, lost = total + flat.pack(out), lost + loss
            if last is not None:
                empty = pa.nulls(1, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, last.column(KEY).type), pa.nulls(1, last.column("node").type), empty, pa.array([np.append(total, lost)])], names=names)

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(flat.size)
            for b in batches:
                if b.num_rows:
                    x, m, z, _ = inward(b)
                    back = _matrix(b.column("send"), b.num_rows, hidden) * (z > 0)
                    out = {k: np.zeros_like(v) for k, v in p.items()}
                    total += flat.pack(out | {"near0": m.T @ back, "root0": x.T @ back, "bias0": back.sum(0)})
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["g"])

        handed = self._met(p, hidden, layers).mapInArrow(run, f"{kinds}, send array<double>, g array<double>")
        if layers == 1 or self.heavy is None:
            sums = summed(handed, flat.size + 1)
            return sums[:-1], float(sums[-1])
        handed = self.pins.put(handed)
        sums = summed(handed.filter("g is not null"), flat.size + 1)
        turned = self.heavy.select(KEY, F.col("v").alias("u"), F.col("u").alias("v"))
        got = over_arcs(turned, handed.filter("g is null"), "send", hidden, F.sum)
        out = sums[:-1] + summed(self.nodes.select(KEY, "node", "x", "m").join(got, [KEY, "node"]).mapInArrow(down, "g array<double>"), flat.size)
        self.pins.drop(handed)
        return out, float(sums[-1])

    def scores(self, p: Arrays, layers: int) -> DataFrame:
        """(snapshot_id, node, y, score) of all nodes."""
        width, hidden, names = self.width, len(p["w"]), [KEY, "node", "y", "score"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, m = (_matrix(b.column(c), b.num_rows, width) for c in ("x", "m"))
                    a = np.maximum(m @ p["near0"] + x @ p["root0"] + p["bias0"], 0)
                    if layers == 2:
                        near = _around(p, b, width, hidden)[0]
                        a = np.maximum(near @ p["near1"] + a @ p["root1"] + p["bias1"], 0)
                    yield pa.RecordBatch.from_arrays([b.column(KEY), b.column("node"), b.column("y"), pa.array(sigmoid(a @ p["w"] + p["c"][0]))], names=names)

        kinds = ", ".join(f"{c} {self.nodes.schema[c].dataType.simpleString()}" for c in (KEY, "node"))
        return self._met(p, hidden, layers).mapInArrow(run, f"{kinds}, y double, score double")


def sage_scores(edges: DataFrame, x: DataFrame, y: DataFrame, setting: Setting, hidden: int = 16, layers: int = 2, val: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(snapshot_id, node, y, score) of all nodes of ``x`` (snapshot_id, node, x), trained on the labelled ones of ``y`` (snapshot_id, node, y).

    With ``val`` (snapshot_id, node, y) training stops by the area under precision and recall there. Features are
    standardised by all nodes.
    """
    size = x.select(F.size("x").alias("n")).first()
    width = size.n if size else 0
    stats = x.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if width else None
    unit = x.select(KEY, "node", F.array(*[(F.col("x")[i] - stats[f"m{i}"]) / F.lit(stats[f"s{i}"] or 1.0) for i in range(width)]).cast("array<double>").alias("x"))
    graph = Graph(edges, unit, y)
    counted = graph.nodes.filter("y is not null").agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p")).first()
    if not counted.n:
        return graph.nodes.select(KEY, "node", "y").withColumn("score", F.lit(0.5))
    weight = class_weight(setting, counted.n, counted.p)
    begun = started(width, hidden, layers, np.random.default_rng(setting.seed))
    epoch = lambda i, p: (graph.gradient(p, layers, weight, setting, i)[0] / counted.n, np.empty(0))
    judge = None if val is None else lambda p: area(graph.scores(p, layers).drop("y").join(val.select(KEY, "node", "y"), [KEY, "node"]))
    return graph.scores(descend(edges.sparkSession, begun, epoch, judge, setting, path), layers)
