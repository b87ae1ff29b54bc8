"""Snapshot graphs as edge tables keyed by snapshot_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "snapshot_id"


def reverse(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def arcs(edges: DataFrame) -> DataFrame:
    """(snapshot_id, u, v, ahead, back): both directions of every edge once, and which of them exist."""
    both = edges.select(KEY, F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(True).alias("ahead")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(False).alias("ahead")))).alias("a"))
    return both.groupBy(KEY, F.col("a.u").alias("u"), F.col("a.v").alias("v")).agg(F.max("a.ahead").alias("ahead"), F.max(~F.col("a.ahead")).alias("back"))


def undirected(edges: DataFrame) -> DataFrame:
    """(snapshot_id, a, b): distinct unordered pairs, a < b."""
    return edges.select(KEY, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """In plus out: a reciprocal pair counts twice. With ``weight``, its sum."""
    ends = edges.select(KEY, F.explode(F.array("src", "dst")).alias("node"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    return ends.groupBy(KEY, "node").agg(F.sum("w").alias("degree"))


def neighbour_degrees(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Distinct neighbours either way, and log1p of their number; 0 for ``seeds`` without an edge."""
    found = arcs(edges).groupBy(KEY, F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    if seeds is not None:
        found = seeds.select(KEY, "node").distinct().join(found, [KEY, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return found.withColumn("log_degree", F.log1p("degree"))


def _without(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    cut = edges
    for end in ("src", "dst"):
        cut = cut.join(hubs.select(KEY, F.col("node").alias(end)), [KEY, end], "left_anti")
    return cut.select(*edges.columns)


def prune_hubs(edges: DataFrame, cutoff: int = 10) -> DataFrame:
    """Edges between nodes of a degree under ``cutoff``."""
    return _without(edges, degrees(edges).filter(F.col("degree") >= cutoff))


def prune_top(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """Edges between nodes of a degree under its (1 - share) quantile in the snapshot (exact, interpolated)."""
    counted = degrees(edges)
    limits = counted.groupBy(KEY).agg(F.percentile("degree", F.lit(1 - share)).alias("limit"))
    return _without(edges, counted.join(limits, KEY).filter("degree >= limit"))


def within(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges whose ends share a community of (snapshot_id, node, community)."""
    a = communities.select(KEY, F.col("node").alias("src"), F.col("community").alias("ca"))
    b = communities.select(KEY, F.col("node").alias("dst"), F.col("community").alias("cb"))
    return edges.join(a, [KEY, "src"]).join(b, [KEY, "dst"]).filter("ca = cb").select(*edges.columns)


def neighbour_means(edges: DataFrame, x: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of the neighbours' ``columns`` (either way), 0 without a neighbour: one aggregation hop."""
    near = arcs(edges).join(x.select(KEY, F.col("node").alias("v"), *columns), [KEY, "v"])
    means = near.groupBy(KEY, F.col("u").alias("node")).agg(*[F.avg(c).alias(c) for c in columns])
    own = x.select(KEY, "node").join(means, [KEY, "node"], "left")
    return own.select(KEY, "node", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def sage_layer(edges: DataFrame, x: DataFrame, columns: list[str], near: list[list[float]], root: list[list[float]], bias: list[float]) -> DataFrame:
    """ReLU(near . mean of neighbours + root . own + bias), columns h0, h1, ..."""
    mean = neighbour_means(edges, x, columns).withColumnsRenamed({c: f"{c}__near" for c in columns})
    both = x.join(mean, [KEY, "node"])
    dot = lambda w, names: sum((F.lit(float(k)) * F.col(n) for k, n in zip(w, names, strict=True)), F.lit(0.0))
    outs = [F.greatest(dot(near[i], [f"{c}__near" for c in columns]) + dot(root[i], columns) + F.lit(float(bias[i])), F.lit(0.0)).alias(f"h{i}") for i in range(len(bias))]
    return both.select(KEY, "node", *outs)


def band_graph(edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The disjoint union of the snapshots that ``rows`` (snapshot_id, node, ...) need, and its nodes'
    degrees; nodes of different snapshots stay apart by their key."""
    own = edges.join(rows.select(KEY).distinct(), KEY, "left_semi")
    everyone = nodes(own).unionByName(rows.select(KEY, "node")).distinct()
    return own, neighbour_degrees(own, everyone)


def ego_styles(edges: DataFrame, ego: object) -> tuple[DataFrame, DataFrame]:
    """Colours of an ego picture: the ego magenta, its neighbours white, others cyan; its edges magenta."""
    near = arcs(edges).filter(F.col("u") == ego).select(KEY, F.col("v").alias("node")).withColumn("near", F.lit(True))
    dots = nodes(edges).join(near, [KEY, "node"], "left").select(KEY, "node", F.when(F.col("node") == ego, "magenta").when(F.col("near"), "white").otherwise("cyan").alias("color"))
    lines = edges.select(KEY, "src", "dst", F.when((F.col("src") == ego) | (F.col("dst") == ego), "magenta").otherwise("black").alias("color"))
    return dots, lines
