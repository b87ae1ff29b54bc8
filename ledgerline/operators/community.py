"""Communities of snapshot graphs: connected components, or capped Louvain by parallel moves."""

from __future__ import annotations

import logging
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .graph import KEY, arcs, nodes, within
from .pin import Pins, pinned

log = logging.getLogger(__name__)
#: Rounds without fewer moves after which a level of local moves ends.
PATIENCE = 6
#: A level ends when two rounds together move no more than one node in FEW.
FEW = 400
#: Arcs (an edge has two) of the nodes that a task settles by itself; larger snapshots are many tasks.
BLOCK = 1_000_000
#: Blocks that a snapshot may have to be taken through all its levels by one task.
WHOLE = 4
#: Orders of its nodes that a task tries; one where a task takes a snapshot of more arcs than MANY, whose orders differ little.
TRIES, MANY = 4, 200_000


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(snapshot_id, node, community): the smallest node that edges reach, by label propagation with
    pointer jumping; each round's labels are checkpointed, so lineage stays short and rounds few."""
    near = pinned(arcs(edges).select(KEY, F.col("u").alias("node"), F.col("v").alias("other")))
    now = pinned(nodes(edges).withColumn("community", F.col("node")))
    for _ in range(max_rounds):
        heard = near.join(now.select(KEY, F.col("node").alias("other"), "community"), [KEY, "other"]).groupBy(KEY, "node").agg(F.min("community").alias("heard"))
        moved = now.join(heard, [KEY, "node"]).select(KEY, "node", F.least("community", "heard").alias("mid"))
        onward = now.select(KEY, F.col("node").alias("mid"), F.col("community").alias("onward"))
        after = pinned(moved.join(onward, [KEY, "mid"]).select(KEY, "node", F.least("mid", "onward").alias("community")))
        changed = after.join(now.withColumnRenamed("community", "before"), [KEY, "node"]).filter("community <> before").limit(1).count()
        now = after
        if not changed:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _pairs(edges: DataFrame, parallel: bool) -> DataFrame:
    """(snapshot_id, a, b, w): undirected pairs; of a reciprocal pair one direction's weight counts, or with ``parallel`` all."""
    weight = F.sum("weight") if parallel else F.max_by("weight", "src")
    own = edges.filter("src <> dst").select(KEY, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", F.col("weight").cast("double").alias("weight"))
    return own.groupBy(KEY, "a", "b").agg(weight.alias("w"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    ends = [F.struct(F.col(u).alias("node"), F.col(v).alias("v"), "w") for u, v in (("a", "b"), ("b", "a"))]
    return pairs.select(KEY, F.explode(F.array(*ends)).alias("e")).select(KEY, "e.*")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 10.0, parallel: bool = False) -> DataFrame:
    """(snapshot_id, modularity) of the undirected graphs of ``edges`` under (snapshot_id, node, community)."""
    arc = _both_ways(_pairs(edges, parallel))
    home = communities.select(KEY, "node", "community")
    met = arc.join(home, [KEY, "node"]).join(home.select(KEY, F.col("node").alias("v"), F.col("community").alias("other")), [KEY, "v"])
    by = met.groupBy(KEY, "community").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inner"))
    size = F.sum("tot")
    return by.groupBy(KEY).agg((F.sum("inner") / size - resolution * F.sum(F.col("tot") * F.col("tot")) / (size * size)).alias("modularity"))


def _moves(resolution: float, seed: int):
    """(node, v, w and what is known of both ends) of a block -> (snapshot_id, node, k, m2, com, moved): its nodes go, one after
    another, where the gain is largest, until none gains; nodes whose neighbours went are looked at again. The best of TRIES
    orders counts.

    Nodes of other blocks stay where they are. Where there are any, only those with ``turn`` may move, in one order, and two
    lone nodes go towards the smaller name only, as the other one may move as well.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "v"], ignore_index=True)
        split, first = bool(pdf["blocks"].iloc[0] > 1), ~pdf["node"].duplicated().to_numpy()
        own, start = pdf[first], [*np.flatnonzero(first).tolist(), len(pdf)]
        codes, names = pd.factorize(pd.concat([own["com"], pdf["vcom"]]), sort=True)
        size, tot, n = len(own), np.zeros(len(names)), np.zeros(len(names), np.int64)
        tot[codes], n[codes] = np.concatenate([own["tot"], pdf["vtot"]]), np.concatenate([own["n"], pdf["vn"]])
        start_home, there, start_tot, start_n = codes[:size].tolist(), codes[size:].tolist(), tot.tolist(), n.tolist()  # plain lists: read a number at a time
        place = pd.Index(own["node"]).get_indexer(pdf["v"]).tolist()  # -1: in another block
        w, k, scale = pdf["w"].tolist(), own["k"].tolist(), resolution / own["m2"].iloc[0]
        waiting = own["turn"].to_numpy(bool) if split else np.ones(size, bool)
        free = waiting.tolist()

        def settled(order: list[int]) -> tuple[float, list[int]]:
            """What the block's share of the modularity is in proportion to, and every node's community."""
            home, tot, n, waiting, queue = start_home.copy(), start_tot.copy(), start_n.copy(), free.copy(), deque(i for i in order if free[i])
            while queue:
                i = queue.popleft()
                waiting[i] = False
                mine, arcs_, links = home[i], range(start[i], start[i + 1]), {}
                for e in arcs_:
                    c = home[place[e]] if place[e] >= 0 else there[e]
                    links[c] = links.get(c, 0.0) + w[e]
                tot[mine] -= k[i]
                pull = scale * k[i]
                best, gain = mine, links.get(mine, 0.0) - pull * tot[mine]
                for c, x in links.items():
                    if x - pull * tot[c] > gain + 1e-12 and (not split or n[mine] > 1 or n[c] > 1 or c < mine):
                        best, gain = c, x - pull * tot[c]
                tot[best] += k[i]
                if best != mine:
                    home[i], n[mine], n[best] = best, n[mine] - 1, n[best] + 1
                    for j in (place[e] for e in arcs_):
                        if j >= 0 and free[j] and not waiting[j] and home[j] != best:
                            waiting[j] = True
                            queue.append(j)
            inner = sum(w[e] for i in range(size) for e in range(start[i], start[i + 1]) if place[e] >= 0 and home[place[e]] == home[i])
            return inner - scale * sum(t * t for t in tot), home

        rng = np.random.default_rng(seed)
        tries = [settled(rng.permutation(size).tolist()) for _ in range(1 if split else TRIES)]
        home = np.array(max(tries, key=lambda t: t[0])[1])
        return own[[KEY, "node", "k", "m2"]].assign(com=names[home], moved=home != codes[:size])

    return run


def _settle(pins: Pins, arc: DataFrame, strength: DataFrame, resolution: float, seed: int, sweeps: int, label: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, node, k, m2, com, tot, n): one level of local moves from nodes that are each a community, or from ``label``.

    A snapshot's nodes are dealt into blocks of about BLOCK arcs, drawn by a hash. A round joins the communities of both ends
    to the arcs and settles every block in a task of its own. A snapshot of one block is done by then; with more blocks a
    half of the nodes may move in a round, and rounds end when few move or, as parallel moves may go to and fro, when they do
    not get fewer.
    """
    if label is None:
        now = strength.select(KEY, "node", "k", "m2", F.col("node").alias("com"), F.col("k").alias("tot"), F.lit(1).cast("long").alias("n"))
    else:
        now = strength.select(KEY, "node", "k", "m2").join(label.select(KEY, "node", F.col("community").alias("com")), [KEY, "node"])
        now = now.join(now.groupBy(KEY, "com").agg(F.sum("k").alias("tot"), F.count("*").alias("n")), [KEY, "com"]).select(KEY, "node", "k", "m2", "com", "tot", "n")
    now = pins.put(now)
    dealt = pins.put(arc.groupBy(KEY).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")))
    seen = dealt.agg(F.sum("blocks").alias("all"), F.sum(F.when(F.col("blocks") > 1, F.col("blocks"))).alias("many")).first()
    if not seen.all:
        return now
    types = dict(now.dtypes)
    schema = f"{KEY} {types[KEY]}, node {types['node']}, k double, m2 double, com {types['com']}, moved boolean"
    nodes_, last, fewest, since = 0, 0, None, 0
    for sweep in range(sweeps):
        mine = arc.join(dealt if not sweep else dealt.filter("blocks > 1"), KEY).join(now, [KEY, "node"])
        met = mine.join(now.select(KEY, F.col("node").alias("v"), F.col("com").alias("vcom"), F.col("tot").alias("vtot"), F.col("n").alias("vn")), [KEY, "v"])
        met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("turn", F.xxhash64(F.lit(seed), F.lit(sweep), "node").bitwiseAND(F.lit(1)) == 0)
        tasks = min(20_000, 2 * (seen.many if sweep else seen.all) + 8)
        placed = pins.put(met.repartition(tasks, KEY, "block").groupBy(KEY, "block").applyInPandas(_moves(resolution, seed + sweep), schema))
        totals = placed.groupBy(KEY, "com").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        after = placed.join(totals, [KEY, "com"]).select(KEY, "node", "k", "m2", "com", "tot", "n")
        if sweep:
            after = after.unionByName(now.join(dealt.filter("blocks > 1"), KEY, "left_anti"))
        after = pins.put(after)
        count = placed.join(dealt.filter("blocks > 1"), KEY, "left_semi").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first() if seen.many else None
        pins.drop(now, placed)
        now = after
        if not seen.many:
            return now
        nodes_, moved = count.n, count.moved
        log.debug("louvain: sweep %d moved %d of %d nodes in snapshots of many blocks", sweep, moved, nodes_)
        if last + moved <= nodes_ // FEW and sweep:
            return now
        fewest, since = (moved, 0) if fewest is None or moved < fewest else (fewest, since + 1)
        if since >= PATIENCE:
            return now
        last = moved
    log.warning("louvain: a level of %d nodes was cut off after %d sweeps", nodes_, sweeps)
    return now


def _ordered(start: list[int], to: list[int], w: list[float], k: list[float], scale: float, home: list[int], order: list[int]) -> list[int]:
    """Every node's community when nodes went, one after another, where the gain is largest, until none gained."""
    home, tot, waiting, queue = home.copy(), [0.0] * (max(home) + 1), bytearray(b"\1" * len(home)), deque(order)
    for c, x in zip(home, k, strict=True):
        tot[c] += x
    while queue:
        i = queue.popleft()
        waiting[i] = 0
        mine, near, links, own = home[i], to[start[i] : start[i + 1]], {}, k[i]
        for j, x in zip(near, w[start[i] : start[i + 1]], strict=True):
            c = home[j]
            links[c] = links.get(c, 0.0) + x
        tot[mine] -= own
        pull = scale * own
        best, gain = mine, links.get(mine, 0.0) - pull * tot[mine]
        for c, x in links.items():
            if x - pull * tot[c] > gain + 1e-12:
                best, gain = c, x - pull * tot[c]
        tot[best] += own
        if best != mine:
            home[i] = best
            for j in near:
                if not waiting[j] and home[j] != best:
                    waiting[j] = 1
                    queue.append(j)
    return home


def _gone(src: np.ndarray, to: np.ndarray, w: np.ndarray, k: np.ndarray, scale: float, home: np.ndarray, seed: int) -> np.ndarray:
    """Communities after moves in the best of TRIES orders, or in one for more than MANY arcs. Arcs are sorted by ``src``."""
    start, rng, best = np.searchsorted(src, np.arange(len(k) + 1)).tolist(), np.random.default_rng(seed), None
    lists = (start, to.tolist(), [float(w[0])] * len(w) if len(w) and (w == w[0]).all() else w.tolist(), k.tolist())
    for _ in range(TRIES if len(src) <= MANY else 1):
        found = np.array(_ordered(*lists, scale, home.tolist(), rng.permutation(len(k)).tolist()))
        tot = np.bincount(found, k)
        value = w[found[src] == found[to]].sum() - scale * (tot * tot).sum()
        if best is None or value > best[0]:
            best = value, found
    return best[1]


def _whole(resolution: float, seed: int, max_level: int | None, threshold: float):
    """(snapshot_id, a, b, w), the pairs of a snapshot -> (snapshot_id, node, community): all levels, as ``louvain_communities`` has them."""

    def run(pairs: pa.Table) -> pa.Table:
        n = pairs.num_rows
        code, names = pd.factorize(pd.concat([pairs["a"].to_pandas(), pairs["b"].to_pandas()], ignore_index=True), sort=True)
        src, to = code, np.concatenate([code[n:], code[:n]])
        order = np.lexsort((to, src))
        src, to, w = src[order], to[order], np.tile(pairs["w"].to_numpy(), 2)[order]
        k = np.bincount(src, w)
        m2, label, level = k.sum(), np.arange(len(k)), 0
        scale, before, every = resolution / m2, -resolution * (k * k).sum() / m2**2, (src, to, w, k)
        while max_level is None or level < max_level:
            found, home = np.unique(_gone(src, to, w, k, scale, np.arange(len(k)), seed + level), return_inverse=True)
            met = home[src] != home[to]
            link, at = np.unique(home[src[met]] * len(found) + home[to[met]], return_inverse=True)
            w, k, level = np.bincount(at, w[met], len(link)), np.bincount(home, k), level + 1
            src, to = link // len(found), link % len(found)
            after = 1 - w.sum() / m2 - resolution * (k * k).sum() / m2**2
            label = home[label] if after > before else label
            if after - before <= threshold:
                break
            before = after
        if max_level is None:
            label = _gone(*every, scale, label, seed + level)
        node, key = pairs.schema.field("a"), pairs.schema.field(KEY)
        community = np.asarray(names)[np.unique(label, return_index=True)[1]][np.unique(label, return_inverse=True)[1]]
        held = pairs[KEY].slice(0, 1).to_pylist() * len(label)
        return pa.table([pa.array(held, key.type), pa.array(np.asarray(names), node.type), pa.array(community, node.type)], names=[KEY, "node", "community"])

    return run


def louvain_communities(
    edges: DataFrame, resolution: float = 10.0, seed: int = 1997, sweeps: int = 1000, max_level: int | None = None, parallel: bool = False, threshold: float = 1e-7
) -> DataFrame:
    """(snapshot_id, node, community) of all snapshots at once, named by the smallest node.

    Levels of local moves over edge tables, each followed by a contraction of communities to nodes; a level counts
    for the snapshots whose modularity it raises, and those that it raises by more than ``threshold`` go on. When the levels
    end by themselves, single nodes move once more between the final communities, which only raises modularity.
    ``sweeps`` caps the rounds of a level, which is logged, ``max_level`` (None: no cap) the levels. A snapshot of at most WHOLE
    blocks is taken through all levels by one task; of a larger one a task settles about BLOCK arcs. Of a reciprocal pair one direction's weight counts; with ``parallel`` the weights of
    all edges between two nodes add up, as in a multigraph.
    """
    if max_level is not None and max_level <= 0:
        raise ValueError("max_level must be positive or None")
    ship(edges.sparkSession)
    pins, types = Pins(edges.sparkSession, "louvain"), dict(edges.dtypes)
    pairs = pins.put(_pairs(edges, parallel))
    size = pins.put(pairs.groupBy(KEY).agg((2 * F.count("*") > WHOLE * BLOCK).alias("many")))
    seen = size.agg(F.count("*").alias("all"), F.count_if("many").alias("many")).first()
    label = nodes(edges).withColumn("community", F.col("node"))
    own = pairs.join(size.filter("not many"), KEY, "left_semi") if seen.many else pairs
    own = own.repartition(min(20_000, 8 * seen.all + 8), KEY).groupBy(KEY)  # so many that snapshots seldom share a task
    found = own.applyInArrow(_whole(resolution, seed, max_level, threshold), f"{KEY} {types[KEY]}, node {types['src']}, community {types['src']}")
    if seen.many:
        large = size.filter("many")
        found = found.unionByName(_apart(pins, pairs.join(large, KEY, "left_semi"), label.join(large, KEY, "left_semi"), resolution, seed, sweeps, max_level, threshold))
    home = pins.put(found).withColumnRenamed("community", "com")
    label = label.join(home, [KEY, "node"], "left").select(KEY, "node", F.coalesce("com", "community").alias("community"))
    first = label.groupBy(KEY, "community").agg(F.min("node").alias("first"))
    return label.join(first, [KEY, "community"]).select(KEY, "node", F.col("first").alias("community"))


def _apart(pins: Pins, pairs: DataFrame, own: DataFrame, resolution: float, seed: int, sweeps: int, max_level: int | None, threshold: float) -> DataFrame:
    """(snapshot_id, node, community) of snapshots that are many tasks each, ``own`` their nodes' first communities."""
    arc = pins.put(_both_ways(pairs))
    label = pins.put(own)
    strength = arc.groupBy(KEY, "node").agg(F.sum("w").alias("k"))
    strength = pins.put(strength.join(arc.groupBy(KEY).agg(F.sum("w").alias("m2")), KEY))
    quality = pins.put(strength.groupBy(KEY).agg((-resolution * F.sum(F.col("k") * F.col("k")) / F.pow(F.first("m2"), 2)).alias("before")))
    level, every = 0, (arc, strength)
    while (max_level is None or level < max_level) and not strength.isEmpty():
        home = _settle(pins, arc, strength, resolution, seed + level, sweeps)
        ends = arc.join(home.select(KEY, "node", "com"), [KEY, "node"]).join(home.select(KEY, F.col("node").alias("v"), F.col("com").alias("other")), [KEY, "v"])
        joined = pins.put(ends.filter("com <> other").groupBy(KEY, F.col("com").alias("node"), F.col("other").alias("v")).agg(F.sum("w").alias("w")))
        held = home.groupBy(KEY, "com").agg(F.first("tot").alias("k"), F.first("m2").alias("m2"))
        cross = joined.groupBy(KEY).agg(F.sum("w").alias("cross"))
        spread = held.groupBy(KEY).agg(F.sum(F.col("k") * F.col("k")).alias("squares"), F.first("m2").alias("m2")).join(cross, KEY, "left")
        # nodes that an earlier level left alone in a community without links to others are not in ``held``
        after = 1 - F.coalesce("cross", F.lit(0.0)) / F.col("m2") - resolution * (F.col("squares") + F.coalesce("alone", F.lit(0.0))) / F.pow("m2", 2)
        lone = strength.join(home.select(KEY, "node"), [KEY, "node"], "left_anti").groupBy(KEY).agg(F.sum(F.col("k") * F.col("k")).alias("alone"))
        judged = pins.put(spread.join(lone, KEY, "left").select(KEY, after.alias("after")).join(quality, KEY))
        raised = judged.filter("after > before").select(KEY)
        taken = home.join(raised, KEY, "left_semi").select(KEY, F.col("node").alias("community"), "com")
        renamed = pins.put(label.join(taken, [KEY, "community"], "left").select(KEY, "node", F.coalesce("com", "community").alias("community")))
        on = judged.filter(F.col("after") - F.col("before") > threshold).select(KEY)
        lone = strength.join(home.select(KEY, "node"), [KEY, "node"], "left_anti").select(KEY, "node", "k", "m2")
        fresh = pins.put(held.withColumnRenamed("com", "node").unionByName(lone).join(on, KEY, "left_semi"))
        onward = pins.put(joined.join(on, KEY, "left_semi"))
        better = pins.put(judged.join(on, KEY, "left_semi").select(KEY, F.col("after").alias("before")))
        pins.drop(label, quality, home, joined, judged, *((arc, strength) if level else ()))
        arc, label, strength, quality, level = onward, renamed, fresh, better, level + 1
    if max_level is None:
        home = _settle(pins, *every, resolution, seed + level, sweeps, label).select(KEY, "node", "com")
        label = pins.put(label.join(home, [KEY, "node"], "left").select(KEY, "node", F.coalesce("com", "community").alias("community")))
    return label


def prune(edges: DataFrame, method: str = "louvain", **options) -> DataFrame:
    """Edges inside communities by ``method``: none, components or louvain."""
    if method == "none":
        return edges
    if method not in ("components", "louvain"):
        raise ValueError(f"unknown method {method!r}: use none, components or louvain")
    return within(edges, components(edges) if method == "components" else louvain_communities(edges, **options))
