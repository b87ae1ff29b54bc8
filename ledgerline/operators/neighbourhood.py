"""The 3 x 3 block description of every node's two-hop neighbourhood.

Roles of the nodes in an ego's ball: 1 for neighbours; 2 for nodes two directed steps out or in; 0 for
the ego and for two-hop nodes that only a change of direction reaches. Every node sends its list of neighbours to
its neighbours, once, in arrays; there the roles are settled. Edges with both ends in a ball are summed where
groups of balls and groups of edges meet. Block
statistics cover the dense block, its zero cells included, from sums over its edges alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCKS, FEATURES, STATS, VALUES
from ..ship import ship
from . import hubs, windows
from .graph import KEY, arcs
from .pin import Pins, pinned

EGO, NEAR, DIRECTED, TURNED = 0, 1, 2, 3
ORDERS = ["min", "median", "iqr"]
#: Rows that a task of the ball's exchanges takes; their number grows with the rows, whatever the session's setting.
ROWS = 500_000
#: Members of balls, and edges, that a task of the block sums takes; edges of balls that it looks at together.
IDS, EDGES, LOOKS = 4_000_000, 2_000_000, 1 << 19
#: Second steps of all balls, and of an arc on average, from which no lists of members are exchanged (see ``thick``); edges of a
#: snapshot that a task may hold then; pairs of balls and edges of a task, and the most tasks that a snapshot's edges go to.
PATHS, MEAN, HELD, WORK, COPIES = 5_000_000, 32, 8_000_000, 2_000_000_000, 32


def lists(edges: DataFrame, pins: Pins, *values: str) -> tuple[DataFrame, int]:
    """(snapshot_id, via, ins, outs, es): each node's sources, targets and edges; and the tasks for what neighbours are sent."""
    turned = lambda u, v, ahead: F.struct(F.col(u).alias("via"), F.col(v).alias("other"), F.lit(ahead).alias("ahead"))
    each = edges.select(KEY, F.explode(F.array(turned("src", "dst", True), turned("dst", "src", False))).alias("t"), *values).select(KEY, "t.*", *values)
    ends = [F.collect_set(F.when(c, F.col("other"))).alias(n) for n, c in (("ins", ~F.col("ahead")), ("outs", F.col("ahead")))]
    held = pins.put(each.groupBy(KEY, "via").agg(*ends, F.collect_list(F.struct("other", "ahead", *values)).alias("es")))
    sent = held.agg(F.sum((1 + F.size(F.array_union("ins", "outs"))) * F.size("es"))).first()[0] or 0
    return held, max(1, -(-sent // ROWS), min(8, sent // 1000))


def sent(held: DataFrame, tasks: int, *values: str) -> DataFrame:
    """(snapshot_id, ego, other, mine, p, ahead, values): edges of the egos (mine 0) and of their neighbours (mine 1) but those to the ego.

    p is the priority of the other end by this edge. All rows of an ego are in one task.
    """
    others = F.concat(F.array("via"), F.array_except(F.array_union("ins", "outs"), F.array("via")))
    out = held.select(KEY, "via", F.explode(others).alias("ego"), "ins", "outs", "es")
    mine = (F.col("ego") != F.col("via")).cast("int").alias("mine")
    a, b = F.array_contains("ins", F.col("ego")).alias("a"), F.array_contains("outs", F.col("ego")).alias("b")  # to via, from via
    out = out.select(KEY, "ego", mine, a, b, *[F.col(f"es.{c}").alias(c) for c in ("other", "ahead", *values)]).repartition(tasks, KEY, "ego")
    out = out.select(KEY, "ego", "mine", "a", "b", F.inline(F.arrays_zip("other", "ahead", *values))).filter("other <> ego")
    straight = (F.col("a") & F.col("ahead")) | (F.col("b") & ~F.col("ahead"))
    p = F.when(F.col("mine") == 0, NEAR).when(straight, DIRECTED).otherwise(TURNED)
    return out.select(KEY, "ego", "other", "mine", p.alias("p"), "ahead", *values)


def role(p: Column) -> Column:
    return F.when(p == NEAR, 1).when(p == DIRECTED, 2).otherwise(0)


def balls(edges: DataFrame, egos: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> tuple[DataFrame, DataFrame, bool]:
    """(snapshot_id, ego, n0, n1, n2) of every ego, what ``work`` makes of the tiles, and whether a ball's edges may lie in several.

    Balls are found from lists of names alone. Then tiles of balls and edges meet: a snapshot's balls are dealt by a hash into
    groups of about IDS members, its edges into groups of about EDGES, and every two groups are a task.
    """
    ship(edges.sparkSession)
    pins = Pins(edges.sparkSession, "ball")
    held, tasks = lists(edges, pins)
    found = sent(held, tasks).groupBy(KEY, "ego", "other").agg(F.min("p").alias("p")).withColumn("role", role(F.col("p")))
    own = [F.collect_list(F.when(F.col("role") == k, F.col("other"))).alias(f"t{k}") for k in range(3)]
    ball = egos.select(KEY, F.col("node").alias("ego")).join(found.groupBy(KEY, "ego").agg(*own), [KEY, "ego"], "left")
    none = F.array().cast(dict(ball.dtypes)["t0"])
    lists_ = [F.coalesce("t0", none)] + [F.coalesce(f"t{k}", none).alias(f"t{k}") for k in (1, 2)]
    ball = ball.select(KEY, "ego", F.concat(F.array("ego"), lists_[0]).alias("t0"), *lists_[1:])
    ball = pins.put(ball.select("*", *[F.size(f"t{k}").cast("long").alias(f"n{k}") for k in range(3)]))
    parts = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    dealt = ball.groupBy(KEY).agg(parts(F.sum(F.col("n0") + F.col("n1") + F.col("n2")), IDS).alias("of_balls"))
    dealt = dealt.join(edges.groupBy(KEY).agg(parts(F.count("*"), EDGES).alias("of_edges")), KEY, "left")
    dealt = pins.put(dealt.withColumn("of_edges", F.coalesce("of_edges", F.lit(1))))
    seen = dealt.agg(F.sum(F.col("of_balls") * F.col("of_edges")).alias("tiles"), F.max("of_edges").alias("most")).first()
    tasks, tile = min(20_000, 2 * (seen.tiles or 0) + 8), [KEY, "a", "b"]
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = ball.join(dealt, KEY).select(KEY, F.pmod(F.xxhash64("ego"), "of_balls").cast("int").alias("a"), numbers("of_edges").alias("b"), "ego", "t0", "t1", "t2")
    right = edges.join(dealt, KEY).select(KEY, F.pmod(F.xxhash64("src", "dst"), "of_edges").cast("int").alias("b"), numbers("of_balls").alias("a"), "src", "dst", *[F.col(v).cast("double").alias(v) for v in ("weight", *VALUES)])
    left, right = (df.repartition(tasks, *tile).groupBy(*tile) for df in (left, right))
    return ball.select(KEY, "ego", "n0", "n1", "n2"), left.cogroup(right).applyInArrow(work, schema), (seen.most or 0) > 1


def _inside(left: pa.Table, right: pa.Table, names: list[str]) -> Iterator[tuple[int, int, np.ndarray, dict[str, np.ndarray]]]:
    """Of a tile's balls (ego, t0, t1, t2) and edges, some balls at a time: (from, to, block of each edge inside, the edges' values).

    A ball has nine blocks, numbered from its place among these balls.
    """
    ends = pc.unique(pa.chunked_array([*right["src"].chunks, *right["dst"].chunks]))
    codes = lambda c: pc.fill_null(pc.index_in(c, value_set=ends), -1).to_numpy(zero_copy_only=False)
    src, dst = codes(right["src"].combine_chunks()), codes(right["dst"].combine_chunks())
    order, count = np.argsort(src, kind="stable"), max(1, len(ends))
    dst, values = dst[order], {v: right[v].to_numpy()[order] for v in names}
    start = np.searchsorted(src[order], np.arange(count + 1))
    key, mine = [], []
    for k in range(3):
        each = left[f"t{k}"].combine_chunks()
        code = codes(each.flatten())
        met = code >= 0
        key.append(np.repeat(np.arange(left.num_rows), pc.list_value_length(each).to_numpy())[met] * count + code[met])
        mine.append(np.full(met.sum(), k, np.int8))
    key, mine = np.concatenate(key), np.concatenate(mine)
    by_key = np.argsort(key)
    key, mine = key[by_key], mine[by_key]  # members by ball and node: they are looked up here, so memory follows them alone
    node = key % count
    ahead = start[node + 1] - start[node]
    first = np.searchsorted(key, np.arange(left.num_rows + 1) * count)
    steps = np.concatenate(([0], np.cumsum(ahead)))[first]  # edges to look at before each ego
    low = 0
    while low < left.num_rows:
        high = int(np.searchsorted(steps, steps[low] + LOOKS, "right")) - 1
        high = min(max(high, low + 1), low + 7000, left.num_rows)
        of = slice(first[low], first[high])
        own, n = key[of], ahead[of]
        edge = np.arange(n.sum()) + np.repeat(start[node[of]] - np.cumsum(n) + n, n)
        asked = np.repeat(own - node[of], n) + dst[edge]
        at = np.searchsorted(own, asked)
        inside = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == asked) if len(own) else np.empty(0, np.int64)
        edge, ball = edge[inside], asked[inside] // count - low
        block = (ball * 9 + np.repeat(mine[of], n)[inside] * 3 + mine[of][at[inside]]).astype(np.uint16)
        yield low, high, block, {v: x[edge] for v, x in values.items()}
        low = high


def _sums_of_tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """(snapshot_id, ego, n0, n1, n2, blocks): each ball's blocks with an edge and their sums over a tile's edges."""
    entry = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("nnz", pa.int64()), *[(c, pa.float64()) for c in NAMES[1:]]])
    schema = pa.schema([left.schema.field(KEY), left.schema.field("ego"), *[(f"n{k}", pa.int64()) for k in range(3)], ("blocks", pa.list_(entry))])
    out = []
    for low, high, block, values in _inside(left, right, ["weight", *VALUES]) if left.num_rows else ():
        by_block = np.argsort(block, kind="stable")
        block, values = block[by_block], {v: x[by_block] for v, x in values.items()}
        nnz = np.bincount(block, minlength=(high - low) * 9)
        kept = np.flatnonzero(nnz)
        begin = np.cumsum(nnz)[kept] - nnz[kept]
        columns = [nnz[kept], np.bincount(block, values["weight"], len(nnz))[kept]]
        for v in VALUES:
            x = values[v]
            total = np.bincount(block, x, len(nnz))
            mean = total / np.maximum(nnz, 1)
            largest = np.maximum.reduceat(x, begin) if len(kept) else x
            columns += [total[kept], largest, mean[kept], np.bincount(block, (x - mean[block]) ** 2, len(nnz))[kept] / nnz[kept]]
        columns = map(pa.array, ((kept % 9 // 3).astype(np.int32), (kept % 3).astype(np.int32), *columns))
        blocks = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, entry, strict=True)], fields=list(entry))
        ends = np.append(0, np.cumsum(np.bincount(kept // 9, minlength=high - low))).astype(np.int32)
        who = left.slice(low, high - low).combine_chunks()
        sizes_ = [pc.list_value_length(who[f"t{k}"]).cast(pa.int64()) for k in range(3)]
        out.append(pa.Table.from_arrays([who[KEY], who["ego"], *sizes_, pa.ListArray.from_arrays(pa.array(ends), blocks)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _merged(ball: DataFrame, tiles: DataFrame) -> DataFrame:
    """(snapshot_id, ego, n0, n1, n2, blocks) from the sums of the tiles that a ball's edges lie in."""
    block = [KEY, "ego", "i", "j"]
    of = [x for v in VALUES for x in (F.sum(f"{v}_sum").alias(f"{v}_sum"), F.max(f"{v}_max").alias(f"{v}_max"))]
    sums = tiles.select(KEY, "ego", F.inline("blocks"))
    sums = sums.groupBy(*block).agg(F.sum("nnz").alias("nnz"), F.sum("weight").alias("weight"), *of, F.collect_list(F.struct("nnz", *[f"{v}_{k}" for v in VALUES for k in ("avg", "var")])).alias("parts"))
    for v in VALUES:
        sums = sums.withColumn(f"{v}_avg", F.col(f"{v}_sum") / F.col("nnz"))
        sums = sums.withColumn(f"{v}_var", _spread(v) / F.col("nnz"))
    return _gathered(ball, sums)


def _spread(v: str) -> Column:
    """Squared distances from the mean of all ``parts``; Spark counts a function's parameters, so it has no default."""
    return F.aggregate("parts", F.lit(0.0), lambda t, x: t + x["nnz"] * (x[f"{v}_var"] + F.pow(x[f"{v}_avg"] - F.col(f"{v}_avg"), 2)))


def _gathered(count: DataFrame, sums: DataFrame) -> DataFrame:
    """(snapshot_id, ego, n0, n1, n2, blocks) of the balls of ``count`` and the sums of their blocks."""
    return count.join(sums.groupBy(KEY, "ego").agg(F.collect_list(F.struct("i", "j", *NAMES)).alias("blocks")), [KEY, "ego"], "left").select(KEY, "ego", "n0", "n1", "n2", "blocks")


def members(edges: DataFrame, egos: DataFrame, limit: int = hubs.LIMIT) -> DataFrame:
    """(snapshot_id, ego, node, role) of every ball; ``egos`` (snapshot_id, node) without edges hold themselves.

    Where a node has more than ``limit`` neighbours, pairs are dealt row by row, so that a hub's ball is many tasks.
    """
    edges = pinned(edges)
    arc = arcs(edges)
    if hubs.heavy_nodes(arc, limit).isEmpty():
        settled = sent(*lists(edges, Pins(edges.sparkSession, "members"))).groupBy(KEY, "ego", "other").agg(F.min("p").alias("p"))
        return egos.select(KEY, F.col("node").alias("ego"), "node", F.lit(0).alias("role")).unionByName(settled.select(KEY, "ego", F.col("other").alias("node"), role(F.col("p")).alias("role")))
    arc = pinned(arc)
    paths = arc.groupBy(KEY, "u").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    one = arc.select(KEY, F.col("u").alias("ego"), F.col("v").alias("node"), F.lit(NEAR).alias("p"))
    first = arc.select(KEY, F.col("u").alias("ego"), F.col("v").alias("via"), F.col("ahead").alias("a1"), F.col("back").alias("b1"))
    second = arc.select(KEY, F.col("u").alias("via"), F.col("v").alias("node"), F.col("ahead").alias("a2"), F.col("back").alias("b2"))
    straight = (F.col("a1") & F.col("a2")) | (F.col("b1") & F.col("b2"))
    two = first.join(second, [KEY, "via"]).filter("ego <> node").select(KEY, "ego", "node", F.when(straight, DIRECTED).otherwise(TURNED).alias("p"))
    own = egos.select(KEY, F.col("node").alias("ego"), "node", F.lit(EGO).alias("p"))
    dealt = own.unionByName(one).unionByName(two).repartition(min(20_000, 8 + paths // ROWS), KEY, "ego", "node")
    return dealt.groupBy(KEY, "ego", "node").agg(F.min("p").alias("p")).select(KEY, "ego", "node", role(F.col("p")).alias("role"))


def sizes(ball: DataFrame) -> DataFrame:
    """(snapshot_id, ego, n0, n1, n2)."""
    return ball.groupBy(KEY, "ego").agg(*[F.count_if(F.col("role") == i).alias(f"n{i}") for i in range(3)])


def block_edges(edges: DataFrame, ball: DataFrame) -> DataFrame:
    """Edges inside each ball by the roles (i, j) of their ends: (snapshot_id, ego, i, j, and the edge's own columns).

    An edge at the ego or a neighbour of it lies in the ball, so those are found from these members. An edge
    between two others is looked for from the end that is such a member of fewer balls: a hub's edges are
    met from their far ends, and a star costs nothing here. Read ``ball`` pinned, as it is used four times.
    """
    values = [c for c in edges.columns if c not in (KEY, "src", "dst")]
    member = ball.select(KEY, "ego", "node", "role", ((F.col("role") == 1) | (F.col("ego") == F.col("node"))).alias("inner"))
    balls = member.filter("not inner").groupBy(KEY, "node").agg(F.count("*").alias("n"))
    held = edges.select(KEY, "src", "dst", F.struct(*values).alias("e")) if values else edges.select(KEY, "src", "dst", F.lit(None).alias("e"))

    def ends(df: DataFrame, *more: Column) -> DataFrame:
        """Every edge from both its ends."""
        turned = lambda u, v, ahead: F.struct(F.col(u).alias("node"), F.col(v).alias("other"), F.lit(ahead).alias("ahead"), *more)
        return df.select(KEY, F.explode(F.array(turned("src", "dst", True), turned("dst", "src", False))).alias("t"), "e").select(KEY, "t.*", "e")

    start = member.select(KEY, "ego", "node", F.col("role").alias("mine"), "inner")
    close = start.filter("inner").join(ends(held), [KEY, "node"])
    rare = held
    for end in ("src", "dst"):
        rare = rare.join(balls.select(KEY, F.col("node").alias(end), F.col("n").alias(f"{end}_n")), [KEY, end])
    fewer = ends(rare, (F.col("src_n") <= F.col("dst_n")).alias("by_src")).filter("ahead = by_src").drop("by_src")
    far = start.filter("not inner").join(fewer, [KEY, "node"])
    other = member.select(KEY, "ego", F.col("node").alias("other"), F.col("role").alias("theirs"), F.col("inner").alias("other_inner"))
    both = close.unionByName(far).join(other, [KEY, "ego", "other"])
    both = both.filter("if(inner, ahead or not other_inner, not other_inner)")  # an edge between inner members is met twice
    i, j = F.when(F.col("ahead"), F.col("mine")).otherwise(F.col("theirs")), F.when(F.col("ahead"), F.col("theirs")).otherwise(F.col("mine"))
    return both.select(KEY, "ego", i.alias("i"), j.alias("j"), *[F.col("e")[v].alias(v) for v in values])


NAMES = ["nnz", "weight", *[f"{v}_{n}" for v in VALUES for n in ("sum", "max", "avg", "var")]]
SUMS = "blocks array<struct<i: int, j: int, nnz: bigint, " + ", ".join(f"{c}: double" for c in NAMES[1:]) + ">>"


def _sums() -> list[Column]:
    per = [f(F.col(v).cast("double")).alias(f"{v}_{n}") for v in VALUES for n, f in (("sum", F.sum), ("max", F.max), ("avg", F.avg), ("var", F.var_pop))]
    return [F.count("*").alias("nnz"), F.sum(F.col("weight").cast("double")).alias("weight"), *per]


def block_sums(inside: DataFrame) -> DataFrame:
    """By block: edges, weight, and for each value its sum, largest, mean and population variance."""
    return inside.groupBy(KEY, "ego", "i", "j").agg(*_sums())


def sized(n: list[np.ndarray]) -> np.ndarray:
    """(rows, 9): the size columns, possible edges of the blocks."""
    n0, n1, n2 = n
    return np.stack([n0 * n0 - 3 * n0 + 2, n0 * n1, (n0 - 1) * n2, n1 * n0, n1 * n1 - n1, n1 * n2, n2 * n0 - n2, n2 * n1, n2 * n2 - n2], 1).astype(float)


def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(snapshot_id, ego, n0, n1, n2, blocks) -> (snapshot_id, node, the 90 columns in their frozen order).

    A density is the weight over the possible edges; that of an empty block is 0, but 1 between the ego's group and no
    neighbours. Statistics are those of the dense block, of whose cells nnz are given by their sums and the rest are 0.
    """
    for b in batches:
        if not b.num_rows:
            continue
        n = [b.column(f"n{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        each = b.column("blocks")
        entry, row = each.flatten(), pc.list_parent_indices(each).to_numpy()
        number = lambda c, entry=entry: pc.fill_null(pc.struct_field(entry, c).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        at = (row, (number("i") * 3 + number("j")).astype(np.int64))
        given = {c: np.zeros((b.num_rows, 9)) for c in NAMES}
        for c in NAMES:
            given[c][at] = number(c)
        possible, cells, nnz = sized(n), np.stack([n[i] * n[j] for i in range(3) for j in range(3)], 1).astype(float), given["nnz"]
        with np.errstate(divide="ignore", invalid="ignore"):
            empty = np.array([1.0 if block == "01" else 0.0 for block in BLOCKS])
            out = [np.where(possible > 0, given["weight"] / possible, empty), possible]
            for v in VALUES:
                total, largest, mean, var = (given[f"{v}_{k}"] for k in ("sum", "max", "avg", "var"))
                stats = {
                    "sum": total,
                    "mean": total / cells,
                    "max": np.where(nnz < cells, np.maximum(largest, 0.0), largest),
                    "std": np.sqrt(np.maximum(var * nnz + mean * mean * nnz * (cells - nnz) / cells, 0.0) / cells),
                }
                out += [np.where((cells > 0) & (nnz > 0), stats[s], 0.0) for s in STATS]
        columns = [pa.array(x) for x in np.hstack(out).T]
        yield pa.RecordBatch.from_arrays([b.column(KEY), b.column("ego"), *columns], names=[KEY, "node", *FEATURES])


def crowded(arc: DataFrame, limit: int) -> bool:
    """Whether a node has more than ``limit`` neighbours and a neighbour has more than that on average, or one has 64 times as many.

    Else balls hold no more than ``limit`` members an arc, whatever the largest degree.
    """
    seen = arc.groupBy(KEY, "u").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).first()
    return (seen.most or 0) > limit and (seen.mean > limit or seen.most > 64 * limit)


def features(edges: DataFrame, egos: DataFrame, ball: DataFrame | None = None, limit: int = hubs.LIMIT) -> DataFrame:
    """(snapshot_id, node, 90 features) of every ego. ``edges`` are the pruned ones.

    Where balls hold much of their snapshots, they are found beside all edges; else, where hubs crowd them, they are described by
    ``hubs``, or by their members.
    """
    ship(edges.sparkSession)
    edges, types = pinned(edges), dict(edges.dtypes)
    if ball is not None:
        wide = _gathered(sizes(ball), block_sums(block_edges(edges, ball)))
    elif thick(edges, limit):
        wide = beside(edges, egos, f"{KEY} {types[KEY]}, ego {types['src']}, n0 long, n1 long, n2 long, {SUMS}")
    elif crowded(arcs(edges), limit):
        wide = _gathered(*hubs.blocks(edges, egos, limit))
    else:
        count, wide, several = balls(edges, egos, _sums_of_tile, f"{KEY} {types[KEY]}, ego {types['src']}, n0 long, n1 long, n2 long, {SUMS}")
        wide = _merged(count, wide) if several else wide
    return wide.mapInArrow(laid, f"{KEY} {types[KEY]}, node {types['src']}, " + ", ".join(f"{c} double" for c in FEATURES))


def thick(edges: DataFrame, limit: int) -> bool:
    """Whether balls hold so much of their snapshots that each is found beside all edges of the snapshot.

    That is so where second steps are at least a fiftieth of all pairs of a node and an edge, but not where nodes of more than
    ``limit`` neighbours make few signatures, by which ``hubs`` counts.
    """
    arc = arcs(edges)
    by = arc.groupBy(KEY, "u").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.count("*").alias("nodes"), F.sum("n").alias("arcs"), F.sum(F.col("n") * F.col("n")).alias("paths"))
    seen = by.agg(F.sum("paths").alias("paths"), F.sum("arcs").alias("arcs"), F.sum(F.col("nodes") * F.col("arcs")).alias("pairs"), F.max("arcs").alias("most")).first()
    if (seen.paths or 0) < PATHS or seen.paths < MEAN * seen.arcs or 100 * seen.paths < seen.pairs or seen.most > 2 * HELD:
        return False
    if not crowded(arc, limit):
        return True
    signs = arc.join(hubs.heavy_nodes(arc, limit).withColumnRenamed("node", "v"), [KEY, "v"]).groupBy(KEY, "u").agg(F.sum(F.xxhash64("v", "ahead", "back").cast("decimal(20,0)")).alias("t"), F.collect_list("v").alias("v"))
    each = signs.groupBy(KEY, "t").agg(F.first("v").alias("v")).select(KEY, F.explode("v").alias("v")).groupBy(KEY, "v").agg(F.count("*").alias("n"))
    return (each.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) > 8 * seen.arcs


def beside(edges: DataFrame, egos: DataFrame, schema: str) -> DataFrame:
    """(snapshot_id, ego, n0, n1, n2, blocks): a snapshot's edges go to groups of its egos, whose balls are found there and nowhere kept.

    Work is that of egos times edges; memory that of a snapshot's edges, whatever the balls hold.
    """
    pins = Pins(edges.sparkSession, "beside")
    egos = pins.put(egos)
    size = egos.groupBy(KEY).agg(F.count("*").alias("egos")).join(edges.groupBy(KEY).agg(F.count("*").alias("edges")), KEY, "left")
    groups = F.least(F.lit(COPIES), F.greatest(F.lit(1), F.ceil(F.col("egos") * F.coalesce("edges", F.lit(0)) / F.lit(WORK)))).cast("int")
    dealt = pins.put(size.select(KEY, groups.alias("groups")))
    tasks, tile = 4 * (dealt.agg(F.sum("groups")).first()[0] or 0) + 8, [KEY, "a"]
    left = egos.join(dealt, KEY).select(KEY, F.pmod(F.xxhash64("node"), "groups").cast("int").alias("a"), F.col("node").alias("ego"))
    right = edges.join(dealt, KEY).select(KEY, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("a"), "src", "dst", *[F.col(v).cast("double").alias(v) for v in ("weight", *VALUES)])
    left, right = (df.repartition(min(20_000, tasks), *tile).groupBy(*tile) for df in (left, right))
    return left.cogroup(right).applyInArrow(_sums_beside, schema)


def _spans(start: np.ndarray, of: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What ``held`` has between start[i] and start[i + 1] for every i of ``of``."""
    n = start[of + 1] - start[of]
    return held[np.arange(n.sum()) + np.repeat(start[of] - np.cumsum(n) + n, n)]


def _sums_beside(left: pa.Table, right: pa.Table) -> pa.Table:
    """(snapshot_id, ego, n0, n1, n2, blocks) of egos beside all edges of their snapshot."""
    entry = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("nnz", pa.int64()), *[(c, pa.float64()) for c in NAMES[1:]]])
    schema = pa.schema([left.schema.field(KEY), left.schema.field("ego"), *[(f"n{k}", pa.int64()) for k in range(3)], ("blocks", pa.list_(entry))])
    if not left.num_rows:
        return schema.empty_table()
    ends = pc.unique(pa.chunked_array([*right["src"].chunks, *right["dst"].chunks, *left["ego"].chunks], left.schema.field("ego").type))
    codes = lambda c: pc.index_in(c.combine_chunks(), value_set=ends).to_numpy(zero_copy_only=False).astype(np.int64)
    src, dst, ego, count = codes(right["src"]), codes(right["dst"]), codes(left["ego"]), len(ends)
    order = np.argsort(src, kind="stable")
    src, dst, values = src[order], dst[order], {v: right[v].to_numpy()[order] for v in ("weight", *VALUES)}
    starts = lambda sorted_: np.searchsorted(sorted_, np.arange(count + 1))
    back = np.argsort(dst, kind="stable")
    out_at, in_at, source = starts(src), starts(dst[back]), src[back]
    both = np.unique(np.concatenate([src * count + dst, dst * count + src])[np.tile(src != dst, 2)])
    near_at, near = starts(both // count), both % count
    ahead, role = np.diff(out_at), np.empty(count, np.uint8)
    sizes_, kept_, columns = np.zeros((len(ego), 3), np.int64), np.zeros(len(ego), np.int32), []
    for row, e in enumerate(ego):
        role.fill(3)  # not in the ball
        own = near[near_at[e] : near_at[e + 1]]
        role[_spans(near_at, own, near)] = 0
        for at, held in ((out_at, dst), (in_at, source)):
            role[_spans(at, held[at[e] : at[e + 1]], held)] = 2
        role[own], role[e] = 1, 0
        sizes_[row] = [np.count_nonzero(role == k) for k in range(3)]
        inside = role < 3
        met = np.flatnonzero(inside)
        if 3 * ahead[met].sum() < len(src):  # a small ball: its own edges are looked at, else all
            edge = _spans(out_at, met, np.arange(len(src)))
            edge = edge[inside[dst[edge]]]
        else:
            edge = np.flatnonzero(inside[src] & inside[dst])
        block = role[src[edge]].astype(np.int64) * 3 + role[dst[edge]]
        nnz = np.bincount(block, minlength=9)
        kept = np.flatnonzero(nnz)
        found = [kept // 3, kept % 3, nnz[kept], np.bincount(block, values["weight"][edge], 9)[kept]]
        for v in VALUES:
            x, largest = values[v][edge], np.full(9, -np.inf)
            total = np.bincount(block, x, 9)
            mean = total / np.maximum(nnz, 1)
            np.maximum.at(largest, block, x)
            found += [total[kept], largest[kept], mean[kept], np.bincount(block, (x - mean[block]) ** 2, 9)[kept] / nnz[kept]]
        kept_[row] = len(kept)
        columns.append(np.stack(found) if len(kept) else np.zeros((len(entry), 0)))
    each = np.concatenate(columns, 1)
    blocks = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(each, entry, strict=True)], fields=list(entry))
    lists_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept_)).astype(np.int32)), blocks)
    return pa.Table.from_arrays([left[KEY].combine_chunks(), left["ego"].combine_chunks(), *map(pa.array, sizes_.T.copy()), lists_], schema=schema)


def order_stats(value: np.ndarray, nnz: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """min, median and iqr of blocks of ``cells`` values, of which the ``nnz`` given ones stand block by block in ascending order; the rest are 0."""
    first, below = np.cumsum(nnz) - nnz, np.append(0, np.cumsum(value < 0))
    low, zeros = below[first + nnz] - below[first], cells - nnz
    last = max(0, len(value) - 1)

    def ranked(k: np.ndarray) -> np.ndarray:
        at = first + np.where(k < low, k, k - zeros)
        return np.where((k < low) | (k >= low + zeros), value[np.clip(at, 0, last)], 0.0) if len(value) else np.zeros(len(k))

    def quantile(p: float) -> np.ndarray:
        base = np.floor((cells - 1) * p).astype(np.int64)
        a, b = ranked(base), ranked(np.minimum(base + 1, cells - 1))
        return a + (b - a) * ((cells - 1) * p - base)

    return [ranked(np.zeros(len(cells), np.int64)), quantile(0.5), quantile(0.75) - quantile(0.25)]


def _orders_of_tile(value: str, several: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(snapshot_id, ego, i, j, cells, v): the ascending values of each block; with them all in one tile min, median, iqr for v."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        more = [("v", pa.list_(pa.float64()))] if several else [(c, pa.float64()) for c in ORDERS]
        schema = pa.schema([left.schema.field(KEY), left.schema.field("ego"), ("i", pa.int32()), ("j", pa.int32()), ("cells", pa.int64()), *more])
        out = []
        for low, high, block, values in _inside(left, right, [value]) if left.num_rows and right.num_rows else ():
            order = np.lexsort((values[value], block))
            x, nnz = values[value][order], np.bincount(block, minlength=(high - low) * 9)
            kept = np.flatnonzero(nnz)
            nnz, i, j = nnz[kept], kept % 9 // 3, kept % 3
            n = np.stack([pc.list_value_length(left[f"t{k}"]).to_numpy().astype(np.int64)[low:high] for k in range(3)])
            cells, who = n[i, kept // 9] * n[j, kept // 9], left.select([KEY, "ego"]).take(pa.array(low + kept // 9))
            found = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(nnz)).astype(np.int32)), pa.array(x))] if several else map(pa.array, order_stats(x, nnz, cells))
            out.append(pa.Table.from_arrays([who[KEY], who["ego"], pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(cells), *found], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return work


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(snapshot_id, ego, i, j, cells, v of several tiles) -> (snapshot_id, ego, i, j, min, median, iqr)."""
    for b in batches:
        if b.num_rows:
            v = b.column("v")
            x, row = v.flatten().to_numpy(), pc.list_parent_indices(v).to_numpy()
            x = x[np.lexsort((x, row))]
            found = order_stats(x, np.bincount(row, minlength=b.num_rows), b.column("cells").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, found)], names=[KEY, "ego", "i", "j", *ORDERS])


def block_orders(edges: DataFrame, egos: DataFrame, value: str = "amount_trans", limit: int = hubs.LIMIT) -> DataFrame:
    """(snapshot_id, ego, i, j, min, median, iqr) of the dense blocks that hold an edge, from tiles of balls and edges.

    Where hubs crowd the balls, by ``block_order_stats``: there a block may be larger than a task.
    """
    edges = pinned(edges)
    if crowded(arcs(edges), limit):
        return block_order_stats(edges, members(edges, egos), value)
    types, stats = dict(edges.dtypes), ", ".join(f"{c} double" for c in ORDERS)
    block = f"{KEY} {types[KEY]}, ego {types['src']}, i int, j int"
    several = (edges.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0) > EDGES
    tiles = balls(edges, egos, _orders_of_tile(value, several), f"{block}, cells long, {'v array<double>' if several else stats}")[1]
    if not several:
        return tiles.drop("cells")
    met = tiles.groupBy(KEY, "ego", "i", "j").agg(F.first("cells").alias("cells"), F.flatten(F.collect_list("v")).alias("v"))
    return met.mapInArrow(_ordered, f"{block}, {stats}")


def block_order_stats(edges: DataFrame, ball: DataFrame, value: str = "amount_trans") -> DataFrame:
    """(snapshot_id, ego, i, j, min, median, iqr) of the dense blocks that hold an edge.

    Zeros stand between the negative and the other values and are counted, not made; percentiles interpolate
    linearly. Given values are dealt by ranges of (block, value) and numbered, so that a block may lie in several
    tasks, and the few ranks that a block asks for are met by their numbers.
    """
    block = [KEY, "ego", "i", "j"]
    ball = pinned(ball)
    inside = block_edges(edges, ball).select(*block, F.col(value).cast("double").alias("v"))
    ranged = pinned(inside.repartitionByRange(*block, "v").withColumn("__part", F.spark_partition_id()))
    numbered = pinned(windows.numbered(ranged, "__part", [*block, "v"]).select(*block, "v", F.col("__n").alias("at")))
    held = numbered.groupBy(*block).agg(F.min("at").alias("first"), F.count("*").alias("nnz"), F.count_if(F.col("v") < 0).alias("low"))
    pick = lambda i: F.element_at(F.array("n0", "n1", "n2"), F.col(i) + 1)
    own = held.join(sizes(ball), [KEY, "ego"]).withColumn("n", pick("i") * pick("j")).withColumn("zeros", F.col("n") - F.col("nnz"))
    base = lambda p: F.floor((F.col("n") - 1) * F.lit(p))
    asked = {"min": F.lit(0).cast("long")} | {f"{e}{int(100 * p)}": base(p) if e == "a" else F.least(base(p) + 1, F.col("n") - 1) for p in (0.25, 0.5, 0.75) for e in "ab"}
    given = lambda k: F.when(k < F.col("low"), F.col("first") + k).when(k >= F.col("low") + F.col("zeros"), F.col("first") + k - F.col("zeros"))
    ranks = own.select(*block, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), given(k).alias("at")) for name, k in asked.items()])).alias("r")).select(*block, "n", "r.*")
    met = ranks.filter("at is not null").join(numbered.select("at", "v"), "at").unionByName(ranks.filter("at is null").withColumn("v", F.lit(0.0)))
    wide = met.groupBy(*block, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in asked])

    def quantile(p: float) -> Column:
        low, high = F.col(f"a{int(100 * p)}"), F.col(f"b{int(100 * p)}")
        return low + (high - low) * ((F.col("n") - 1) * F.lit(p) - base(p))

    return wide.select(*block, "min", quantile(0.5).alias("median"), (quantile(0.75) - quantile(0.25)).alias("iqr"))
