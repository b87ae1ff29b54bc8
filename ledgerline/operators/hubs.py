"""Block sums of two-hop balls where nodes of very many neighbours are not self-joined.

A node with more than ``limit`` neighbours is heavy. What an ego's ball holds because of a heavy neighbour alone is the same for all egos with the
same signature, the heavy neighbours with the directions of the arcs to them, and what role such a node has depends on the two
signatures only. So members come in two kinds:

* explicit ones: the ego, its neighbours, what light neighbours lead to, and all heavy nodes, as rows;
* shared ones: the other light nodes with a heavy neighbour of the ego's, as counts by pair of signatures.

Sums over edges are those between explicit members; those from explicit members to all shared candidates, from sums by (node,
signature of the other end); those among shared candidates, from sums by pair of signatures; less the edges whose candidates are
explicit members after all. A largest value is kept with its edge: where that edge's end is an explicit member of a
ball, and light nodes are members of few, the edges are read for that ball. Rows are linear in the edges for given ``limit`` and
number of signatures, where the self-join has the square of a hub's neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VALUES
from .graph import KEY, arcs
from .pin import Pins

#: Neighbours beyond which a node is heavy.
LIMIT = 512
EGO, NEAR, DIRECTED, TURNED = 0, 1, 2, 3


def heavy_nodes(arc: DataFrame, limit: int) -> DataFrame:
    return arc.groupBy(KEY, F.col("u").alias("node")).agg(F.count("*").alias("degree")).filter(F.col("degree") > limit).select(KEY, "node")


def _stats(edge: bool) -> list[Column]:
    """Sums of edges, or of such sums."""
    if edge:
        each = [x for v in VALUES for c in [F.col(v).cast("double")] for x in (F.sum(c).alias(f"{v}_s"), F.sum(c * c).alias(f"{v}_q"))]
        return [F.count("*").alias("n"), F.sum("weight").alias("w"), *each]
    return [F.sum(c).alias(c) for c in NAMES]


NAMES = ["n", "w", *[f"{v}_{k}" for v in VALUES for k in "sq"]]


def _signed(df: DataFrame, sign: int, i: Column, j: Column, *keys: str) -> DataFrame:
    return df.select(KEY, *keys, i.alias("i"), j.alias("j"), *[(sign * F.col(c)).alias(c) for c in NAMES])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def blocks(edges: DataFrame, egos: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, ego, n0, n1, n2), and by block its edges, weight, and of each value sum, max, avg and var."""
    pins = Pins(edges.sparkSession, "hubs")
    arc = pins.put(arcs(edges).select(KEY, "u", "v", (F.col("ahead").cast("int") + 2 * F.col("back").cast("int")).alias("c")))
    heavy = pins.put(heavy_nodes(arc, limit))
    degree = pins.put(arc.groupBy(KEY, F.col("u").alias("node")).agg(F.count("*").alias("degree")))
    is_heavy = heavy.select(KEY, F.col("node").alias("v"), F.lit(True).alias("big"))
    marked = pins.put(arc.join(is_heavy, [KEY, "v"], "left").withColumn("big", F.coalesce("big", F.lit(False))))

    # signatures: of every node with a heavy neighbour; as candidates, those of light nodes
    sign = marked.filter("big").groupBy(KEY, F.col("u").alias("node")).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("pairs"))  # as many as there are heavy nodes
    sign = pins.put(sign.withColumn("t", F.sha2(F.to_json("pairs"), 256)))
    own_sign = sign.select(KEY, F.col("node").alias("ego"), F.col("t").alias("s"))
    light_sign = pins.put(sign.join(heavy, [KEY, "node"], "left_anti").select(KEY, "node", "t"))
    opened = sign.select(KEY, "t", "pairs").distinct().select(KEY, "t", F.explode("pairs").alias("p")).select(KEY, "t", F.col("p.v").alias("via"), F.col("p.c").alias("c"))
    mine = opened.select(KEY, F.col("t").alias("s"), "via", F.col("c").alias("a"))
    there = opened.join(light_sign.select(KEY, "t").distinct(), [KEY, "t"])
    straight = ((F.col("a") != 2) & (F.col("c") != 1)) | ((F.col("a") != 1) & (F.col("c") != 2))  # ego to via to node, or back
    pair = pins.put(mine.join(there, [KEY, "via"]).groupBy(KEY, "s", "t").agg(F.max(F.when(straight, 2).otherwise(0)).alias("r")))

    # explicit members
    near = marked.select(KEY, F.col("u").alias("ego"), F.col("v").alias("node"), F.lit(NEAR).alias("p"))
    first = marked.select(KEY, F.col("u").alias("ego"), F.col("v").alias("via"), F.col("c").alias("a"), F.col("big").alias("via_big"))
    second = marked.select(KEY, F.col("u").alias("via"), F.col("v").alias("node"), "c", "big")
    through = lambda a, b: a.join(b, [KEY, "via"]).filter("ego <> node")
    way = F.when(((F.col("a") != 2) & (F.col("c") != 2)) | ((F.col("a") != 1) & (F.col("c") != 1)), DIRECTED).otherwise(TURNED)
    two = _union([through(first.filter("not via_big"), second), through(first.filter("via_big"), second.filter("big"))]).select(KEY, "ego", "node", way.alias("p"))
    own = egos.select(KEY, F.col("node").alias("ego"), "node", F.lit(EGO).alias("p"))
    settled = _union([own, near, two]).groupBy(KEY, "ego", "node").agg(F.min("p").alias("p"))
    member = settled.join(own_sign, [KEY, "ego"], "left").join(light_sign, [KEY, "node"], "left").join(pair, [KEY, "s", "t"], "left")
    member = member.join(is_heavy.withColumnRenamed("v", "node"), [KEY, "node"], "left")
    role = F.when(F.col("p") == NEAR, 1).when((F.col("p") == DIRECTED) | ((F.col("p") == TURNED) & F.coalesce(F.col("r") == 2, F.lit(False))), 2).otherwise(0)
    # from these, edges may lead to shared candidates: all neighbours of the ego and of light neighbours are explicit
    onward = F.col("s").isNotNull() & (F.col("p") != EGO) & (F.coalesce("big", F.lit(False)) | (F.col("p") > NEAR))
    member = pins.put(member.select(KEY, "ego", "node", role.alias("role"), "s", F.col("r").alias("shared"), onward.alias("onward")))

    counted = member.groupBy(KEY, "ego").agg(*[(F.count_if(F.col("role") == k) - F.count_if(F.coalesce(F.col("shared") == k, F.lit(False)))).alias(f"m{k}") for k in range(3)], F.first("s").alias("s"))
    many = pair.join(light_sign.groupBy(KEY, "t").agg(F.count("*").alias("k")), [KEY, "t"]).groupBy(KEY, "s").agg(*[F.sum(F.when(F.col("r") == k, F.col("k")).otherwise(0)).alias(f"k{k}") for k in range(3)])
    count = counted.join(many, [KEY, "s"], "left").select(KEY, "ego", *[(F.col(f"m{k}") + F.coalesce(f"k{k}", F.lit(0))).alias(f"n{k}") for k in range(3)])

    # edges between explicit members, each met from its end of fewer neighbours
    deg = lambda end: degree.select(KEY, F.col("node").alias(end), F.col("degree").alias(f"{end}_d"))
    held = edges.select(KEY, "src", "dst", "weight", *VALUES)
    rare = held.join(deg("src"), [KEY, "src"]).join(deg("dst"), [KEY, "dst"]).withColumn("by_src", F.col("src_d") <= F.col("dst_d")).drop("src_d", "dst_d")
    rare = rare.select(KEY, F.when(F.col("by_src"), F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(F.col("by_src"), F.col("dst")).otherwise(F.col("src")).alias("other"), F.col("by_src").alias("ahead"), "weight", *VALUES)
    far = member.select(KEY, "ego", F.col("node").alias("other"), F.col("role").alias("other_role"), F.col("shared").alias("other_shared"), F.col("onward").alias("other_onward"))
    inner = pins.put(member.join(rare, [KEY, "node"]).join(far, [KEY, "ego", "other"]))
    turn = lambda a, b: (F.when(F.col("ahead"), a).otherwise(b), F.when(F.col("ahead"), b).otherwise(a))
    role_, other_, shared_, other_shared = (F.col(c) for c in ("role", "other_role", "shared", "other_shared"))
    edge = lambda df, sign, ends: df.select(KEY, "ego", ends[0].alias("i"), ends[1].alias("j"), F.lit(float(sign)).alias("n"), (sign * F.col("weight")).alias("w"), *[x for v in VALUES for c in [F.col(v).cast("double")] for x in ((sign * c).alias(f"{v}_s"), (sign * c * c).alias(f"{v}_q"))])
    parts = [
        edge(inner, 1, turn(role_, other_)),
        edge(inner.filter(F.col("onward") & other_shared.isNotNull()), -1, turn(role_, other_shared)),
        edge(inner.filter(F.col("other_onward") & shared_.isNotNull()), -1, turn(shared_, other_)),
        edge(inner.filter(shared_.isNotNull() & other_shared.isNotNull()), 1, turn(shared_, other_shared)),
    ]

    # edges to candidates, by (node, direction, signature), and among candidates, by signatures
    ends = _union([held.select(KEY, F.col(a).alias("node"), F.col(b).alias("other"), F.lit(ahead).alias("ahead"), "weight", *VALUES) for a, b, ahead in (("src", "dst", True), ("dst", "src", False))])
    ends = pins.put(ends.join(light_sign.select(KEY, F.col("node").alias("other"), "t"), [KEY, "other"]))
    top = [F.max(F.struct(F.col(v).cast("double").alias("x"), "other")).alias(f"{v}_top") for v in VALUES]
    toward = pins.put(ends.groupBy(KEY, "node", "ahead", "t").agg(*_stats(True), *top))
    reach = lambda df: df.join(toward, [KEY, "node"]).join(pair.select(KEY, "s", "t", F.col("r").alias("at")), [KEY, "s", "t"])
    leads = pins.put(reach(member.filter("onward").select(KEY, "ego", "node", "role", "s")))
    at = F.col("at")
    parts.append(_signed(leads, 1, *turn(role_, at), "ego"))
    parts.append(_signed(reach(member.filter("shared is not null").select(KEY, "ego", "node", "shared", "s")), -1, *turn(shared_, at), "ego"))
    among = ends.filter("ahead").join(light_sign.select(KEY, "node", F.col("t").alias("t0")), [KEY, "node"])
    best = [F.max(F.struct(F.col(v).cast("double").alias("x"), "node", "other")).alias(f"{v}_top") for v in VALUES]
    quotient = pins.put(among.groupBy(KEY, "t0", "t").agg(*_stats(True), *best))
    roles = lambda df: df.join(pair.select(KEY, "s", F.col("t").alias("t0"), F.col("r").alias("i")), [KEY, "t0"]).join(pair.select(KEY, "s", "t", F.col("r").alias("j")), [KEY, "s", "t"])
    whole = pins.put(roles(quotient).groupBy(KEY, "s", "i", "j").agg(*_stats(False), *[F.max(f"{v}_top").alias(f"{v}_top") for v in VALUES]))
    signed_egos = own_sign.join(egos.select(KEY, F.col("node").alias("ego")).distinct(), [KEY, "ego"])
    shared = pins.put(signed_egos.join(whole, [KEY, "s"]))
    parts.append(shared.select(KEY, "ego", "i", "j", *NAMES))
    sums = _union([p.select(KEY, "ego", "i", "j", *[F.col(c).cast("double").alias(c) for c in NAMES]) for p in parts]).groupBy(KEY, "ego", "i", "j").agg(*_stats(False))

    # the largest values: the kept edge counts unless its candidate is an explicit member, else the edges are read
    in_ball = member.select(KEY, "ego", F.col("node").alias("other"), F.lit(True).alias("in"))
    out = []
    for v in VALUES:
        value = F.col(v).cast("double")
        i, j = turn(role_, other_)
        out.append(inner.select(KEY, "ego", i.alias("i"), j.alias("j"), F.lit(v).alias("v"), value.alias("x")))
        i, j = turn(role_, at)
        asked = leads.select(KEY, "ego", "node", "ahead", "t", i.alias("i"), j.alias("j"), F.col(f"{v}_top.x").alias("x"), F.col(f"{v}_top.other").alias("other")).join(in_ball, [KEY, "ego", "other"], "left")
        out.append(asked.filter(F.col("in").isNull()).select(KEY, "ego", "i", "j", F.lit(v).alias("v"), "x"))
        again = asked.filter(F.col("in")).select(KEY, "ego", "node", "ahead", "t", "i", "j").join(ends.select(KEY, "node", "ahead", "t", "other", value.alias("x")), [KEY, "node", "ahead", "t"])
        out.append(again.join(in_ball, [KEY, "ego", "other"], "left_anti").select(KEY, "ego", "i", "j", F.lit(v).alias("v"), "x"))
        asked = shared.select(KEY, "ego", "s", "i", "j", F.col(f"{v}_top.x").alias("x"), F.col(f"{v}_top.node").alias("node"), F.col(f"{v}_top.other").alias("other"))
        asked = asked.join(in_ball.withColumnRenamed("in", "in_o"), [KEY, "ego", "other"], "left").join(in_ball.withColumnsRenamed({"other": "node", "in": "in_n"}), [KEY, "ego", "node"], "left")
        out.append(asked.filter("in_o is null and in_n is null").select(KEY, "ego", "i", "j", F.lit(v).alias("v"), "x"))
        again = asked.filter("in_o or in_n").select(KEY, "ego", "s", "i", "j")
        read = roles(among.select(KEY, "t0", "t", "node", "other", value.alias("x")).join(again.join(pair, [KEY, "s"]).select(KEY, "t").distinct(), [KEY, "t"]))
        read = again.join(read, [KEY, "s", "i", "j"]).join(in_ball, [KEY, "ego", "other"], "left_anti").join(in_ball.withColumnRenamed("other", "node"), [KEY, "ego", "node"], "left_anti")
        out.append(read.select(KEY, "ego", "i", "j", F.lit(v).alias("v"), "x"))
    largest = _union(out).groupBy(KEY, "ego", "i", "j").agg(*[F.max(F.when(F.col("v") == v, F.col("x"))).alias(f"{v}_max") for v in VALUES])

    n = F.round("n")
    done = sums.withColumn("n", n).filter("n > 0").join(largest, [KEY, "ego", "i", "j"], "left")
    each = []
    for v in VALUES:
        mean = F.col(f"{v}_s") / F.col("n")
        var = F.col(f"{v}_q") / F.col("n") - mean * mean
        # differences of sums: what is below their precision is nothing
        each += [F.col(f"{v}_s").alias(f"{v}_sum"), f"{v}_max", mean.alias(f"{v}_avg"), F.when(var < 1e-12 * (mean * mean + F.col(f"{v}_q") / F.col("n")), 0.0).otherwise(var).alias(f"{v}_var")]
    return count, done.select(KEY, "ego", "i", "j", F.col("n").cast("long").alias("nnz"), F.col("w").alias("weight"), *each)
