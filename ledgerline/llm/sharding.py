"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

Ids hash to cells of a ring, on which every shard owns many virtual nodes; a row's home is the
next node clockwise. No shard takes more than its bound: rows over it continue clockwise to the
next shard with room. A cell with more rows than a fair share of all is cut into parts. Only counts of
cells and parts (at most cells + PARTS rows, whatever the input) reach the driver, which plans runs of
ranks; every row then finds its run by a broadcast join.

With ``slack`` 0 the bounds are the even shares, so counts differ by at most one. Rows at home
within the bound never move, so the rows moved are as few as these bounds allow.

Defined results: a null text has no bytes (size 8, CRC 0); null ids share one cell; repeated rows
each take a place of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

#: Ring cells (a power of two), nodes per shard.
CELL_BITS, NODES = 12, 64
#: Rows of a part of a cell: at least LEAST, and at most a PARTS-th of all rows, so that a hot id is spread.
LEAST, PARTS = 1000, 1 << 14


def plan_runs(nodes: list[tuple[int, int]], counts: dict[tuple[int, int], int], shards: int, slack: float) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, salt, first, last, shard, slot): ranks first..last-1 of that part go to ``shard`` from ``slot`` on.

    ``nodes``: (cell, shard) in ring order. ``counts``: rows of each (cell, salt).
    """
    total = sum(counts.values())
    if slack:
        room = [int(-(-total * (1 + slack) // shards))] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    used, runs, over = [0] * shards, [], []

    def place(part: tuple[int, int], first: int, n: int, shard: int) -> int:
        take = min(n, room[shard] - used[shard])
        if take:
            runs.append((*part, first, first + take, shard, used[shard]))
            used[shard] += take
        return take

    at = 0
    for part in sorted(counts):
        while at < len(nodes) and nodes[at][0] < part[0]:
            at += 1
        home, n = at % len(nodes), counts[part]
        took = place(part, 0, n, nodes[home][1])
        if took < n:
            over.append((part, took, n - took, home))
    onward = list(range(len(nodes)))

    def open_node(i: int) -> int:
        """The first node clockwise from ``i`` whose shard has room."""
        trail = []
        while used[nodes[i][1]] >= room[nodes[i][1]]:
            trail.append(i)
            i = onward[i] if onward[i] != i else (i + 1) % len(nodes)
        for j in trail:
            onward[j] = i
        return i

    for part, first, n, home in over:
        while n:
            home = open_node(home)
            took = place(part, first, n, nodes[home][1])
            first, n = first + took, n - took
    return runs


def ring_shards(docs: DataFrame, shards: int = 24, slack: float = 0.0, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard): slots run from 0 in every shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.encode(text_or_empty(text_col), "UTF-8")
    place = F.xxhash64(F.col(id_col))
    rows = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            place.alias("place"),
            F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int").alias("cell"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    shard = F.floor(F.col("id") / nodes)  # a shard's nodes stay where they are when another is added
    spot = F.xxhash64(F.lit("node"), shard, F.col("id") % nodes)
    ring = spark.range(shards * nodes).select(F.shiftrightunsigned(spot, 64 - CELL_BITS).alias("cell"), spot.alias("spot"), shard.alias("shard"))
    ring_nodes = [(r.cell, r.shard) for r in ring.orderBy("cell", "spot").collect()]
    by_cell = {r.cell: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    share = max(LEAST, -(-sum(by_cell.values()) // PARTS))
    crowded = spark.createDataFrame([(c, -(-n // share)) for c, n in by_cell.items() if n > share], "cell int, parts int")
    salt = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(crowded), "cell", "left").withColumn("salt", salt).drop("parts")
    counts = {(r.cell, r.salt): r["n"] for r in rows.groupBy("cell", "salt").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan_runs(ring_nodes, counts, shards, slack), "cell int, salt int, first long, last long, shard int, slot0 long")
    homes = spark.createDataFrame([(c, next((s for at, s in ring_nodes if at >= c), ring_nodes[0][1])) for c in range(1 << CELL_BITS)], "cell int, home_shard int")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("place", "doc_id", "row")) - 1)
    return (
        ranked.join(F.broadcast(runs), ["cell", "salt"])
        .filter("rank >= first and rank < last")
        .join(F.broadcast(homes), "cell")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), "home_shard")
    )
