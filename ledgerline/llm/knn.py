"""Exact top-k search by inner product: a Voronoi join of queries and vectors.

Pivots are centres of a bounded sample of vectors. Queries and vectors alike belong to the cell of
their nearest pivot. For a vector x of a cell with pivot p at distance d from it, and any query q,
``q.p - |q|d <= q.x <= q.p + |q|d`` (the Cauchy-Schwarz inequality). Each data cell's summary counts
its vectors by distance; from the summaries' lower bounds, and from scores against the sample, every
query gets a score that its k-th result surely reaches. For a group of queries and a data cell that
gives the least distance from the pivot at which a vector can be among the results of any query of the
group; only vectors from there on are sent to it. There they are scored against blocks of queries with
one matrix product, and a worker keeps k results a query.

Query cells are put together to groups that fill a block; larger ones are cut into blocks. Every
block's vectors are dealt over several tasks, so neither a crowded cell nor a repeated vector meets in
one task. Pivots, bins, sample and groups affect only how much is skipped: results are exact.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; a row is never its own result but repeated rows are each other's;
ties go to the smaller id, null ids last; fewer than k candidates give all; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches as batches_of, lean, partitions, prepare, Scratch

#: Pivots; rows of the sample that they are fitted on and that bounds are taken from; bins of a summary.
PIVOTS, SAMPLE, BINS = 64, 2048, 64
#: Queries in a block; vectors in a row that is dealt out; vectors scored at once; rows given to a worker.
BLOCK, ROWS, CHUNK, SLIM_ROWS = 4096, 1024, 512, 4096
SCORED = "query_row long, query_id long, row long, vec_id long, score long"
EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str, queries: Column) -> DataFrame:
    """(row, vec_id, v, is_query): components as floor(scale * x), usable rows alone."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    return own.filter(usable).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), "is_query"
    )


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    for i, (a, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def centres(sample: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """At most ``pivots`` centres of the distinct rows of ``sample``: far apart at first, then Lloyd's steps."""
    own = np.unique(sample, axis=0)
    chosen, apart = [own[0]], ((own - own[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(own)):
        chosen.append(own[apart.argmax()])
        apart = np.minimum(apart, ((own - chosen[-1]) ** 2).sum(1))
    p = np.array(chosen)
    for _ in range(rounds):
        cell, _ = _nearest(own, p)
        p = np.array([own[cell == c].mean(0) if (cell == c).any() else p[c] for c in range(len(p))])
    return p


def reached(q: np.ndarray, p: np.ndarray, sample: np.ndarray, counts: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th result of each query reaches at least; -inf where nothing is known.

    ``counts`` (cell, bin): vectors by distance from their pivot, up to ``upper`` (bin). One more than k
    are counted, as the query itself may be among them.
    """
    least = np.full(len(q), -np.inf)
    if len(sample) > k:
        s = q @ sample.T
        least = np.partition(s, len(sample) - k - 1, 1)[:, len(sample) - k - 1]
    cell, bin_ = np.nonzero(counts)
    low = (q @ p.T)[:, cell] - np.sqrt((q**2).sum(1))[:, None] * upper[bin_]
    order = np.argsort(-low, 1)
    enough = np.cumsum(counts[cell, bin_][order], 1) > k
    some = enough.any(1)
    at = enough.argmax(1)
    rows = np.arange(len(q))
    found = np.where(some, low[rows, order[rows, at]], -np.inf)
    least = np.maximum(least, found)
    return least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) - 1e-6


def needed(q: np.ndarray, p: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(query, cell): the least distance from a cell's pivot at which a vector can score ``least``."""
    norm = np.sqrt((q**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = (least[:, None] - q @ p.T) / norm[:, None]
    need = np.where(norm[:, None] > 0, need, -np.inf)
    return need - 1e-9 * np.abs(np.where(np.isfinite(need), need, 0)) - 1e-6


def grouped(p: np.ndarray, held: dict[int, int], size: int) -> dict[int, int]:
    """A group for each cell that holds queries: neighbours in a chain of nearest pivots, ``size`` queries at least."""
    left, chain = sorted(held), []
    while left:
        at = left[0] if not chain else min(left, key=lambda c: (((p[c] - p[chain[-1]]) ** 2).sum(), c))
        left.remove(at)
        chain.append(at)
    out, group, n = {}, 0, 0
    for c in chain:
        out[c] = group
        n += held[c]
        if n >= size:
            group, n = group + 1, 0
    return out


def _nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = (m**2).sum(1)[:, None] - 2 * m @ pivots.T + (pivots**2).sum(1)
    cell = apart.argmin(1)
    return cell, np.sqrt(np.maximum(((m - pivots[cell]) ** 2).sum(1), 0))


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products, exact."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries @ data.T).astype(np.int64)
    low, high = LEAST, -LEAST
    exact = np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in data], object).reshape(data.shape).T
    return np.array([[min(max(x, low), high) for x in r] for r in exact], np.int64).reshape(exact.shape)


LEAST = -(1 << 63) + 1


class _Best:
    """The k best results of each query of a block so far, as flat arrays ordered by query."""

    def __init__(self, block: dict, k: int):
        self.block, self.k = block, k
        self.least = np.full(len(block["row"]), LEAST)  # the score to reach
        self.q, self.score, self.nil, self.id, self.row = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))

    def add(self, row: np.ndarray, vec_id: np.ndarray, nil: np.ndarray, m: np.ndarray) -> None:
        for a in range(0, len(row), CHUNK):
            self._add(*(x[a : a + CHUNK] for x in (row, vec_id, nil, m)))

    def _add(self, row: np.ndarray, vec_id: np.ndarray, nil: np.ndarray, m: np.ndarray) -> None:
        s, least = scores(self.block["m"], m), self.least
        n = s.shape[1]
        if n > self.k + 1:  # one more than k: the query itself may be among them
            least = np.maximum(least, np.partition(s, n - self.k - 1, 1)[:, n - self.k - 1])
        q, j = np.nonzero((s >= least[:, None]) & (self.block["row"][:, None] != row))
        both = [np.concatenate(x) for x in ((self.q, q), (self.score, s[q, j]), (self.nil, nil[j]), (self.id, vec_id[j]), (self.row, row[j]))]
        order = np.lexsort((both[4], both[3], both[2], -both[1], both[0]))
        both = [x[order] for x in both]
        rank = np.arange(len(order)) - np.searchsorted(both[0], both[0])
        self.q, self.score, self.nil, self.id, self.row = (x[rank < self.k] for x in both)
        full = rank == self.k - 1
        self.least[both[0][full]] = both[1][full]

    def rows(self) -> Iterator[pa.RecordBatch]:
        own = self.block
        yield pa.RecordBatch.from_arrays(
            [pa.array(own["row"][self.q]), pa.array(own["id"][self.q], mask=own["nil"][self.q]), pa.array(self.row), pa.array(self.id, mask=self.nil), pa.array(self.score)],
            names=["query_row", "query_id", "row", "vec_id", "score"],
        )


BLOBS = "block string, data boolean, rows binary, ids binary, nils binary, m binary"
_BLOBS = pa.schema([("block", pa.string()), ("data", pa.bool_()), ("rows", pa.binary()), ("ids", pa.binary()), ("nils", pa.binary()), ("m", pa.binary())])


@lean
def _solve(batches: Iterator[pa.RecordBatch], dims: int, kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by block, its queries (in several rows) first -> each query's best k in this task."""
    best, now, waiting = None, None, []
    for b in batches:
        for r in b.to_pylist():
            if r["block"] != now:
                if best:
                    yield from best.rows()
                now, best, waiting = r["block"], None, []
            x = {"row": np.frombuffer(r["rows"], np.int64), "id": np.frombuffer(r["ids"], np.int64), "nil": np.frombuffer(r["nils"], bool), "m": np.frombuffer(r["m"], kind).reshape(-1, dims).astype(float)}
            if not r["data"]:
                waiting.append(x)
                continue
            if best is None:
                if not waiting:
                    continue
                best = _Best({key: np.concatenate([w[key] for w in waiting]) for key in x}, k)
            best.add(x["row"], x["id"], x["nil"], x["m"])
    if best:
        yield from best.rows()


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest scores among all other rows.

    ``report`` gets "share": the pairs of a query and a vector that the bounds leave, of all.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "knn")
    own = scratch.table(whole_vectors(vectors, scale, id_col, vec_col, queries), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count_if("is_query").alias("queries"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(square).alias("square")).first()
    if not shape.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, tasks = int(shape.dims), max(1, spark.sparkContext.defaultParallelism)
    most = shape.most or 0.0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"  # the narrowest that holds every component
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "row"), 11) / F.lit(float(1 << 53))
    picked = own.filter(chance < min(1.0, 4 * SAMPLE / shape.n)).orderBy(chance).limit(SAMPLE).select("v").collect() or own.select("v").limit(1).collect()
    sample = np.zeros((len(picked), dims))
    for i, r in enumerate(picked):
        sample[i, : len(r.v)] = r.v
    p = centres(sample, pivots)
    width = (shape.square**0.5 + np.sqrt((p**2).sum(1)).max()) * (1 + 1e-9) / BINS + 1e-9
    upper = width * np.arange(1, BINS + 1)

    @lean
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(p), BINS), np.int64)
        for b in batches:
            cell, apart = _nearest(matrix(b.column(0), dims), p)
            np.add.at(seen, (cell, np.minimum(apart // width, BINS - 1).astype(np.int64)), 1)
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(seen[i, j])], names=["cell", "bin", "n"])

    counts = np.zeros((len(p), BINS), np.int64)
    with batches_of(spark, SLIM_ROWS):
        for r in own.select("v").mapInArrow(summary, "cell int, bin int, n long").groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect():
            counts[r.cell, r.bin] = r["n"]

    @lean
    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query cell the queries that it holds and, for each data cell, the least distance needed."""
        least, held = np.full((len(p), len(p)), np.inf), np.zeros(len(p), np.int64)
        for b in batches:
            m = matrix(b.column(0), dims)
            for a in range(0, len(m), CHUNK):
                q = m[a : a + CHUNK]
                cell, _ = _nearest(q, p)
                np.minimum.at(least, cell, needed(q, p, reached(q, p, sample, counts, upper, k)))
                np.add.at(held, cell, 1)
        c = np.flatnonzero(held)
        i, j = np.repeat(c, len(p)), np.tile(np.arange(len(p)), len(c))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(least[i, j]), pa.array(held[i])], names=["cell", "to", "need", "n"])

    held: dict[int, int] = {}
    need = np.full((len(p), len(p)), np.inf)
    with batches_of(spark, SLIM_ROWS):
        for r in own.filter("is_query").select("v").mapInArrow(needs, "cell int, to int, need double, n long").groupBy("cell", "to").agg(F.min("need").alias("need"), F.sum("n").alias("n")).collect():
            need[r.cell, r.to], held[r.cell] = r.need, r["n"]
    group_of = grouped(p, held, BLOCK // 2)
    groups = sorted(set(group_of.values()))
    from_ = np.stack([np.min([need[c] for c, x in group_of.items() if x == g], 0) for g in groups])  # group, data cell
    size = {g: sum(held[c] for c, x in group_of.items() if x == g) for g in groups}
    blocks = {g: -(-size[g] // BLOCK) for g in groups}
    splits = max(1, -(-max(2 * tasks, partitions(spark)) // sum(blocks.values())))
    to_group = np.array([group_of.get(c, -1) for c in range(len(p))])
    if report is not None:
        left = sum(size[g] * int((counts * (upper >= from_[g][:, None])).sum()) for g in groups)
        report["share"] = left / (sum(held.values()) * shape.n)

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, vec_id, v, is_query) -> blobs: queries to every split of their block, vectors to one."""

        def packed(name: str, data: bool, row, ids, nil, m) -> dict:
            return {"block": name, "data": data, "rows": row.tobytes(), "ids": ids.tobytes(), "nils": nil.tobytes(), "m": m.astype(kind).tobytes()}

        waiting: dict[int, list] = {g: [] for g in groups}  # vectors on their way to a group, until they fill a row
        number, turn = dict.fromkeys(groups, 0), None

        def send(g: int) -> list[dict]:
            nonlocal turn
            parts = [np.concatenate(x) for x in zip(*waiting[g], strict=True)]
            waiting[g], number[g], turn = [], 0, turn + 1
            return [packed(f"{g}.{x}.{turn % splits}", True, *parts) for x in range(blocks[g])]

        for b in batches:
            out: list[dict] = []
            row, nil = b.column("row").to_numpy(), b.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            ids, m = b.column("vec_id").fill_null(0).to_numpy(), matrix(b.column("v"), dims)
            if turn is None and len(row):  # tasks begin with different splits
                turn = int(row[0]) * 0x9E3779B97F4A7C15 >> 29
            cell, apart = _nearest(m, p)
            q = np.flatnonzero(b.column("is_query").to_numpy(zero_copy_only=False))
            if len(q):
                group = to_group[cell[q]]
                block = (row[q].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.array([blocks[g] for g in group])
                for g, x in set(zip(group.tolist(), block.tolist(), strict=True)):
                    some = q[(group == g) & (block == x)]
                    out += [packed(f"{g}.{x}.{s}", False, row[some], ids[some], nil[some], m[some]) for s in range(splits)]
            for i, g in enumerate(groups):
                near = np.flatnonzero(apart >= from_[i][cell])
                for a in range(0, len(near), ROWS):
                    some = near[a : a + ROWS]
                    waiting[g].append((row[some], ids[some], nil[some], m[some].astype(kind)))
                    number[g] += len(some)
                    if number[g] >= ROWS:
                        out += send(g)
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pylist(out, _BLOBS)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _BLOBS)
        for g in groups:
            if waiting[g]:
                yield pa.RecordBatch.from_pylist(send(g), _BLOBS)

    merged = own.mapInArrow(place, BLOBS).repartition("block").sortWithinPartitions("block", "data").mapInArrow(lambda b: _solve(b, dims, kind, k), SCORED)
    scored = scratch.table(merged, "scored")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
