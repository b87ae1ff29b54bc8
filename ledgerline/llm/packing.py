"""Best-fit packing of token sequences by large-item matching.

Pieces above a third of the capacity pair at most twice per bin, greedily: the largest takes the
largest that still fits beside it. Smaller pieces, longest first, go to the bin whose gap they fill
best; what is left opens bins of its own. All of this is done on the counts of pieces by length (at
most ``capacity`` numbers, whatever the input), for as many equal bins at a time as there are; every
piece then finds its bin by its rank among the pieces of its length.

Defined results: a null or empty text is the one token that ends every document; longer documents
are cut into full pieces of which only the first may be shorter; repeated rows are packed each;
ties in length are ranked by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepare, Scratch
from .tokens import tokens

#: Pieces of one length that are ranked together: at least LEAST, and at most a PARTS-th of all, so that
#: a frequent length is spread and at most PARTS + capacity counts reach the driver. Texts tokenized at once.
LEAST, PARTS, ROWS = 1000, 1 << 16, 128


class _Gaps:
    """Groups of equal open bins by free space. A group: [bins, lengths placed so far]."""

    def __init__(self) -> None:
        self.spaces: list[int] = []
        self.groups: dict[int, list[list]] = defaultdict(list)

    def put(self, space: int, group: list) -> None:
        if not self.groups[space]:
            insort(self.spaces, space)
        self.groups[space].append(group)

    def take(self, least: int, most: int) -> tuple[int, int, tuple] | None:
        """Up to ``most`` bins of the smallest gap of at least ``least``: (gap, bins, lengths)."""
        at = bisect_left(self.spaces, least)
        if at == len(self.spaces):
            return None
        space = self.spaces[at]
        group = self.groups[space][-1]
        n = min(most, group[0])
        group[0] -= n
        if not group[0]:
            self.groups[space].pop()
            if not self.groups[space]:
                self.spaces.pop(at)
        return space, n, group[1]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(bins, lengths in each): bins of each kind that hold all pieces of ``counts``."""
    left, gaps = {k: v for k, v in counts.items() if v}, _Gaps()
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            gaps.put(capacity - a, [left[a], (a,)])
            large.pop()
            continue
        b = large[at]
        n = min(left[a], left[b]) if a != b else left[a] // 2
        if n:
            gaps.put(capacity - a - b, [n, (a, b)])
            left[a] -= n
            left[b] -= n
        elif a == b:  # one is left, and may pair with a shorter one
            if at == 0:
                gaps.put(capacity - a, [1, (a,)])
            else:
                c = large[at - 1]
                gaps.put(capacity - a - c, [1, (a, c)])
                left[c] -= 1
                if not left[c]:
                    large.remove(c)
            left[a] = 0
        for x in {a, b}:
            if not left[x]:
                large.remove(x)
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[k]
        while n and (found := gaps.take(k, n)):
            space, bins, held = found
            gaps.put(space - k, [bins, (*held, k)])
            n -= bins
        if n:
            each = capacity // k
            if n // each:
                gaps.put(capacity - each * k, [n // each, (k,) * each])
            if n % each:
                gaps.put(capacity - n % each * k, [1, (k,) * (n % each)])
    return [(n, held) for space in gaps.spaces for n, held in gaps.groups[space]]


def runs(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of its runs, and of each run the first bin and the place in a bin."""
    out: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for n, held in bins:
        at = 0
        for k in held:
            for column, value in zip(out[k], (ranks[k], first, at), strict=True):
                column.append(value)
            ranks[k] += n
            at += k
        first += n
    return {k: tuple(np.array(c, np.int64) for c in v) for k, v in out.items()}


@lean
def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end: int, paths: tuple) -> Iterator[pa.RecordBatch]:
    encode = tokens(*paths)
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for i, text in enumerate(b.column(1).to_pylist()):
            ids = encode.packed(text or "", end)
            n = len(ids) // 4
            head = n % capacity or capacity
            for piece, start in enumerate((0, *range(head, n, capacity))):
                length = capacity if piece else head
                for column, value in zip(rows, (i, piece, start, length, ids[4 * start : 4 * (start + length)]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])


def cut(docs: DataFrame, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", paths: tuple = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids): the documents' tokens in pieces of at most ``capacity``."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids binary").fields])
    return own.mapInArrow(lambda b: _pieces(b, capacity, end, paths), schema)


def number(pieces: DataFrame) -> DataFrame:
    """``pieces`` with a number of each row, to be stored with it: later jobs may split their scans differently."""
    return pieces.withColumn("row", F.monotonically_increasing_id())


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (stored; with length and row, unique numbers) plus sequence_id and offset, without row.

    Full pieces are sequences of their own, numbered after all others. The rest are ranked among those of
    their length, in parts of a fair share of all rows, so only lengths, parts and ranks are planned.
    """
    by_length = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect() if r.length < capacity}
    share = max(LEAST, -(-sum(by_length.values()) // PARTS))
    crowded = pieces.sparkSession.createDataFrame([(k, -(-n // share)) for k, n in by_length.items() if n > share], "length long, parts int")  # at most capacity rows
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("long")
    short = pieces.filter(F.col("length") < capacity).join(F.broadcast(crowded), "length", "left").withColumn("part", part).drop("parts")
    counted = {(r.length, r.part): r["n"] for r in short.groupBy("length", "part").agg(F.count("*").alias("n")).collect()}
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = defaultdict(int)
    for length, salt in sorted(counted):
        before[length, salt] = counts[length]
        counts[length] += counted[length, salt]
    bins = plan(counts, capacity)
    found, used = runs(bins), sum(n for n, _ in bins)
    fields = [f for f in pieces.schema.fields if f.name != "row"]
    schema = T.StructType([*fields, *T.StructType.fromDDL("sequence_id long, offset long").fields])

    @lean
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy() for c in ("length", "part", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            rank = rank + np.array([before[k] for k in zip(length.tolist(), salt.tolist(), strict=True)], np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                first, first_bin, at = found[int(k)]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = first_bin[run] + rank[own] - first[run]
                offset[own] = at[run]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(sequence), pa.array(offset)], names=schema.names)

    ranked = short.withColumn("rank", (F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1).cast("long"))
    full = pieces.filter(F.col("length") == capacity).select(*[f.name for f in fields], (F.lit(used) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.drop("row").mapInArrow(seat, schema).unionByName(full)


def pack(docs: DataFrame, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", paths: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, stored; and (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    stored = Scratch(docs.sparkSession, "packing").table(number(cut(docs, capacity, end, id_col, text_col, paths)), "pieces", ROWS)
    placed = place(stored.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row"), capacity)
    return stored.drop("row"), placed
