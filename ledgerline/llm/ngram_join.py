"""N-gram Jaccard self-join: all links between documents whose shingle sets overlap enough, exactly.

1. Every whole text becomes a set of hashed word shingles. Equal sets form one class, so copies
   cost nothing further.
2. Sets go to size bands in which a band and the next hold every possible partner. In the tile of
   two bands at most H shingles can differ, so when the hash range is cut into more than H parts, a
   linked pair agrees on a whole part: parts are signed, and sets with equal signatures meet. A set
   with so many empty parts that these could be all that it shares also signs its first shingles in
   hash order, as many as it takes for linked sets to have one in common.
3. Sets that meet are compared by hashed bitmaps (a bit is the parity of the shingles hashed to it):
   differing bits cannot exceed differing shingles, which bounds the overlap from above. What passes
   connects; the connected groups (found without leaving the executors) hold all links. This is done
   in two rounds. Round one takes an eighth of the meetings and deals a crowded one over tasks that
   each compare a part of it with one common set. Round two takes what round one has not settled and
   compares only sets of different groups: those outside a meeting's largest group, in blocks, with
   all of it. No task holds more than two blocks, and all pairs across groups are compared.
4. A group's sets meet in size-banded tiles: one tile if the group is small; else its bands are cut
   into blocks and each pair of blocks that can hold partners is a tile, so no task holds more than
   two blocks. In a tile, pairs that pass the bitmap bound are intersected exactly as sorted arrays.
   Links are counted and unions kept in the tile; pairs are never emitted.

Defined results: a null or wordless text has no shingles, is its own component and has no link;
repeated rows are linked; a null id is a component's id only if it has no other; an empty table
gives an empty result; other columns are ignored (``join``) or kept, whatever their names
(``keep_one``). Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, maybe, partitions, prepare, Scratch, without
from .components import components
from .shingles import U, digest, mix, shingle_set

#: Postings that a worker holds before it hands them on, bytes of postings a task is to read, least
#: bits of a bitmap, parts beyond those that the bound asks for, digests a worker remembers.
FLUSH, TASK_BYTES, BITS, SPARE, SEEN = 1_000_000, 24 << 20, 256, 2, 300_000
#: Most shingles and most sets of a block of a tile, and most sets of a block of a meeting: a task's fair
#: share of all, within these bounds. They decide how work is dealt, not what is compared.
BLOCK, CROWD = (4_000, 2_000_000), (64, 4096)


@dataclass(frozen=True)
class Rule:
    """Sets A, B link when den * |A & B| >= num * |A | B|, shingles of ``k`` words."""

    k: int = 5
    num: int = 80
    den: int = 100

    def apart(self, both: int) -> int:
        """Shingles by which two linked sets with sizes adding up to ``both`` can differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def partner(self, size: int) -> int:
        """The largest size that can link with ``size``."""
        return size * self.den // self.num

    def edges(self) -> np.ndarray:
        """Least sizes of the bands, up to 2**40."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(self.partner(out[-1]) + 1)
        return np.array(out)


def signatures(rule: Rule, edges: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What ``s`` signs in the tiles of its band and of the band below."""
    band, out = int(np.searchsorted(edges, len(s), "right")) - 1, []
    for tile in (band, band - 1):
        if tile < 0:
            continue
        most = int(edges[tile + 1]) - 1
        h = rule.apart(most + rule.partner(most))
        if not h:
            continue  # only equal sets link
        n = h + 1 + SPARE
        part = ((s >> U(32)) * U(n)) >> U(32)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mix(s), start)
        salt = mix(part[start] + U(tile << 40))
        out.append(mix(sums ^ salt))
        if n - len(start) > SPARE:
            first = s[: len(s) - -(-rule.num * len(s) // rule.den) + 1]
            out.append(mix(mix(first + U(tile << 40)) + U(1)))
    return np.concatenate(out) if out else np.empty(0, U)


@lean
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, key, text) -> (id, key, n, digest, bits)."""
    for b in batches:
        sets = [shingle_set(t or b"", k) for t in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.array([bitmap(s, width(len(s))).tobytes() for s in sets], pa.binary())], names=["id", "key", "n", "digest", "bits"])


@lean
def _postings(batches: Iterator[pa.RecordBatch], rule: Rule, keys: list[int]) -> Iterator[pa.RecordBatch]:
    """(text) -> (key, sigs, who, refs): signatures of many sets, dealt by signature, as packed arrays.

    48 bits of a signature are enough among those dealt to one task: what meets by chance is parted later.
    """
    edges, seen = rule.edges(), set()
    sigs: list[np.ndarray] = []
    refs: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        sig, ref = np.concatenate(sigs), np.concatenate(refs)
        to = (sig % U(len(keys))).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(len(keys) + 1))
        rows: list[list] = [[], [], [], []]
        for key, a, z in zip(keys, cut[:-1], cut[1:], strict=True):
            for i in range(a, z, 65_535):
                part = order[i : min(z, i + 65_535)]
                own, who = np.unique(ref[part], return_inverse=True)
                for column, value in zip(rows, (key, sig[part].view(np.uint16).reshape(-1, 4)[:, :3].tobytes(), who.astype(np.uint16).tobytes(), own.tobytes()), strict=True):
                    column.append(value)
        sigs.clear()
        refs.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["key", "sigs", "who", "refs"])

    held = 0
    for b in batches:
        for text in b.column(0).cast(pa.binary()).to_pylist():
            s = shingle_set(text or b"", rule.k)
            if not len(s) or (d := digest(s)) in seen:
                continue  # the same set, already signed here
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(d)
            own = signatures(rule, edges, s)
            sigs.append(own)
            refs.append(np.full(len(own), np.frombuffer(d, np.int64)[0]))
            held += len(own)
            if held >= FLUSH:
                yield flush()
                held = 0
    if held:
        yield flush()


def width(size: int) -> int:
    """Bits of the bitmap of a set: a power of two, at least three quarters of its size."""
    return max(BITS, 1 << (3 * size // 4).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the numbers of shingles hashed to each bit, packed."""
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(U)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought to fewer words."""
    # packed bit b of 2w bits falls on bit b mod w: the halves are xor-ed
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


@lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings of one task -> (meeting, ref): sets that share a signature, each such group once."""
    sigs, refs = [], []
    for b in batches:
        for sig, who, own in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            whole = np.zeros((len(who) // 2, 4), np.uint16)
            whole[:, :3] = np.frombuffer(sig, np.uint16).reshape(-1, 3)
            sigs.append(whole.view(U).ravel())
            refs.append(np.frombuffer(own, np.int64)[np.frombuffer(who, np.uint16)])
    if not sigs:
        return
    sig, ref = np.concatenate(sigs), np.concatenate(refs)
    order = np.argsort(sig, kind="stable")
    sig, ref = sig[order], ref[order]
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    many = ~(new & np.concatenate((new[1:], [True])))
    order = np.lexsort((ref[many], sig[many]))
    sig, ref = sig[many][order], ref[many][order]
    once = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])))[: len(sig)]
    sig, ref = sig[once], ref[once]
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)])
    if not len(start):
        return
    size = np.diff(np.append(start, len(sig)))
    name = np.add.reduceat(mix(ref.view(U)), start) + size.astype(U)
    _, first = np.unique(name, return_index=True)
    keep = np.zeros(len(start), bool)
    keep[first] = True
    keep &= size > 1
    rows = np.repeat(keep, size)
    meeting, ref = np.repeat(name.view(np.int64), size)[rows], ref[rows]
    for a in range(0, len(ref), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(meeting[a : a + 100_000]), pa.array(ref[a : a + 100_000])], names=["meeting", "ref"])


def connect(rule: Rule, n: np.ndarray, maps: list[np.ndarray], group: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Places of sets to be connected, of sizes ``n``: pairs of different groups within the bitmap bound.

    Sides 0 and 1: only pairs across are compared; side 2: all pairs.
    """
    order = np.argsort(n, kind="stable")
    n, side, across = n[order], side[order], int(side[0]) != 2
    _, first, label = np.unique(group[order], return_index=True, return_inverse=True)
    label = first[label]
    least = min(len(m) for m in maps)
    if max(len(m) for m in maps) == least:
        whole = np.stack(maps)[order]
    else:  # nearby sizes have at most two widths; the rest cannot be partners
        whole = None
    found = []
    for i in range(len(n) - 1):
        to = int(np.searchsorted(n, rule.partner(int(n[i])), "right"))
        j = np.arange(i + 1, to)
        j = j[label[j] != label[i]]
        if across:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        if whole is not None:
            apart = np.bitwise_count(whole[j] ^ whole[i]).sum(1, dtype=np.int64)
        else:
            own = maps[order[i]]
            apart = np.array([np.bitwise_count(fold(maps[order[x]], len(own)) ^ own).sum() for x in j], np.int64)
        j = j[apart <= (n[j] + n[i]) * (rule.den - rule.num) // (rule.den + rule.num)]
        for x in np.unique(label[j]):
            if x != label[i]:
                low, high = min(x, label[i]), max(x, label[i])
                label[label == high] = low
                found.append((int(order[high]), int(order[low])))
    return found


@lean
def _near(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(meeting, tile, ref, grp, side, n, bits) sorted by the first two -> edges (a, b) that connect what may be linked."""

    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        ref, group, side, n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4])
        return [(int(ref[a]), int(ref[b])) for a, b in connect(rule, n, [np.frombuffer(r[4], U) for r in rows], group, side)]

    def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    now, rows = None, []
    for b in batches:
        out: list[tuple[int, int]] = []
        for meeting, tile, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (meeting, tile) != now:
                if len(rows) > 1:
                    out += edges(rows)
                now, rows = (meeting, tile), []
            rows.append(rest)
        if out:
            yield batch(out)
    if len(rows) > 1 and (out := edges(rows)):
        yield batch(out)


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of sorted ``s`` with sorted ``others``."""
    ends = list(accumulate(len(x) for x in others))
    whole = np.concatenate(others)
    at = np.searchsorted(s, whole)
    at[at == len(s)] = 0
    return np.diff(np.concatenate(([0], np.cumsum(s[at] == whole)[np.array(ends) - 1])))


def solve(rule: Rule, sides: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of a tile: the place of each one's class leader, and its links counted with copies.

    Sides 0 and 1: only pairs across are compared; side 2: all pairs.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, across = n[order], int(sides[0]) != 2
    bits = width(int(n[-1]))
    maps = np.stack([bitmap(sets[i], bits) for i in order])
    side, copies = sides[order], copies[order]
    links, label = np.zeros(len(n), np.int64), np.arange(len(n))
    for i in range(len(n) - 1):
        to = int(np.searchsorted(n, rule.partner(int(n[i])), "right"))
        j = np.arange(i + 1, to)
        if across:
            j = j[side[j] != side[i]]
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
        j = j[apart <= (n[j] + n[i]) * (rule.den - rule.num) // (rule.den + rule.num)]
        for a in range(0, len(j), 512):
            part = j[a : a + 512]
            common = overlaps(sets[order[i]], [sets[order[x]] for x in part])
            part = part[rule.den * common >= rule.num * (n[part] + n[i] - common)]
            links[part] += copies[i]
            links[i] += copies[part].sum()
            for x in np.unique(label[part]):
                if x != label[i]:
                    low, high = min(x, label[i]), max(x, label[i])
                    label[label == high] = low
    leader, count = np.empty_like(label), np.empty_like(links)
    leader[order], count[order] = order[label], links
    return leader, count


@lean
def _tiles(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(tile, side, digest, copies, text) sorted by tile -> (digest, leader, links)."""

    def solved(rows: dict) -> pa.RecordBatch:
        digests = list(rows)
        sides, copies, sets = (list(c) for c in zip(*rows.values(), strict=True))
        leader, links = solve(rule, np.array(sides), np.array(copies), sets)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([digests[i] for i in leader], pa.binary()), pa.array(links)], names=["digest", "leader", "links"])

    now, rows = None, {}
    for b in batches:
        for tile, side, name, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tile != now and rows:
                yield solved(rows)
                rows = {}
            now = tile
            if name not in rows:  # repeated rows are one set
                rows[name] = (side, copies, shingle_set(text.encode(), rule.k))
    if rows:
        yield solved(rows)


def _dealt_keys(df: DataFrame, parts: int) -> list[int]:
    """For each of ``parts`` partitions an integer that repartition() sends there."""
    where = df.sparkSession.range(parts * 40 + 200).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id"))
    return [r.id for r in where.collect()]


def _upto(n: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), n), F.lit(1), n)


def _with_tiles(members: DataFrame, edges: np.ndarray, block: int, crowd: int) -> DataFrame:
    """Adds tiles, an array of (tile, side), to (grp, n, digest, ...)."""
    sorted_edges = F.array(*[F.lit(int(e)) for e in edges])
    banded = members.withColumn("band", F.size(F.filter(sorted_edges, lambda e: e <= F.col("n"))) - 1)
    sizes = banded.groupBy("grp", "band").agg(F.greatest(F.sum("n") / block, F.count("*") / crowd).alias("w"))
    large = (
        sizes.groupBy("grp")
        .agg(F.sum("w").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil("w").cast("int")))).alias("cuts"))
        .filter(F.col("all") > 1)
        .drop("all")
    )
    cut = banded.join(large, "grp", "left")
    blocks = lambda off: F.coalesce(F.try_element_at("cuts", F.col("band") + off), F.lit(0))
    own = F.pmod(F.xxhash64("digest"), F.greatest(blocks(0), F.lit(1))).cast("int")
    tile = lambda kind, band, i, j: F.concat_ws(".", F.col("grp").cast("string"), F.lit(kind), band, i, j)
    many = F.concat(
        F.transform(_upto(blocks(0)), lambda j: F.struct(tile("s", F.col("band"), F.least(own, j), F.greatest(own, j)).alias("tile"), F.when(own == j, 2).otherwise((own > j).cast("int")).alias("side"))),
        F.transform(_upto(blocks(1)), lambda j: F.struct(tile("x", F.col("band"), own, j).alias("tile"), F.lit(0).alias("side"))),
        F.transform(_upto(blocks(-1)), lambda j: F.struct(tile("x", F.col("band") - 1, j, own).alias("tile"), F.lit(1).alias("side"))),
    )
    one = F.array(F.struct(F.col("grp").cast("string").alias("tile"), F.lit(2).alias("side")))
    return cut.withColumn("tiles", F.when(F.col("cuts").isNull(), one).otherwise(many))


def _parts(crowd: int, of: Column) -> Column:
    return F.ceil(of / crowd).cast("int")


def _first_look(met: DataFrame, crowded: DataFrame, crowd: int) -> DataFrame:
    """(meeting, tile, ref, grp, side): meetings as they are, ``crowded`` ones (meeting, m, anchor) in parts.

    Every part of a crowded meeting holds its anchor, so parts that it connects come together.
    """
    alone = {"grp": F.col("ref"), "side": F.lit(2)}
    tile = F.when(F.col("m").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("ref"), _parts(crowd, F.col("m"))).cast("int"))
    rows = met.join(crowded, "meeting", "left").filter("anchor is null or ref <> anchor").select("meeting", tile.alias("tile"), "ref")
    anchors = crowded.select("meeting", F.explode(_upto(_parts(crowd, F.col("m")))).alias("tile"), F.col("anchor").alias("ref"))
    return rows.unionByName(anchors).withColumns(alone)


def _second_look(known: DataFrame, unsettled: DataFrame, crowd: int) -> DataFrame:
    """(meeting, tile, ref, grp, side): what of ``known`` (meeting, ref, grp) is to be compared across groups.

    ``unsettled``: (meeting, m, top, minor), minor of m sets being outside its largest group ``top``.
    """
    rows = known.join(unsettled, "meeting")
    outside = F.col("grp") != F.col("top")
    q, r = _parts(crowd, F.col("minor")), _parts(crowd, F.col("m") - F.col("minor"))
    own = F.pmod(F.xxhash64("ref"), F.when(outside, q).otherwise(r)).cast("int")
    entry = lambda a, b, side: F.struct(F.concat_ws(".", a, b).alias("tile"), side.cast("int").alias("side"))
    minors = F.concat(
        F.transform(_upto(q), lambda j: entry(F.least(own, j), F.greatest(own, j), F.when(own == j, 2).otherwise((own > j).cast("int")))),
        F.transform(_upto(r), lambda j: F.struct(F.concat_ws("x", own, j).alias("tile"), F.lit(0).alias("side"))),
    )
    majors = F.transform(_upto(q), lambda i: F.struct(F.concat_ws("x", i, own).alias("tile"), F.lit(1).alias("side")))
    one = F.array(F.struct(F.lit("all").alias("tile"), F.lit(2).alias("side")))
    tiles = F.when(F.col("m") <= crowd, one).when(outside, minors).otherwise(majors)
    return rows.select("meeting", F.explode(tiles).alias("t"), "ref", "grp").select("meeting", "t.tile", "ref", "grp", "t.side")


def _fair(total: int, tasks: int, bounds: tuple[int, int]) -> int:
    return min(max(total // tasks, bounds[0]), bounds[1])


def _groups(texts: DataFrame, reps: DataFrame, ref: Column, rule: Rule, scratch: Scratch, parts: int) -> DataFrame:
    """(node, label): groups of sets, named by ``ref``, that hold all links."""
    spark = texts.sparkSession
    keys = _dealt_keys(texts, parts)
    postings = texts.select("text").mapInArrow(lambda b: _postings(b, rule, keys), "key long, sigs binary, who binary, refs binary")
    met = scratch.table(postings.repartition(parts, "key").mapInArrow(_meet, "meeting long, ref long").distinct(), "met")
    sketches = reps.select(ref.alias("ref"), "n", "bits")

    def near(rows: DataFrame) -> DataFrame:
        rows = rows.join(sketches, "ref").select("meeting", "tile", "ref", "grp", "side", "n", "bits")
        return rows.repartition("meeting", "tile").sortWithinPartitions("meeting", "tile").mapInArrow(lambda b: _near(b, rule), "a long, b long")

    # copies of one text meet many times: an eighth of the meetings settles most of their groups
    early = F.pmod(F.xxhash64("meeting"), F.lit(8)) == 0
    crowd = _fair(met.filter(early).count(), partitions(spark), CROWD)
    crowded = scratch.table(met.filter(early).groupBy("meeting").agg(F.count("*").alias("m"), F.min("ref").alias("anchor")).filter(F.col("m") > crowd), "crowded")
    first = scratch.table(components(scratch, near(_first_look(met.filter(early), crowded, crowd)), "first"), "first")
    open_ = met.join(crowded.select("meeting", F.lit(True).alias("again")), "meeting", "left").filter(~early | F.col("again")).select("meeting", "ref")
    known = scratch.table(open_.join(first.withColumnRenamed("node", "ref"), "ref", "left").select("meeting", "ref", F.coalesce("label", "ref").alias("grp")), "known")
    scratch.free("met")
    by_group = known.groupBy("meeting", "grp").agg(F.count("*").alias("c")).groupBy("meeting")
    unsettled = by_group.agg(F.sum("c").alias("m"), F.count("*").alias("groups"), F.max(F.struct("c", "grp")).alias("top")).filter("groups > 1")
    unsettled = scratch.table(unsettled.select("meeting", "m", F.col("top.grp").alias("top"), (F.col("m") - F.col("top.c")).alias("minor")), "unsettled")
    later = near(_second_look(known, unsettled, _fair(unsettled.agg(F.sum("m")).first()[0] or 0, partitions(spark), CROWD)))
    found = components(scratch, later.unionByName(first.select(F.col("node").alias("a"), F.col("label").alias("b"))), "near")
    scratch.free("known")
    return found


def _joined(docs: DataFrame, rule: Rule, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, key, n, digest, component_id, n_links, label) per row of ``docs``; label: a digest that names the component."""
    spark = docs.sparkSession
    prepare(spark)
    edges = rule.edges()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    sets = scratch.table(texts.mapInArrow(lambda b, k=rule.k: _sets(b, k), schema), "sets")
    smallest = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "key")).alias("rep")
    reps = scratch.table(sets.filter("n > 0").groupBy("digest", "n").agg(F.count("*").alias("copies"), smallest, F.first("bits").alias("bits")), "classes")

    total = reps.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(spark), -(-total // 2 * 8 // TASK_BYTES))
    ref = F.conv(F.concat(*[F.substring(F.hex("digest"), 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("long")  # its first 8 bytes, little-endian
    groups = _groups(texts, reps, ref, rule, scratch, parts)

    members = reps.withColumn("node", ref).join(groups.withColumnRenamed("label", "grp"), "node").select("grp", "n", "digest", "copies", "rep")
    block, crowd = _fair(total, partitions(spark), BLOCK), _fair(groups.count(), partitions(spark), CROWD)
    cut = scratch.table(_with_tiles(members, edges, block, crowd), "tiles")
    wanted = cut.select(F.col("rep.id").alias("rid"), F.col("rep.key").alias("rkey"), "tiles", "digest", "copies")
    likely = maybe(texts, F.col("key"), wanted.select(F.col("rkey").alias("key")), "likely").filter("likely")
    found = wanted.join(likely, wanted.rid.eqNullSafe(likely.id) & (wanted.rkey == likely.key)).select("tiles", "digest", "copies", "text")
    dealt = found.select(F.explode("tiles").alias("t"), "digest", "copies", "text").select("t.tile", "t.side", "digest", "copies", "text")
    checked = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda b: _tiles(b, rule), "digest binary, leader binary, links long")
    checked = scratch.table(checked, "checked")

    if cut.filter("cuts is not null").isEmpty():
        labels = checked.select("digest", F.col("leader").alias("label"))
    else:
        labels = components(scratch, checked.select(F.col("digest").alias("a"), F.col("leader").alias("b")), "links").select(F.col("node").alias("digest"), "label")
    links = checked.groupBy("digest").agg(F.sum("links").alias("links"))
    classed = scratch.table(reps.select("digest", "copies", "rep.id").join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest")), "classed")
    lows = scratch.table(classed.groupBy("label").agg(F.min("id").alias("component_id")), "lows")
    final = classed.join(lows, "label").join(links, "digest", "left")
    final = scratch.table(final.select("digest", "label", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "final")
    return sets.select("id", "key", "n", "digest").join(final, "digest", "left")


def join(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_key) per row of ``docs``.

    component_id: the smallest id that links reach; n_links: documents linked with this one, copies
    included; text_key: xxhash64 of the text, which with the id names the row.
    """
    return _joined(docs, rule, id_col, text_col, Scratch(docs.sparkSession, "ngram-join")).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("key").alias("text_key"),
    )


def keep_one(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, null ids last, then by text hash.

    Rows alike in id and text stay together; exact dedup is what parts them."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.table(_joined(docs, rule, id_col, text_col, scratch).filter("n > 0 and n_links > 0").select("id", "key", "label"), "linked")
    stays = scratch.table(found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "key")).alias("stays")), "stays")
    gone = found.join(stays, "label").filter("not (id <=> stays.id and key = stays.key)").select("id", "key").distinct()
    return without(docs, scratch.table(gone, "gone"), id_col, text_col)
