"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries sketch over the digests finds frequent ones; their exact counts and winners are
verified and, being at most ``top`` rows, broadcast, so rows of large groups never meet in one
task. The remaining digests are grouped by an ordinary shuffle: counted and their winners found
before they are shuffled, then joined back from a stored table, whose frequent keys adaptive
execution deals over tasks.

Defined results: a null text counts as empty; empty texts are equal to each other; of rows that
agree in text and id exactly one stays; a null id loses against any other; an empty table gives an
empty result; columns besides id and text are ignored (``flag_copies``) or kept (``drop_copies``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, maybe, text_or_empty, without

#: Winners that may be broadcast, and counters that each sketch keeps. A digest held by more than
#: about 7 / TRACKED of all rows is always found.
TOP, TRACKED = 2048, 8192


def _winners(digests: DataFrame, top: int, tracked: int) -> DataFrame:
    """(sha, best, copies) of frequent digests, verified against all rows; at most ``top`` rows."""
    found = digests.agg(F.expr(f"approx_top_k(sha, {top}, {tracked})").alias("t")).select(F.explode("t.item").alias("sha"))
    return (
        digests.join(F.broadcast(found), "sha")
        .groupBy("sha")
        .agg(F.max("best").alias("best"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def flag_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.table(
        docs.select(
            F.sha2(text_or_empty(text_col), 256).alias("sha"),
            F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("best"),
        ),
        "digests",
    )
    heavy = scratch.table(_winners(digests, top, tracked), "winners")
    own = digests.withColumnRenamed("best", "own")
    frequent = own.join(F.broadcast(heavy), "sha")
    rest = own.join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
    groups = scratch.table(rest.groupBy("sha").agg(F.max("own").alias("best"), F.count("*").alias("copies")).filter("copies > 1"), "groups")
    rest = rest.join(groups, "sha", "left").select("sha", "own", F.coalesce("best", "own").alias("best"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    return frequent.select("sha", "own", "best", "copies").unionByName(rest).select(
        F.col("own.id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("own.row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Copies of frequent texts go before any shuffle; of the others, winners are settled on digests and
    ids alone, and only rows that may be copies are joined with the losers. Rows that repeat a winner's
    id and text fall together in an aggregation that begins before its shuffle.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    sha, best, twin = (free_name(docs, f"__{x}") for x in ("sha", "best", "twin"))
    digest = F.sha2(text_or_empty(text_col), 256)
    digests = scratch.table(docs.select(digest.alias("sha"), F.struct(F.col(id_col).alias("id")).alias("best"), F.xxhash64(F.col(text_col)).alias("key")), "digests")
    heavy = scratch.table(_winners(digests, top, tracked), "winners")
    rest = digests.join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
    groups = scratch.table(rest.groupBy("sha").agg(F.max("best").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "groups")
    met = scratch.table(rest.join(groups, "sha").select("key", F.col("best.id").alias("id"), F.col("best").eqNullSafe(F.col("first")).alias("won")), "met")
    gone = scratch.table(met.filter(~F.col("won")).select("id", "key").distinct(), "losers")
    heavy = heavy.select(F.col("sha").alias(sha), F.col("best").alias(best))
    left = docs.withColumn(sha, digest).join(F.broadcast(heavy), sha, "left")
    left = left.filter(F.col(best).isNull() | F.col(id_col).eqNullSafe(F.col(f"{best}.id")))
    twins = digests.join(F.broadcast(heavy), (F.col("sha") == F.col(sha)) & F.col("best").eqNullSafe(F.col(best))).select("key", F.col("best.id").alias("id"))
    twins = twins.unionByName(met.filter("won").select("key", "id")).groupBy("key", "id").agg(F.count("*").alias("n")).filter("n > 1")
    twins = scratch.table(twins.select("id", "key"), "twins")
    left = without(left.select(*[F.col(f"`{c}`") for c in docs.columns], sha), gone, id_col, text_col)
    if twins.isEmpty():
        return left.drop(sha)
    flagged = maybe(left, F.xxhash64(F.col(text_col)), twins.select("key"), twin)
    one = flagged.filter(twin).dropDuplicates([id_col, sha])
    return flagged.filter(~F.col(twin)).unionByName(one).drop(sha, twin)
