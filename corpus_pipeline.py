"""The corpus pipeline: language ID, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. ``run`` applies them in order, writing what each returns to the
shared folder and reading it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import exact_dedup, langid, mixing, ngram_join, packing
from ledgerline.llm.common import Scratch, read

#: Scratch of mixing, which holds all documents until its result is written.
_spent: list[Scratch] = []


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, no text, or none that the network is sure of (score under 0.4)."""
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (similarity 0.8) connect, the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or drop out so that the domains' tokens meet their target weights."""
    _spent.append(Scratch(spark, "mixing"))
    return mixing.mix_documents(docs, read(spark, sf_dir, "labels"), scratch=_spent[-1])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` is what mixing returned, written and reread, so the table that mixing kept beside it goes first.
    """
    while _spent:
        _spent.pop().free("posteriors")
    return packing.pack(docs)[1]


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: No SQL expresses the learned stages; tests hold them against brute force and properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
        if last:
            scratch.free(last)
        last = f"stage-{i}"
    return docs
