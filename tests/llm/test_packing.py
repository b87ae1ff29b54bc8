import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from ledgerline.llm import packing
from ledgerline.llm.common import Scratch
from ledgerline.llm.tokens import tokens

REF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdtABC12\x1c\x85\xa0　"))))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert tokens().ids(text) == REF.encode(text, add_special_tokens=False).ids


def test_ids_of_special_strings():
    text = "a <|endoftext|> b"
    assert tokens().ids(text) == REF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_plan_holds_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 30, 100, 2048])
    counts = Counter(rnd.choice([rnd.randrange(1, capacity + 1), max(1, int(capacity * rnd.random() ** 3))]) for _ in range(rnd.randrange(1, 600)))
    bins = packing.plan(dict(counts), capacity)
    held = Counter()
    for n, lengths in bins:
        assert n > 0 and sum(lengths) <= capacity
        assert sum(3 * k > capacity for k in lengths) <= 2
        for k in lengths:
            held[k] += n
    assert held == counts
    least, used = -(-sum(k * n for k, n in counts.items()) // capacity), sum(n for n, _ in bins)
    large = sum(n for k, n in counts.items() if 2 * k > capacity)
    assert used <= 1.25 * max(least, large) + 2
    runs = packing.runs(bins)
    seats = set()
    for k, n in counts.items():
        first, at_bin, place = runs[k]
        for rank in range(n):
            i = np.searchsorted(first, rank, "right") - 1
            seats.add((int(at_bin[i] + rank - first[i]), int(place[i])))
    assert len(seats) == sum(counts.values())


def check(stored, placed, rows, capacity):
    ids = {}
    got = placed.collect()
    pieces = {(r.doc_id, r.piece, r.start, zlib.crc32(r.ids)): r for r in stored.collect()}
    bins, total = {}, 0
    for r in got:
        piece = pieces[r.doc_id, r.piece, r.start, r.ids_crc32]
        assert len(piece.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
        ids.setdefault(r.doc_id, {})[r.start] = np.frombuffer(piece.ids, "<u4").tolist()
    for held in bins.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= capacity
    for doc, text in rows:
        assert [x for start in sorted(ids[doc]) for x in ids[doc][start]] == REF.encode(text or "", add_special_tokens=False).ids + [0]
    return got, len(bins), total


def test_pack(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("the cat sat on a mat".split()) for _ in range(rnd.choice([0, 1, 5, 20, 90])))) for i in range(200)]
    got, bins, total = check(*packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 64), rows, 64)
    assert bins <= 1.05 * total / 64 + 1
    for r in got:
        assert r.length == 64 or r.piece == 0


def test_seats_do_not_depend_on_how_stored_pieces_are_split(spark, monkeypatch):
    """Executors that come or go between the jobs change how a scan is split."""
    rnd = random.Random(8)
    rows = [(i, "one two three") if i % 3 else (i, " ".join(rnd.choice("the cat sat on a mat".split()) for _ in range(rnd.randrange(200)))) for i in range(600)]
    scratch = Scratch(spark, "t")
    stored = scratch.table(packing.number(packing.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(24), 64)), "pieces")
    monkeypatch.setattr(packing, "LEAST", 10)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
        slim = stored.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row")
        placed = packing.place(slim, 64)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "12")
        check(stored, placed, rows, 64)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id long, text string, row int, part int, parts int")
    assert packing.pack(df)[1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows(odd_docs, no_docs):
    got, *_ = check(*packing.pack(odd_docs), list({(r.doc_id, r.text) for r in odd_docs.collect()}), 2048)
    assert sum(r.length for r in got if r.doc_id in (4, 5)) == 2
    assert sum(r.doc_id == 8 for r in got) == 2
    assert packing.pack(no_docs)[1].count() == 0
