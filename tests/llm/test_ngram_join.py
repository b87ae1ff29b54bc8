import random
import re

import numpy as np
import pytest

from ledgerline.llm import ngram_join
from ledgerline.llm.components import components
from ledgerline.llm.common import Scratch
from ledgerline.llm.ngram_join import Rule

SCHEMA = "doc_id long, text string"


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    n = min(k, len(words))
    return {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()


def brute(rows, rule):
    sets = [shingles(t, rule.k) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min((x for x in (doc, low.get(root(i))) if x is not None), default=None)
    return sorted(((doc, len(sets[i]), low[root(i)], links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def near_texts(seed, n=350):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 3, 5, 8, 10, 12, 15, 20, 30, 60, 200]))] for _ in range(30)]
    rows = []
    for i in range(n):
        b = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            p = rnd.randrange(len(b))
            b = [*b[:p], rnd.choice("xyz"), *b[p + rnd.randrange(2) :]]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(b)))
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (1003, "Aa bb"), (1004, "aa BB")]


@pytest.mark.parametrize("rule", [Rule(2, 85, 100), Rule(3, 60, 100), Rule(4, 85, 100)])
@pytest.mark.parametrize("block,crowd", [((2_000_000, 2_000_000), (4096, 4096)), ((60, 60), (3, 3))])
def test_join_equals_all_pairs(spark, monkeypatch, rule, block, crowd):
    """Whole meetings and tiles, and meetings and tiles cut into small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rows = near_texts(rule.num + rule.k)
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA).repartition(3), rule).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, rule)


def test_very_short_texts_that_share_few_shingles(spark):
    """Sets of 1 to 12 shingles, where parts are often empty and first shingles are signed."""
    rnd, rule = random.Random(4), Rule(1, 60, 100)
    rows = [(i, " ".join(rnd.sample("abcdefghijklmnopqrst", rnd.randrange(1, 13)))) for i in range(400)]
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA).repartition(3), rule).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, rule)


@pytest.mark.parametrize("crowd", [1, 2, 3, 7, 100])
def test_crowded_meetings_compare_all_pairs_across_groups(spark, crowd):
    """Every pair of different groups meets in a tile of the second look, with sides that let it be compared."""
    rnd = random.Random(crowd)
    rows = [(1, i, 0 if i < 12 else 100 + rnd.randrange(6)) for i in range(20)] + [(2, i, i) for i in range(9)] + [(3, i, i % 2) for i in range(4)]
    known = spark.createDataFrame(rows, "meeting long, ref long, grp long")
    open_ = []
    for m in (1, 2, 3):
        groups = [g for x, _, g in rows if x == m]
        c, top = max((groups.count(g), g) for g in groups)
        open_.append((m, len(groups), top, len(groups) - c))
    tiles = {}
    for r in ngram_join._second_look(known, spark.createDataFrame(open_, "meeting long, m long, top long, minor long"), crowd).collect():
        tiles.setdefault((r.meeting, r.tile), []).append(r)
    met = {(m, frozenset((a.ref, b.ref))) for (m, _), t in tiles.items() for a in t for b in t if a.ref < b.ref and (a.side == 2 or a.side != b.side)}
    for m in (1, 2, 3):
        own = [(i, g) for x, i, g in rows if x == m]
        assert {(m, frozenset((i, j))) for i, g in own for j, h in own if i < j and g != h} <= met
    first = ngram_join._first_look(known.select("meeting", "ref"), spark.createDataFrame([(1, 20, 0)], "meeting long, m long, anchor long"), crowd).collect()
    assert {(r.meeting, r.ref) for r in first} == {(m, i) for m, i, _ in rows}
    assert {r.tile for r in first if r.meeting == 1 and r.ref == 0} == set(range(-(-20 // crowd)))


def test_bitmaps_bound_what_differs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 30).astype(np.uint64))))
        apart = len(np.setxor1d(a, b))
        for bits in (256, 1024):
            assert np.bitwise_count(ngram_join.bitmap(a, bits) ^ ngram_join.bitmap(b, bits)).sum() <= apart
        assert (ngram_join.fold(ngram_join.bitmap(a, 1024), 4) == ngram_join.bitmap(a, 256)).all()
        assert ngram_join.overlaps(a, [b, a]).tolist() == [len(np.intersect1d(a, b)), len(a)]


def test_bands_hold_every_partner():
    rule = Rule(4, 85, 100)
    edges = rule.edges()
    for n in [*range(1, 3000), 10**6, 10**9]:
        assert np.searchsorted(edges, rule.partner(n), "right") - np.searchsorted(edges, n, "right") <= 1


def test_odd_rows(odd_docs, no_docs, spark):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.join(odd_docs, Rule()).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, Rule())
    kept = ngram_join.keep_one(odd_docs.distinct())
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 8, None, 10, 11, 12], key=str)
    assert ngram_join.join(no_docs, Rule()).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


def test_null_ids_lose_to_others(spark):
    a, b, c = ("one two three four five six seven", "red green blue cyan pink grey gold", "north south east west up down left")
    rows = [(None, a), (5, a), (None, b), (None, b + " !"), (9, c), (None, c)]
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA), Rule(5, 60, 100)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, Rule(5, 60, 100))
    assert {r.component_id for r in got if r.n_shingles == 3 and r.doc_id == 5} == {5}
    kept = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA), Rule(5, 60, 100)).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [5, 9] and sum(r.doc_id is None for r in kept) == 1


def test_helper_names_do_not_clash(spark):
    names = ["__id", "__key", "__gone", "__gone_key", "__own", "__text", "__word", "__mask", "likely", "label", "stays"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e f", "a b c d e f", "x y z", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows[i] for i in (0, 2, 3))
    assert ngram_join.join(df).count() == 4


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)]
    got = {r.node: r.label for r in components(Scratch(spark, "t"), spark.createDataFrame(pairs, "a long, b long"), "c").collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[n] == min(seen)
    assert set(got) == set(near)
