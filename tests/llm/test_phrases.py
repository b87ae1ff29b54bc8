import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import phrases
from ledgerline.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if a < least or len(p) < 2:
            continue
        longer = (b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, every in out.items() for i, (score, a, p, left, right) in enumerate(sorted(every)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least,longest,top,share", [(3, 5, 2000, 100), (2, 3, 5, 100), (4, 5, 7, 60)])
def test_against_plain_counting(spark, least, longest, top, share):
    rng = np.random.default_rng(least)
    words = np.array(["a", "B", "c", "Éa", "d\x0be", "日本", "f", "g\u00a0h", "i"])
    ends = np.array([" ", "  ", "\t", ", ", ".", "\n", " ", " "])
    rows = [("en" if i % 3 else None, "".join(w + e for w, e in zip(rng.choice(words, 30), rng.choice(ends, 30, p=[0.5, 0.05, 0.05, 0.1, 0.05, 0.05, 0.1, 0.1]), strict=True))) for i in range(60)]
    rows += [("en", "Strong tea is strong tea") for _ in range(5)] + [("de", None), ("de", ""), ("", "x y x y x y x y")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert got(phrases.collocations(df, least, longest, top, share)) == brute(rows, least, longest, top, share)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    clashing = odd_docs.withColumns({n: F.lit(n) for n in ("phrase", "a", "l", "r", "n", "rank", "f", "block", "steps", "words", "head", "tail")})
    for df in (odd_docs, clashing):
        assert got(phrases.collocations(df, 2)) == brute(rows, 2, 5, 2000)
    assert phrases.collocations(no_docs).count() == 0


def test_frequent_is_whole_when_the_sketch_is_crowded_and_texts_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("en", " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 3000) % 400) + (". " if i % 2 else "")) for i in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = Counter()
    for _, text in rows:
        for piece in text.split("."):
            w = piece.split()
            for k in range(1, 6):
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    monkeypatch.setattr(phrases, "FLUSH", 1000)
    found = phrases.frequent(df, Scratch(spark, "phrases-test"), 10, load=10**9).filter("size > 0").collect()
    assert {tuple(r.phrase.split()): r.f for r in found} == {p: f for p, f in want.items() if f >= 10}


def test_cutting_long_texts_loses_nothing(monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH", 10)
    text = "Aa bb, cc dd ee ff gg. hh!! ii jj kk ll mm nn oo pp qq"
    parts = list(phrases.pieces(text))
    assert len(parts) > 1 and b"\n".join(parts) == text.lower().replace(",", "\n").replace(".", "\n").replace("!", "\n").encode()


def test_cells_come_back_from_their_steps():
    for cell in ([0], [65534, 65535, 65536], [70000, 200000, 200001], [131069, 131070, 10**6], []):
        cell = np.array(cell, np.uint32)
        steps, counts = phrases._steps(cell, np.arange(1, len(cell) + 1).astype(np.uint8))
        at = np.cumsum(steps, dtype=np.int64) - 1
        assert at[counts > 0].tolist() == cell.tolist() and counts[counts > 0].tolist() == list(range(1, len(cell) + 1)) and (np.diff(at) > 0).all()


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 3_000_000_019, 40_000_000_000_007, 5_000_000_023, 7_000_000_027
    wide = lambda c: f"cast({c} as decimal(17, 0))"
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.selectExpr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')}) as s").first().s == 1000 * a * n // (left * right)


def test_counts_of_a_task_travel_in_blocks_and_meet_whole(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 2000)
    text = " ".join(f"w{i}" for i in range(5000))
    run = phrases._survivors(phrases.Sieve(1 << 16), 3)
    sent = [b for _ in range(3) for b in run(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])]))]
    assert sum(b.num_rows for b in sent) <= 3 * phrases.PACKS  # before: a row for each of 44,994 counts
    rows = pa.Table.from_batches(sent).sort_by("block").to_batches()
    found = Counter({(r["size"], r["phrase"]): r["f"] for b in phrases._settled(3)(iter(rows)) for r in b.to_pylist()})
    assert len(found) == 5000 + 4999 + 4998 + 1 and found.pop((0, "")) == 15_000 and set(found.values()) == {3}
    assert [r["size"] for b in phrases._settled(4)(iter(rows)) for r in b.to_pylist()] == [0]
