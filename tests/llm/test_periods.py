import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import periods, queries as corpus

SF = "/root/testdata/sf0.001"


def brute(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            e = i + q
            smallest = next(p for p in range(1, q + 1) if all(w[j] == w[j + p] for j in range(s, e - p)))
            if e - s >= max(least, 2 * q) and smallest == q:
                out.append((s, e - s, q))
    return sorted(out)


def row_of(doc_id, text, plant):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute(w)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest(),
    )


@pytest.mark.parametrize("cost", [0.0, 0.01, periods.FFT_COST])
def test_runs_of_random_words(cost, monkeypatch):
    monkeypatch.setattr(periods, "FFT_COST", cost)
    rnd = random.Random(int(cost * 100))
    for i in range(500):
        n, k = rnd.randrange(0, 150), rnd.choice([1, 2, 3, 5, 30])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(4) if n > 3 else 0):
            a, p, m = rnd.randrange(n), rnd.randrange(1, rnd.choice([3, 8, 60])), rnd.randrange(1, 100)
            for j in range(a + p, min(n, a + m)):
                w[j] = w[j - p]
        least = rnd.choice([12, 12, 4, 20])
        assert periods.runs(periods.word_codes(w), least) == brute(w, least), (w, least)


def test_lag_counts_are_exact_either_way(monkeypatch):
    x = periods.word_codes((np.random.default_rng(2).zipf(1.3, 3000) % 200).tolist())
    want = [0] + [int((x[:-q] == x[q:]).sum()) for q in range(1, 1501)]
    for cost in (0.0, 0.05, 2.0, 1e9):
        monkeypatch.setattr(periods, "FFT_COST", cost)
        assert periods.lag_counts(x, 1500).tolist() == want


def test_multiples_of_a_period_need_no_scan(monkeypatch):
    scanned, real = [], periods.scan
    monkeypatch.setattr(periods, "scan", lambda x, q, least: scanned.append(q) or real(x, q, least))
    assert periods.runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)] and scanned == [1]
    assert periods.runs(periods.word_codes([i % 7 for i in range(9_000)])) == [(0, 9_000, 7)] and scanned == [1, 7]


def test_the_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) <= 1500}
    assert len(short) > 0.9 * len(docs)
    got = {r.doc_id: tuple(r) for r in corpus.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > len(docs) // 20
    assert all(got[i] == row_of(i, t, True) for i, t in short.items())


def test_odd_rows(spark, odd_docs, no_docs):
    short = odd_docs.filter("length(text) < 1000 or text is null")
    clashing = odd_docs.withColumns({n: F.lit(n) for n in ("runs", "collapsed", "best", "start", "n_runs")})
    for plant in (False, True):
        want = {row_of(r.doc_id, r.text, plant) for r in short.collect()}
        got = {tuple(r) for r in periods.periodic_runs(clashing, plant=plant).collect()}
        assert want <= got and len(got - want) == 1
    long = next(r for r in periods.periodic_runs(odd_docs).collect() if r.doc_id == 7)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 20_000, 5, 4_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"lorem ipsum dolor sit amet").hexdigest()
    assert periods.periodic_runs(no_docs).count() == 0
