import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import knn, langid, licenses, mixing
from ledgerline.llm.tokens import tokens

WORDS = {"en": "the and with of that this house from".split(), "de": "der und mit von dass dieses haus nicht".split(), "fr": "le et avec de que cette maison élève".split()}


def corpus(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(8, 80))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_the_held_out_fold(spark):
    docs = corpus(spark)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    s, k = 3, 2
    net = langid.Net(["a", "b"], rng.normal(0, 0.4, (2, 256, 3 * s)), rng.normal(0, 0.4, (2, 3 * s, s)), rng.normal(0, 0.5, (2, k, s)), rng.normal(0, 0.1, k))
    net = langid.Net(net.languages, *(v.astype(np.float32) for v in (net.x, net.h, net.v, net.b)))
    window = rng.integers(97, 101, (6, 4)).astype(np.uint8)
    steps, y = np.ascontiguousarray(np.stack([window, window[::-1]], 1)).astype(np.intp), rng.integers(0, k, 4)
    grads, _ = langid._train_step(net, steps, y)
    for value, grad in zip((net.x, net.h, net.v, net.b), grads, strict=True):
        flat = np.flatnonzero(np.abs(grad) > 2e-3)[:6]
        for i in flat:
            at = np.unravel_index(i, value.shape)
            old = value[at]
            value[at] = old + 1e-2
            _, up = langid._train_step(net, steps, y)
            value[at] = old - 1e-2
            _, down = langid._train_step(net, steps, y)
            value[at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 3e-3


def test_spans_do_not_depend_on_their_batch():
    net = langid.train([("a", "abab" * 50), ("b", "cdcd" * 50)], steps=20)
    texts = [b"ab" * 10, b"cd" * 300, b"a", b"abcd" * 70]
    whole = langid.probabilities(net, texts)
    for i, t in enumerate(texts):
        assert np.allclose(langid.probabilities(net, [t])[0], whole[i], atol=1e-5)
    assert np.allclose(whole.sum(1), 1, atol=1e-4)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 13 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, 10))
    assert by[11].lang_pred in {"en", "de", "la"}
    kept = langid.keep_known(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 9
    assert langid.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert sorted((r.doc_id for r in langid.keep_known(unlabelled).collect()), key=str) == sorted([1, 2, 3, 7, 8, 8, None, 11, 12], key=str)
    clashing = odd_docs.withColumns({n: F.lit(n) for n in ("id", "key", "__gone", "__letter", "lang_pred", "score", "h", "t", "share")})
    assert langid.keep_known(clashing).columns == clashing.columns


def test_a_text_that_mixes_languages_goes(spark):
    docs = corpus(spark)
    mixed = spark.createDataFrame([(1000, " ".join(" ".join(w * 9)[:300] for w in WORDS.values()), None)], docs.schema)
    seen = {r.doc_id: r for r in langid.identify(docs.unionByName(mixed)).collect()}
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(mixed), least=0.6).collect()}
    assert seen[1000].score < 0.6 and 1000 not in kept and len(kept) > 295


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 9)}{chr(97 + i // 9 % 9)} " * 20, f"l{i % 70}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.learn(docs).languages) == 70
    monkeypatch.setattr(langid, "MOST", 69)
    with pytest.raises(ValueError, match="69 languages"):
        langid.learn(docs)


def plain_probabilities(net, text):
    """The network byte by byte, each direction on its own, and the mean over all bytes."""
    total = np.zeros(len(net.languages))
    for a in range(0, len(text), langid.SPAN):
        span, states = text[a : a + langid.SPAN], []
        for d, read in enumerate((span, span[::-1])):
            h, seen = np.zeros(net.h.shape[2]), []
            for byte in read:
                x, u = net.x[d][byte].astype(float), net.h[d].astype(float) @ h
                s = len(h)
                z, r = (np.clip(0.2 * (x[i * s : i * s + s] + u[i * s : i * s + s]) + 0.5, 0, 1) for i in (0, 1))
                c = x[2 * s :] + r * u[2 * s :]
                h = h + z * (c / (1 + abs(c)) - h)
                seen.append(h)
            states.append(seen if d == 0 else seen[::-1])
        for forward, backward in zip(*states, strict=True):
            y = np.exp(net.v[0] @ forward + net.v[1] @ backward + net.b)
            total += y / y.sum()
    return total / len(text)


def test_probabilities_equal_a_plain_loop():
    net = langid.train([("a", "ab ac ad" * 20), ("b", "xy xz yz" * 20), ("c", "ax by cz" * 20)], steps=30)
    texts = [b"a", b"ab xy ad", b"xy xz " * 50, bytes(range(1, 200)) * 2, b"x" * 128, b"y" * 129]
    for got, text in zip(langid.probabilities(net, texts), texts, strict=True):
        assert np.allclose(got, plain_probabilities(net, text), atol=2e-4)


def labelled(spark, n=240, seed=2):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = rnd.choices(["high", "low", "toxic"], [6, 3, 1])[0]
        words = {"high": "good clear text", "low": "buy now click", "toxic": "awful stupid worthless"}[kind].split()
        docs.append((i, " ".join(rnd.choice([*words, "a", "b", "c"]) for _ in range(rnd.randrange(10, 60))), "x"))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_the_targets(spark):
    docs, labels = labelled(spark)
    mixed, domains, fit = mixing.mix(docs, labels, {"high": 0.7, "low": 0.25, "toxic": 0.05})
    rows = mixed.collect()
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.tokens for x in rows]), np.array([x.rate for x in rows])
    assert domains == ["high", "low", "toxic"] and (r >= 0).all() and np.allclose(p.sum(1), 1)
    got = (r * t) @ p
    assert np.allclose(got / got.sum(), [0.7, 0.25, 0.05], atol=0.01)
    # the same iteration in one place
    a = p * (t / fit.mean)[:, None] * fit.scale
    assert np.allclose(mixing.rates(a, fit.steps), r, atol=1e-6)
    want = fit.goal / fit.mean * fit.scale
    errors = [np.abs(mixing.rates(a, fit.steps[:i]) @ a - want).max() for i in range(len(fit.steps) + 1)]
    assert errors[-1] < 0.05 * errors[0]
    times = {x.doc_id: 0 for x in rows}
    out = mixing.mix_documents(docs, labels, {"high": 0.7, "low": 0.25, "toxic": 0.05})
    for x in out.collect():
        times[x.doc_id] += 1
    assert out.columns == docs.columns
    assert all(np.floor(x.rate) <= times[x.doc_id] <= np.ceil(x.rate) for x in rows)


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    mixed, domains, _ = mixing.mix(odd_docs, labels)
    rows = mixed.collect()
    assert len(rows) == 13 and all(r.rate >= 0 and len(r.posterior) == len(domains) for r in rows)
    assert all(r.tokens == 0 and r.rate == 1 for r in rows if r.doc_id in (4, 5))
    ids = {(r.doc_id, r.tokens) for r in rows}
    assert ids == {(r.doc_id, len(tokens().ids(r.text or ""))) for r in odd_docs.collect()}
    clashing = odd_docs.withColumns({n: F.lit(n) for n in ("__id", "__key", "__own", "row", "copy", "key", "rate", "tokens", "posterior")})
    again = mixing.mix_documents(clashing, labels)
    assert again.columns == clashing.columns and mixing.mix_documents(odd_docs, labels).columns == odd_docs.columns
    assert {tuple(r) for r in again.collect()} <= {tuple(r) for r in clashing.collect()}
    assert mixing.mix_documents(no_docs, labels).count() == 0
    assert mixing.mix(no_docs, labels)[0].count() == 0
    one = mixing.mix(odd_docs, labels.limit(0))
    assert one[1] == ["all"] and {round(r.rate, 6) for r in one[0].collect()} == {1.0}


def brute_top(rows, k, every):
    use = [(i, n, [int(np.floor(64 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, q in use:
        if i is not None and i % every == 0:
            all_ = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0, m) for j, m, v in use if m != n))[:k]
            out += [(i, r + 1, None if nil else j, -s) for r, (s, nil, j, _) in enumerate(all_)]
    return sorted(out, key=str)


def test_top_k_equals_all_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(0, 0.1, 8)).astype(np.float32)]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(600, None), (601, [1.0, None]), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (604, [0.5, 0.25]), (605, []), (20, rows[20][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    for k in (1, 20, 600):
        got = knn.top_k(df, F.col("vec_id") % 20 == 0, k)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, k, 20)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_scores_stay_exact():
    q, d = np.array([[float(1 << 30)] * 4]), np.array([[float(1 << 30) + 1] * 4])
    assert knn.scores(q, d).tolist() == [[4 * (1 << 30) * ((1 << 30) + 1)]]


@pytest.mark.parametrize("block", [4, 64])
def test_crowded_cells_are_cut(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "ROWS", 7)
    monkeypatch.setattr(knn, "SLIM_ROWS", 16)
    rows = [(i, [float((i * 7 + j) % 5) for j in range(4)]) for i in range(200)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0, 5, pivots=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, 5, 2)


def test_bounds_skip_far_cells_and_lose_nothing(spark, monkeypatch):
    """Tight clusters of a few hundred vectors: most pairs are left out, results stay those of all pairs."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(6)
    at = rng.normal(0, 1, (8, 12))
    rows = [(i, [float(x) for x in (at[i % 8] * 3 + rng.normal(0, 0.02, 12)).astype(np.float32)]) for i in range(1200)] + [(2001, [0.0] * 12)]
    df, report = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {}
    got = knn.top_k(df, F.col("vec_id") % 20 == 0, 5, pivots=8, report=report)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, 5, 20)
    assert 0 < report["share"] < 0.4


def test_the_session_keeps_its_batch_size(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    knn.top_k(df, F.col("vec_id") % 20 == 0, 3).count()
    assert spark.conf.get(name) == before


def test_licences(spark, odd_docs, no_docs):
    import textwrap

    said = [licenses.SENTENCES[x][0] for x in ("MitGrant", "MitNotice", "MitAsIs", "MitLiable")]
    mit = "\n".join(" * " + line for part in (said[0], said[1], " ".join(said[2:])) for line in [*textwrap.wrap(part, 70), ""])
    rows = [
        (1, f"Foo.\n\n{mit}\nbar"), (8, "\n".join(["Foo", *said, "bar"])), (2, "Released under the MIT License."), (3, "released UNDER the mit-license! Not known. Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (4, licenses.SENTENCES["MitNotice"][0]), (5, "We talk about the MIT License here."), (6, None),
        (7, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. Foo"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licenses, got[1].rule_matches, got[1].unresolved, got[1].n_sentences) == ("MIT", 1, 0, 6)
    assert (got[8].licenses, got[8].rule_matches, got[8].unresolved, got[8].n_sentences) == ("MIT", 1, 0, 6)
    assert got[2].licenses == "MIT" and got[3].licenses == "CC-BY-NC-4.0" and got[3].rule_matches == 2
    assert (got[4].licenses, got[4].unresolved) == ("", 1) and got[5].licenses == "" and got[5].sentence_ids == ""
    assert (got[6].n_sentences, got[6].licenses) == (0, "") and got[7].licenses == "Apache-2.0"
    assert licenses.scan(odd_docs).count() == 13 and licenses.scan(no_docs).count() == 0
