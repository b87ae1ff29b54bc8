import tracemalloc
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import langid, queries as corpus
from ledgerline.llm.tokens import tokens

SF = "/root/testdata/sf0.001"


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_odd_rows_pass_every_stage(spark, odd_docs, tmp_path):
    twice = odd_docs.unionByName(odd_docs.filter("doc_id is null or doc_id = 3")).withColumns({n: F.lit(n) for n in ("key", "rate", "tokens", "row", "copy", "sha", "best", "__text")})
    folder = write(spark, tmp_path, twice, [(1, 1, 0), (3, 0, 0), (None, 1, 1), (8, 0, 1)])
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage{i}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}, name
        texts = [r.text for r in docs.collect()]
        if i == 0:
            assert all(t and any(c.isalpha() for c in t) for t in texts)
        if i in (1, 2):
            assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in docs.collect()} and sum(r.start == 0 for r in pieces) == docs.count()


def test_empty_tables_pass_every_stage(spark, no_docs, tmp_path):
    folder = write(spark, tmp_path, no_docs, [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_labels_of_the_query_are_those_of_the_network_text_by_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.learn(docs)
    got = {r.doc_id: r for r in corpus.op2_language_id(spark, SF).collect()}
    for r in docs.select("doc_id", "text").collect():
        if any(c.isalpha() for c in r.text or ""):
            p = langid.probabilities(net, [r.text.lower().encode()])[0]
            assert got[r.doc_id].lang_pred == net.languages[int(p.argmax())]
            assert got[r.doc_id].score == pytest.approx(min(p.max(), 1.0), abs=1e-4)
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)


def test_many_languages_need_bounded_memory():
    rng, k, s = np.random.default_rng(1), 400, langid.STATE
    net = langid.Net([f"l{i}" for i in range(k)], *(rng.normal(0, 0.3, shape).astype(np.float32) for shape in ((2, 256, 3 * s), (2, 3 * s, s), (2, k, s), (k,))))
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (200_000, 30_000, 5, 0)]
    tracemalloc.start()
    p = langid.probabilities(net, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and np.allclose(p[:3].sum(1), 1, atol=1e-4)
    assert np.allclose(p[2], langid.probabilities(net, texts[2:3])[0], atol=1e-5)


def test_token_ids_are_the_same_for_every_character():
    ref, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens()
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    for make in (lambda c: f"a{c}b ", lambda c: f" {c} ", lambda c: f"1{c}{c}'", lambda c: f"{c}\n"):
        texts = ["".join(map(make, every[i : i + 500])) for i in range(0, len(every), 500)]
        for t, e in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.ids(t) == e.ids
