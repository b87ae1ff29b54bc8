"""The registered queries without SQL, over whole tables, against what their tables say by themselves."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import queries as corpus

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the generated tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_chat_formatting_reads_back_every_turn(spark):
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, "conversations"):
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in corpus.op3_chat_formatting(spark, SF).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        target = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
        assert r.formatted_chars > len(said)


def test_packing_holds_every_token_once(spark):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus.op6_best_fit_packing(spark, SF).collect()
    ids = {r.doc_id: np.array([*ref.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in table(spark, "documents")}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:])
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids[doc])
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(sequences) <= 1.1 * least + 1


def test_shards_hold_every_row_evenly(spark):
    got = corpus.op8_sharding(spark, SF).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in table(spark, "documents"))
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_language_id_covers_all_documents(spark):
    docs = {r.doc_id: r for r in table(spark, "documents")}
    got = {r.doc_id: r for r in corpus.op2_language_id(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or ""))
    held = [i for i, r in got.items() if r.held_out and docs[i].lang]
    assert np.mean([got[i].lang_pred == docs[i].lang for i in held]) > 0.9


def test_mixing_meets_its_targets(spark):
    rows = corpus.op5_source_mixing(spark, SF).collect()
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {(r.doc_id, r.tokens) for r in rows} == {(r.doc_id, len(ref.encode(r.text or "", add_special_tokens=False).ids)) for r in table(spark, "documents")}
    p, t, w = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows]), np.array([r.rate for r in rows])
    assert (w >= 0).all()
    got = (w * t) @ p
    want = np.array([0.80, 0.18, 0.02])
    off = np.abs(got / got.sum() / want - 1).max()
    assert off <= 3e-4 and rows[0].largest_target_error <= 1e-4
