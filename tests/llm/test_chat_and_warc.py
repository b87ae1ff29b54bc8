import hashlib
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat, warc
from ledgerline.llm.common import Scratch
from ledgerline.llm.tokens import tokens

PARTS = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "|", "[", "s>", "n"]), st.text(max_size=4, alphabet=st.characters(exclude_categories=["Cs"])))).map("".join)


@settings(max_examples=500, deadline=None)
@given(PARTS, PARTS)
def test_turns_are_read_back(role, text):
    shown, a, z = chat._turn(role, text)
    assert chat.read_back(shown + shown) == [(role, text)] * 2
    assert chat.unescape(shown[a:z]) == text
    inner = chat.escape(text)
    assert not any(c in inner for c in chat.CONTROLS)


def expected(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        turns = out.setdefault(conv, [])
        turns.append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


def chats(seed=4):
    rnd = random.Random(seed)
    words = ["hello", "wörld", "[INST]", "\\", "<|im_end|>", "</s>", "\n", "ok"]
    rows = []
    for c in range(40):
        first = rnd.random() < 0.5
        for t in range(rnd.randrange(1, 30)):
            role = "system" if first and t == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))))
    return rows + [(None, None, None, None), (None, 1, "assistant", "x"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (51, 0, "system", "only")]


@pytest.mark.parametrize("budget,history", [(1024, 256), (120, 40), (30, 0)])
def test_windows(spark, budget, history):
    rows = chats()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_chats(df, budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.summarise(windows).collect()}
    assert got == expected(rows)
    system = {c: r for c, t, r, _ in rows if t == 0}
    for w in windows.collect():
        turns = chat.read_back(w.formatted)
        assert len(turns) > w.n_repeated
        if system.get(w.conv_id) == "system":
            assert turns[0][0] == "system"
        new = turns[w.n_repeated :]
        if len(new) > 1 or w.n_tokens <= budget:
            assert w.n_tokens <= budget + (len(tokens().ids("\n")) + 8) * 2 or w["window"] == 0
        assert [w.formatted[s.start : s.end] for s in w.loss] == [chat.escape(x) for r, x in new if r == "assistant"]


def test_probe_and_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.summarise(chat.format_chats(empty)).count() == 0
    got = chat.summarise(chat.format_chats(chat.with_probe(empty))).first()
    said = "</s>[INST] ok [/INST]"
    assert (got.conv_id, got.n_turns, got.loss_chars) == (-1, 2, len(said))
    assert got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


PAGES = [
    (1, "http://a/1", "x" * 120), (2, "http://a/2", "x" * 120), (3, "http://a\r\n3", "short"), (4, "http://a/4", "short"), (5, None, None),
    (6, "http://a/6", ""), (7, "http://a/7", "é" * 50), (8, "http://a/8", "é" * 50), (9, "http://a/9", "y" * 99), (10, "u", "y" * 99),
    (11, "u", "head\r\n\r\nbody WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (12, "u", "z" * 300_000), (1, "http://a/1", "x" * 120), (None, "u", "x" * 120), (None, "u", "q" * 200), (None, "u", "q" * 200),
]


def test_pages_come_back(spark):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(df).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((t or "").encode()), sha(t)) for i, _, t in PAGES)
    x = [r for r in got if r.payload_digest == sha("x" * 120)]
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in x) == Counter([(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1)])
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == sha("é" * 50)} == {(7, "response", None), (8, "revisit", 7)}
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    assert Counter(r.record_type for r in got if r.payload_digest == sha("q" * 200)) == Counter(response=1, revisit=1)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_one_stream_and_members_are_indexed(spark):
    scratch = Scratch(spark, "warc-test")
    df = spark.createDataFrame(PAGES[:8], "page_id long, url string, html string").repartition(1)
    written = warc.write_archives(df, scratch)
    store, path = warc._files(scratch.path("archives"))
    name = written.first().archive
    data = store.open_input_stream(f"{path}/{name}", compression=None).read()
    one = zlib.decompressobj(31)
    whole = one.decompress(data)
    assert one.eof and not one.unused_data and whole.count(b"WARC/1.1\r\n") == 8
    index = warc.normalise(written, scratch).orderBy("offset").collect()
    store, path = warc._files(scratch.path("members"))
    members = store.open_input_stream(f"{path}/{index[0].archive}", compression=None).read()
    assert b"".join(zlib.decompress(members[r.offset : r.offset + r["size"]], 31) for r in index) == whole
    side = store.open_input_stream(f"{path}/{index[0].archive}.idx", compression=None).read().decode().splitlines()
    assert [int(line.split("\t")[0]) for line in side] == [r.offset for r in index]


def test_cutter_takes_any_chunks():
    data = b"".join(warc.record(i, "u", bytes([65 + i]) * i * 7, "d", None, False) for i in range(9))
    for n in (1, 3, 50, 10_000):
        cut = warc.Cutter()
        assert b"".join(x for a in range(0, len(data), n) for x in cut.feed(data[a : a + n])) == data
        cut.close()
    cut = warc.Cutter()
    list(cut.feed(data[:-3]))
    with pytest.raises(ValueError):
        cut.close()
