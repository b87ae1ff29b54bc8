"""Language ID by a bidirectional gated recurrent network over bytes.

A gated recurrent unit (update and reset gate, piecewise-linear sigmoids, softsign candidate) reads
the lower-cased UTF-8 bytes of a text in both directions, labels every byte with a distribution over
the languages, and a document's probabilities are the mean over all its bytes. The network is trained
in numpy by backpropagation through time on windows drawn from all over the texts of a bounded sample
of labelled rows of every language. Texts are read whole, in spans of ``SPAN`` bytes that begin with
an empty state; workers hold ``WIDTH`` spans.

Defined results: a null text and one without a letter are ``und`` with score 0; without labelled
rows everything is ``und`` (and ``keep_known`` keeps every text with a letter); more than ``MOST``
languages are refused with an error; with one language every text with a letter has it; a null id counts as
the empty string where folds are cut; ties go to the language that sorts first; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lean, prepare, Scratch, text_or_empty, without

#: The bounded sample of labelled rows: rows of a language, slices drawn from all over a text and their
#: characters (shorter texts are taken whole), and the most languages (more are an error).
PER_LANGUAGE, SLICES, CHARS, MOST = 300, 8, 64, 1024
#: Size of the state; bytes and windows of a training step; steps; spans of a text and at once.
STATE, WINDOW, BATCH, STEPS = 8, 48, 384, 220
SPAN, WIDTH = 128, 2048
#: Numbers that an array of (position, language, text) may hold, which bounds WIDTH and BATCH; windows that
#: training draws of each language at least (STEPS grow with the languages).
CELLS, WINDOWS = 1 << 22, 2000
UNKNOWN, LETTER = "und", r"\p{L}"
#: The score under which keep_known gives a text up: the languages are as good as mixed up to the network.
LEAST = 0.4
FOLDS = 5


@dataclass
class Net:
    languages: list[str]
    x: np.ndarray  # direction, byte, 3 * STATE: update, reset, candidate
    h: np.ndarray  # direction, 3 * STATE, STATE
    v: np.ndarray  # direction, language, STATE
    b: np.ndarray  # language


def _forward(net: Net, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, direction, STATE, texts) for ``steps`` (time, direction, texts) of bytes."""
    s = net.h.shape[2]
    times, _, n = steps.shape
    x = np.ascontiguousarray(net.x.transpose(0, 2, 1))  # direction, 3 * STATE, byte
    h, out = np.zeros((2, s, n), np.float32), np.empty((times, 2, s, n), np.float32)
    a = np.empty((2, 3 * s, n), np.float32)
    for t in range(times):
        for d in (0, 1):
            np.take(x[d], steps[t, d], axis=1, out=a[d])
        u = net.h @ h
        gate = a[:, : 2 * s]
        gate += u[:, : 2 * s]
        gate *= 0.2
        gate += 0.5
        np.clip(gate, 0, 1, out=gate)
        pre = a[:, 2 * s :]
        back = u[:, 2 * s :]
        c = gate[:, s:] * back
        c += pre
        size = np.abs(c)
        size += 1
        c /= size
        if keep is not None:
            keep.append((h, gate.copy(), back, c, size))
        new = c - h
        new *= gate[:, :s]
        new += h
        h = new
        out[t] = h
    return out


def _train_step(net: Net, steps: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross entropy of all positions, by backpropagation through time."""
    times, _, n = steps.shape
    s, keep = net.h.shape[2], []
    out = _forward(net, steps, keep)
    flip = out[::-1, 1]  # position t was step times-1-t of the backward direction
    z = net.v[0] @ out[:, 0] + net.v[1] @ flip + net.b[:, None]
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(p[:, y, np.arange(n)] + 1e-9).mean())
    p[:, y, np.arange(n)] -= 1
    p /= times * n
    gv = np.stack([np.einsum("tcn,tsn->cs", p, out[:, 0]), np.einsum("tcn,tsn->cs", p, flip)])
    gb = p.sum((0, 2))
    dout = np.stack([net.v[0].T @ p, (net.v[1].T @ p)[::-1]], 1)
    gx, gh, dh = np.zeros_like(net.x), np.zeros_like(net.h), np.zeros((2, s, n), np.float32)
    da = np.empty((2, 3 * s, n), np.float32)
    for t in range(times - 1, -1, -1):
        h, gate, back, c, size = keep[t]
        dh = dh + dout[t]
        z_, r = gate[:, :s], gate[:, s:]
        dc = dh * z_ / (size * size)
        da[:, :s] = dh * (c - h)
        da[:, s : 2 * s] = dc * back
        da[:, : 2 * s] *= 0.2 * ((gate > 0) & (gate < 1))
        da[:, 2 * s :] = dc
        du = da.copy()
        du[:, 2 * s :] = dc * r
        gh += du @ h.transpose(0, 2, 1)
        for d in (0, 1):
            order = np.argsort(steps[t, d], kind="stable")
            found, first = np.unique(steps[t, d][order], return_index=True)
            gx[d][found] += np.add.reduceat(da[d].T[order], first)
        dh = dh * (1 - z_) + net.h.transpose(0, 2, 1) @ du
    return [gx, gh, gv, gb], loss


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Net | None:
    """A network for (language, text) rows; None without any."""
    texts = [(lang, text.lower().encode()) for lang, text in rows if text]
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    rng, s, k = np.random.default_rng(seed), STATE, len(languages)
    net = Net(
        languages,
        rng.normal(0, 0.3, (2, 256, 3 * s)).astype(np.float32),
        rng.normal(0, 0.3, (2, 3 * s, s)).astype(np.float32),
        rng.normal(0, 0.3, (2, k, s)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    if k == 1:
        return net
    by = [[np.frombuffer(t, np.uint8) for lang, t in texts if lang == x] for x in languages]
    values = [net.x, net.h, net.v, net.b]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    batch = max(16, min(BATCH, CELLS // (WINDOW * k)))
    steps = max(steps, -(-WINDOWS * k // batch))
    for i in range(1, steps + 1):
        y = rng.integers(0, k, batch)
        window = np.full((batch, WINDOW), 32, np.uint8)
        for j, c in enumerate(y):
            text = by[c][rng.integers(len(by[c]))]
            at = rng.integers(max(1, len(text) - WINDOW + 1))
            part = text[at : at + WINDOW]
            window[j, : len(part)] = part
        both = np.ascontiguousarray(np.stack([window.T, window.T[::-1]], 1)).astype(np.intp)
        grads, _ = _train_step(net, both, y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1.0, 2.0 * (1 - (i - 1) / steps))
        for v, g, m, q in zip(values, grads, mean, square, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v -= rate * (m / (1 - 0.9**i)) / (np.sqrt(q / (1 - 0.99**i)) + 1e-6)
    return net


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    """Mean over all bytes of the languages' probabilities, a row for each text."""
    k = len(net.languages)
    total, lengths = np.zeros((len(texts), k)), np.array([len(t) for t in texts], np.int64)
    spans = -(-lengths // SPAN)
    owner = np.repeat(np.arange(len(texts)), spans)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    begin = (np.cumsum(lengths) - lengths)[owner] + place * SPAN
    size = np.minimum(SPAN, lengths[owner] - place * SPAN)
    whole = np.frombuffer(b"".join(texts) + b" " * SPAN, np.uint8)
    t = np.arange(SPAN)[:, None]
    width = max(1, min(WIDTH, CELLS // (SPAN * k)))
    for a in range(0, len(owner), width):
        part = slice(a, a + width)
        at, n = begin[part], size[part]
        steps = np.stack([whole[at + t], whole[at + np.maximum(n - 1 - t, 0)]], 1).astype(np.intp)
        out = _forward(net, steps)
        forward, backward = net.v[0] @ out[:, 0], net.v[1] @ out[:, 1]
        turn = np.maximum(n - 1 - t, 0)  # the step at which the backward direction was at a position
        if (n == SPAN).all():
            z = forward + backward[::-1]
        else:
            z = forward + np.take_along_axis(backward, turn[:, None, :], 0)
        z += net.b[:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z *= ((t < n) / z.sum(1))[:, None, :]
        sums = z.sum(0)
        for c in range(k):
            total[:, c] += np.bincount(owner[part], sums[c], len(texts))
    return total / np.maximum(lengths, 1)[:, None]


def fold_key(id_col: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Net | None:
    """Trains on rows with a language and outside the held-out fold; a bounded sample of each language.

    Rows are picked by a hash of their id and cut to their slices before they are ranked.
    """
    own = docs.filter((fold_key(id_col) % FOLDS != 0) & F.col(lang_col).isNotNull())
    lang, picked = F.col(lang_col).cast("string"), F.xxhash64(F.lit("lang"), F.col(id_col))
    counts = own.groupBy(lang.alias("lang")).count().limit(MOST + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST:
        raise ValueError(f"more than {MOST} languages")
    # a share of each language's rows that holds a few times the sample, so that ranking it stays small
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 4 * per_language / r["count"])) for r in counts], "lang string, share double")
    start = lambda i: F.pmod(F.xxhash64(F.lit("start"), F.lit(i), F.col("h")), F.length("t") - CHARS).cast("int") + 1
    slices = F.concat_ws(" ", *[F.col("t").substr(start(i), F.lit(CHARS)) for i in range(SLICES)])
    text = F.when(F.length("t") <= SLICES * CHARS, F.col("t")).otherwise(slices)
    rows = own.select(lang.alias("lang"), picked.alias("h"), F.col(text_col).alias("t")).join(F.broadcast(shares), "lang")  # at most MOST rows
    rows = rows.filter((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("share")) & (F.length("t") > 0)).select("lang", "h", text.alias("t"))
    first = Window.partitionBy("lang").orderBy("h", "t")
    sample = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    return train(sorted((r.lang, r.t) for r in sample.select("lang", "t").collect()))


def label(docs: DataFrame, net: Net | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score, named ``names``, in place of the text."""
    prepare(docs.sparkSession)
    letter = free_name(docs, "__letter")
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(*[docs[c] for c in rest], docs[text_col], text_or_empty(text_col).rlike(LETTER).alias(letter))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, known = b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_numpy(zero_copy_only=False)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if net is not None and known.any():
                p = probabilities(net, [x.lower().encode() for x, k in zip(texts, known, strict=True) if k])
                lang[known] = np.array(net.languages, object)[p.argmax(1)]
                score[known] = np.minimum(p.max(1), 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return own.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``."""
    net = learn(docs, id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("doc_id"), (fold_key(id_col) % FOLDS == 0).alias("held_out"), F.col(text_col).alias("text"))
    return Scratch(docs.sparkSession, "language-id").table(label(own, net), "labels")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or has a score under ``least``."""
    net = learn(docs, id_col, text_col, lang_col)
    if net is None:
        return docs.filter(text_or_empty(text_col).rlike(LETTER))
    seen = label(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")), net)
    gone = seen.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("id", "key").distinct()
    return without(docs, Scratch(docs.sparkSession, "language-id").table(gone, "gone"), id_col, text_col)
