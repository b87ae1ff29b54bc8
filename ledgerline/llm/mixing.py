"""Mixing sources to target weights through soft domain membership.

1. A softmax classifier over hashed words, fitted on a bounded sample of labelled rows, gives every
   document a posterior over the domains (the label classes).
   A document's tokens are its ids under the byte-level BPE that packing counts in.
2. Nonnegative document rates w are fitted by distributed least squares: the expected tokens of each
   domain, sum of w * tokens * posterior, are to match the targets. Projected gradient steps go from
   rates of 1: w becomes max(0, y - a . u), where y is w carried on by momentum (which restarts when the
   residual grows), a the document's tokens by domain and u the residual of y in the metric of the
   domains' Gram matrix, so that a step of 1 is never too long and passes stay few. A pass over (tokens,
   posterior) replays the steps so far for its rows and returns a sum for each domain; nothing else
   reaches the driver and no rate is stored. The steps end when each domain is within CLOSE of its goal
   or the residual stalls, as where targets cannot be met; ``Fit.errors`` has what is missed, and a miss
   is warned of; steps have no cap.
3. ``mix_documents`` repeats or drops documents: a rate r gives floor(r) copies and one more with
   probability r - floor(r), decided by a hash of the id and text. It keeps the documents beside their
   posteriors, so that nothing is shuffled or joined.

Defined results: a null or empty text has no tokens, the prior as posterior and rate 1; a wordless
text has the prior; repeated
rows get equal rates; without labelled rows there is one domain and every rate is the same; an empty
table gives an empty result; a null id is hashed as such; columns that clash with the label table's
or with the results' are not touched.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, batches as batches_of, lean, prepare, Scratch
from .tokens import tokens as encoder

#: Labelled rows that the classifier may learn from (where ids repeat, the first by a hash); hashed
#: word features; gradient steps.
SAMPLE, FEATURES, STEPS = 4000, 1 << 13, 200
#: The relative error at which the rate fit ends.
CLOSE = 1e-4
#: Rows of (tokens, posterior) handed to a worker at once.
SLIM_ROWS = 4096
#: The passes without a residual less by 1 % after which the fit has stalled.
STALL = 8
#: Domain of a label row, and the share of tokens that each domain is to have.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'high' when quality = 0 then 'low' end"
TARGETS = {"high": 0.80, "low": 0.18, "toxic": 0.02}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % FEATURES
        return value


_words = _Words()
CACHES.append(_words)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a text: places, weights (log counts, unit length)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    at = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    at, n = np.unique(at, return_counts=True)
    weight = np.log1p(n)
    return at, weight / np.sqrt((weight**2).sum())


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # features x domains
    prior: np.ndarray  # log

    def posterior(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z = self.prior + weight @ self.weights[at] if len(at) else self.prior
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Softmax regression on at most ``sample`` labelled rows, chosen by a hash of their ids, then of their words."""
    chosen = labels.select(F.col("doc_id").alias("__id"), F.expr(domain).alias("__domain")).filter("__domain is not null and __id is not null")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__domain").limit(sample).dropDuplicates(["__id"])
    own = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text"))

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0].astype(np.uint16).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary())], names=["domain", "at", "weight"])

    joined = own.join(F.broadcast(chosen), F.col("__own") == F.col("__id")).select("__domain", "__text")  # at most `sample` rows are broadcast
    with batches_of(docs.sparkSession):
        rows = joined.mapInArrow(extract, "domain string, at binary, weight binary").orderBy(F.xxhash64("at", "domain")).limit(sample).collect()
    domains = sorted({r.domain for r in rows}) or ["all"]
    weights, y = np.zeros((FEATURES, len(domains))), np.array([domains.index(r.domain) for r in rows], np.int64)
    counts = np.bincount(y, minlength=len(domains)) if len(rows) else np.ones(1)
    prior = np.log((counts + 1) / (counts + 1).sum())
    if len(domains) > 1:
        at = np.concatenate([np.frombuffer(r["at"], np.uint16) for r in rows]).astype(np.int64)
        value = np.concatenate([np.frombuffer(r.weight, np.float32) for r in rows]).astype(float)
        row = np.repeat(np.arange(len(rows)), [len(r["at"]) // 2 for r in rows])
        by = np.argsort(at, kind="stable")
        col, first = np.unique(at[by], return_index=True)
        target = np.eye(len(domains))[y]
        speed = np.zeros_like(weights)
        for _ in range(STEPS):
            z = np.stack([np.bincount(row, value * weights[at, d], len(rows)) for d in range(len(domains))], 1) + prior
            z = np.exp(z - z.max(1, keepdims=True))
            apart = z / z.sum(1, keepdims=True) - target
            grad = 1e-5 * weights
            grad[col] += np.add.reduceat(value[by][:, None] * apart[row[by]], first) / len(rows)
            speed = 0.9 * speed - 60.0 * grad
            weights += speed
    return Classifier(domains, weights, prior)


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", paths: tuple = (), whole: bool = False) -> DataFrame:
    """(doc_id, key, tokens, posterior) per row; key: xxhash64 of the text; tokens: its ids under the BPE of ``paths``.

    ``whole`` puts the row itself, a struct, in place of the id.
    """
    last = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole else F.col(text_col).alias("text")
    first = [] if whole else [F.col(id_col).alias("doc_id")]
    own = docs.select(*first, F.xxhash64(F.col(id_col), F.col(text_col)).alias("key") if whole else F.xxhash64(F.col(text_col)).alias("key"), last)
    schema = T.StructType([own.schema["row"] if whole else own.schema["doc_id"], *T.StructType.fromDDL("key long, tokens long, posterior array<double>").fields])
    place = docs.columns.index(text_col) if whole else None

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, last = b.columns[-2:]
            encode, texts = encoder(*paths), [t or "" for t in (last.field(place) if whole else last).to_pylist()]
            p = [model.posterior(*features(t.encode())) for t in texts]
            flat = pa.array(np.concatenate(p) if p else np.empty(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(model.domains), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([last if whole else b.column(0), key, pa.array([len(encode.ids(t)) for t in texts], pa.int64()), lists], names=schema.names)

    return own.mapInArrow(run, schema)


def rates(a: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The iterate after ``steps`` (direction, momentum) from rates of 1; every iterate is nonnegative."""
    w = last = np.ones(len(a))
    for u, momentum in steps:
        last, w = w, np.maximum(0.0, w + momentum * (w - last) - a @ u)
    return w


@dataclass
class Fit:
    steps: list[tuple[np.ndarray, float]]  # up to the iterate that counts
    scale: np.ndarray  # of each domain
    mean: float  # tokens of a document
    totals: np.ndarray
    goal: np.ndarray
    errors: np.ndarray  # of each domain, relative to its goal


def _matrix(b: pa.RecordBatch, scale: np.ndarray, mean: float) -> np.ndarray:
    tokens = b.column("tokens").to_numpy().astype(float)
    p = b.column("posterior").flatten().to_numpy().reshape(len(tokens), -1)
    return p * (tokens / mean)[:, None] * scale


def _summed(soft: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of what ``of`` returns, an array of ``size`` numbers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            out += of(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["i", "v"])

    out = np.zeros(size)
    with batches_of(soft.sparkSession, SLIM_ROWS):
        for r in soft.select("tokens", "posterior").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
    return out


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float]) -> Fit:
    """Rates whose expected domain tokens come closest to shares ``targets`` of all tokens.

    Domains without a target keep their tokens. Where targets cannot be met, the iterate of the least
    residual counts and a warning says by how much each domain misses.
    """
    d, one = len(domains), np.ones(len(domains))

    def first(b: pa.RecordBatch) -> np.ndarray:
        a = _matrix(b, one, 1.0)
        return np.concatenate([[len(a), a.sum()], a.sum(0), (a.T @ a).ravel()])

    n, tokens, *rest = _summed(soft, first, 2 + d + d * d)
    if not tokens:
        return Fit([], one, 1.0, np.zeros(d), np.zeros(d), np.zeros(d))
    totals, gram = np.array(rest[:d]), np.array(rest[d:]).reshape(d, d)
    shares = np.array([targets.get(x, t / totals.sum()) for x, t in zip(domains, totals, strict=True)])
    goal = shares / shares.sum() * totals.sum()
    mean = tokens / n
    scale = mean / np.maximum(totals, 1e-9 * totals.sum())
    want, got = goal / mean * scale, totals / mean * scale  # in the units of a
    gram *= np.outer(scale, scale) / mean**2
    metric = np.linalg.inv(gram + 1e-9 * np.trace(gram) / d * np.eye(d))
    value = lambda sums: float((sums - want) @ metric @ (sums - want))

    steps: list[tuple[np.ndarray, float]] = []
    before, pace = got, 1.0
    errors, values = [(got - want) / np.maximum(want, 1e-9)], [value(got)]
    while np.abs(errors[-1]).max() >= CLOSE:
        if len(values) > STALL and min(values[-STALL:]) > 0.98 * min(values[:-STALL]):  # a residual less by 1 %
            break
        onward = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = float((pace - 1) / onward)
        u = metric @ (got + momentum * (got - before) - want)
        steps.append((np.array([float(f"{x:.12g}") for x in u]), momentum))  # sums differ in their last digits between runs
        now = list(steps)
        before, got = got, _summed(soft, lambda b: (a := _matrix(b, scale, mean)).T @ rates(a, now), d)
        errors.append((got - want) / np.maximum(want, 1e-9))
        values.append(value(got))
        pace = onward if values[-1] < values[-2] else 1.0
    last = len(steps)
    if np.abs(errors[-1]).max() >= CLOSE:
        last = int(np.argmin(values))
        warnings.warn(f"targets missed after {len(steps)} steps, relative errors: " + ", ".join(f"{x} {e:.3g}" for x, e in zip(domains, errors[last], strict=True)), stacklevel=2)
    return Fit(steps[:last], scale, mean, totals, goal, errors[last])


def with_rates(soft: DataFrame, fit: Fit) -> DataFrame:
    """``soft`` with the column ``rate``: the steps replayed for each row by an expression."""
    if not fit.steps:
        return soft.withColumn("rate", F.lit(1.0))
    own = [F.col("posterior")[j] * (F.col("tokens") / F.lit(float(fit.mean))) * F.lit(float(x)) for j, x in enumerate(fit.scale)]
    steps = F.array(*[F.struct(F.lit(m).alias("m"), *[F.lit(float(x)).alias(f"u{j}") for j, x in enumerate(u)]) for u, m in fit.steps])

    def onward(at: Column, step: Column) -> Column:
        down = sum((a * step[f"u{j}"] for j, a in enumerate(own)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), at["w"] + step["m"] * (at["w"] - at["last"]) - down).alias("w"), at["w"].alias("last"))

    return soft.withColumn("rate", F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("last")), onward, lambda at: at["w"]))


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, id_col: str, text_col: str, sample: int, paths: tuple, scratch: Scratch | None) -> tuple[DataFrame, list[str], Fit]:
    spark = docs.sparkSession
    prepare(spark)
    model = fit_classifier(docs, labels, sample=sample, id_col=id_col, text_col=text_col)
    soft = posteriors(docs, model, id_col, text_col, paths, scratch is not None)
    soft = (scratch or Scratch(spark, "mixing")).table(soft, "posteriors")
    fit = fit_rates(soft, model.domains, TARGETS if targets is None else targets)
    return with_rates(soft, fit), model.domains, fit


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, paths: tuple = ()) -> tuple[DataFrame, list[str], Fit]:
    """(doc_id, key, tokens, posterior, rate) per row of ``docs``; the domains; the fit."""
    return _fitted(docs, labels, targets, id_col, text_col, sample, paths, None)


def mix_documents(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, paths: tuple = (), scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` with each row as often as its rate says.

    The frame reads the table "posteriors" of ``scratch``, which holds the documents; who gives a scratch may
    free that table once the frame is written.
    """
    rated, _, _ = _fitted(docs, labels, targets, id_col, text_col, sample, paths, scratch or Scratch(docs.sparkSession, "mixing"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("key")), 11) / F.lit(float(1 << 53))
    times = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return rated.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
