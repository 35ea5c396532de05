"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose label is 1; everything else counts as unlabelled, whatever its
label. The class prior is estimated from the two samples alone: of all thresholds of a first classifier
(positive against unlabelled), the one that leaves the smallest ratio of the unlabelled share above it to
the positive share, with a margin for the sample's size. A small network then minimises the non-negative
unbiased risk prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) of the logistic loss, so that its
output, through the logistic function, is the probability of label 1.

Inputs of a score are shares of character classes and words over the whole text, never labels, language,
source or id. Training reads a hashed sample of at most about ``sample`` positives and ``sample``
unlabelled documents, which bounds the driver's work; scoring reads every text.

Null texts are scored as empty ones. A doc_id with labels 0 and 1 is not trusted; repeated rows and ids
are scored row by row. A null doc_id is not held out. Without positives or documents to learn from, every
score is 0.5. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import prepare

SAMPLE = 12_000
THRESHOLD = 0.7
HELD_OUT = 2
SEED = 29
#: Class of each byte: every ASCII mark has one of its own.
_CLASS = np.zeros(256, np.int64)
_marks = [x for x in range(33, 127) if not chr(x).isalnum()]
for _k, _test in enumerate((lambda x: 97 <= x < 123, lambda x: 65 <= x < 91, lambda x: 48 <= x < 58, lambda x: x in (10, 13), lambda x: x in (32, 9, 11, 12), lambda x: x >= 128)):
    _CLASS[[x for x in range(256) if _test(x)]] = _k + 1
for _k, _x in enumerate(_marks):
    _CLASS[_x] = 7 + _k
CLASSES = 7 + len(_marks)
FEATURES = CLASSES + 8


def features(text: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    out = np.zeros((len(text), FEATURES))
    for i, j, buf, off in tc.chunks(text):
        n_bytes = np.diff(off)
        row = np.repeat(np.arange(j - i), n_bytes)
        kinds = np.bincount(row * CLASSES + _CLASS[buf], minlength=(j - i) * CLASSES).reshape(j - i, CLASSES)
        f = out[i:j]
        f[:, :CLASSES] = np.log1p(1000 * kinds / np.maximum(n_bytes, 1)[:, None])
        starts, ends, ptr = tc.spans(buf, off)
        n = np.diff(ptr)
        words, own = tc.word_hashes(buf, starts, ends), tc.rows_of(ptr)
        length = ends - starts
        of = lambda x, own=own, j=j, i=i: np.bincount(own, x, minlength=j - i)
        lag = lambda k, words=words, own=own, j=j, i=i: np.bincount(own[k:][(words[k:] == words[:-k]) & (own[k:] == own[:-k])], minlength=j - i)
        upper, least = np.zeros(len(buf) + 1, np.int64), np.maximum(n, 1)
        np.cumsum((buf >= 65) & (buf < 91), out=upper[1:])
        caps = (upper[ends] - upper[starts]) * 2 > length
        order = np.lexsort((words, own))
        w, o = words[order], own[order]
        distinct = np.bincount(o[np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])]] if len(o) else o, minlength=j - i)
        few = np.log1p(1000 * np.clip(1 - distinct / least ** 0.5 / 4, 0, 1))
        tail = tc.PUNCT_SPACE[buf[np.maximum(ends - 1, 0)]] if len(buf) else np.zeros(0, bool)
        f[:, CLASSES:] = np.stack([np.log1p(n), of(length) / least, np.log1p(1000 * lag(1) / least), np.log1p(1000 * lag(2) / least), few * (n > 20), np.log1p(1000 * of(caps * (length > 2)) / least), of(tail) / least, of(length <= 2) / least], 1)
    return out


@dataclass
class Model:
    """A network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        # Rounded, as the last bits of a matrix product depend on how many rows are in it.
        return np.round(1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30))), 9)


_sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_p(+1), and R_u(-1) - prior * R_p(-1), of the logits of positives and unlabelled."""
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def risk_step(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By what the logits are moved: the gradient of the sum of both parts, or, where the second is below 0, of what undoes that."""
    if risk(zp, zu, prior)[1] >= 0:
        return prior * (_sigmoid(zp) - 1) / len(zp) - prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    return prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, batch: int = 512, rate: float = 5e-3, seed: int = SEED) -> Model:
    """Non-negative risk with a prior; without one, positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    m = Model(both.mean(0), both.std(0) + 1e-3, rng.normal(0, 0.3, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1))
    p, u = (np.clip((x - m.mean) / m.scale, -8, 8) for x in (pos, unl))
    params = [m.w1, m.b1, m.w2, m.b2]
    first, second, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    rounds = max(25, min(len(u), 30_000) // batch)
    for epoch in range(epochs):
        for _ in range(rounds):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ m.w1 + m.b1)
            z = h @ m.w2 + m.b2[0]
            if prior is None:
                g = (_sigmoid(z) - np.repeat((1.0, 0.0), batch)) / batch
            else:
                g = np.concatenate(risk_step(z[:batch], z[batch:], prior))
            dh = np.outer(g, m.w2) * (1 - h * h)
            grads = [x.T @ dh + 1e-5 * m.w1, dh.sum(0), h.T @ g + 1e-5 * m.w2, np.array([g.sum()])]
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for k, (w, d) in enumerate(zip(params, grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled scores, from the scores of both."""
    pos, unl = np.sort(pos), np.sort(unl)
    at = np.quantile(pos, np.linspace(0, 0.95, 96))
    above = lambda x: 1 - np.searchsorted(x, at, "left") / len(x)
    p, u = above(pos), above(unl)
    margin = np.sqrt(np.log(200) / (2 * len(unl))) + np.sqrt(np.log(200) / (2 * len(pos)))
    best = np.argmin((u + margin * (1 + u / np.maximum(p, 1e-9))) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = SEED) -> Model | None:
    """The model, or None where there is nothing to learn from."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    half_p, half_u = len(pos) // 2, len(unl) // 2
    first = _train(pos[:half_p], unl[:half_u], None, epochs=10, seed=seed)
    prior = estimate_prior(first.logit(pos[half_p:]), first.logit(unl[half_u:]))
    model = _train(pos, unl, prior, seed=seed)
    model.prior = prior
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def _share(hash_of: Column, wanted: int, there: int) -> Column:
    """A hashed sample of about wanted of there rows."""
    return F.lit(True) if there <= wanted else F.pmod(hash_of, F.lit(1 << 30)) < int((1 << 30) * wanted / there)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 AND doc_id IS NOT NULL")
    good = good.where(_share(F.xxhash64("doc_id", F.lit(SEED)), sample, good.count())).select("doc_id", F.lit(1).alias("good"))
    # About ``sample`` ids at most, so broadcasting them is safe at any size of the tables.
    unl = _share(F.xxhash64("doc_id", "text", F.lit(SEED + 1)), sample, docs.count())
    both = docs.where(~held_out()).join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"), unl.alias("unl")).where("good = 1 OR unl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["good", "unl", "x"])

    rows = both.mapInArrow(run, "good int, unl boolean, x array<float>").toArrow()
    if not rows.num_rows:
        return None
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, FEATURES).astype(np.float64)
    good_row, unl_row = rows.column("good").to_numpy() == 1, rows.column("unl").to_numpy()
    # The order in which tasks end must not matter.
    order = np.lexsort((good_row, unl_row, *x.T))
    order = order[np.random.default_rng(SEED).permutation(len(order))]
    x, good_row, unl_row = x[order], good_row[order], unl_row[order]
    return fit(x[good_row], x[unl_row])


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double) and predicted (int)."""
    prepare(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(features(b.column(at))) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, by a model of the labels that are not held out."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return classify(rows, train(docs, labels, sample)).select("doc_id", "held_out", "score", "predicted")
