"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked as good; everything else in the learning fold is unlabelled web text, bad marks
included, whose marks are not looked at. The class prior, the share of good documents in the unlabelled text, is
estimated first; then a small network minimises the non-negative unbiased risk

    prior * E_p[l(f, +)] + max(0, E_u[l(f, -)] - prior * E_p[l(f, -)]).

A document is 280-odd numbers of its bytes and words. They are computed where the text lies; only those of a bounded
sample come to the driver, where the fit runs in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

# The sample: about so many trusted positives and unlabelled documents.
POSITIVES, UNLABELLED = 5_000, 10_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 600, 512, 0.01, 1e-4

# Kinds of bytes; pairs of neighbouring kinds are counted.
_KINDS = np.full(256, 15, np.uint8)
for _k, _bytes in enumerate([b"aeiou", bytes(range(97, 123)), b"AEIOU", bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b"\t\r\x0b\x0c"]):
    _at = np.frombuffer(_bytes, np.uint8)
    _KINDS[_at[_KINDS[_at] == 15]] = _k
for _k, _bytes in enumerate([b".", b",", b"!?", b"|", b"#$%&*<>@^~", b"'\"()-:;", bytes(range(128, 256))], 8):
    _KINDS[np.frombuffer(_bytes, np.uint8)] = _k
N_PAIRS, N_SHAPE = 256, 10
N_FEATURES = N_PAIRS + N_SHAPE


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte-kind pairs, and ten measures of words and lines; all 0 for a text without words."""
    out = np.zeros(N_FEATURES, np.float32)
    data = (text or "").encode()
    words = data.split()
    if not words:
        return out
    kinds = _KINDS[np.frombuffer(data, np.uint8)]
    if len(kinds) > 1:
        out[:N_PAIRS] = np.sqrt(np.bincount(kinds[:-1] * np.uint8(16) + kinds[1:], minlength=N_PAIRS) / (len(kinds) - 1))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, distinct = len(words), len(set(words))
    pairs = set(zip(words, words[1:]))
    out[N_PAIRS:] = (
        1,
        np.log1p(n) / 10,
        distinct / n,
        min(1.0, distinct / n**0.8),
        len(pairs) / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(1.0, sum(map(len, words)) / n / 20),
        len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 200),
        sum(map(bytes.isupper, words)) / n,
    )
    return out


def scaled(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / deviation, -5, 5)


@dataclass
class Classifier:
    mean: np.ndarray
    deviation: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return 1 / (1 + np.exp(-(np.maximum(scaled(x, self.mean, self.deviation) @ w1 + b1, 0) @ w2 + b2)))


def _slope(weights: list[np.ndarray], x: np.ndarray, of_score) -> tuple[np.ndarray, list[np.ndarray]]:
    """Raw scores, and the gradient of a sum over rows whose derivative by the raw score is ``of_score(raw)``."""
    w1, b1, w2, b2 = weights
    h = np.maximum(x @ w1 + b1, 0)
    raw = h @ w2 + b2
    d = of_score(raw)
    d_h = d[:, None] * w2 * (h > 0)
    return raw, [x.T @ d_h, d_h.sum(0), h.T @ d, d.sum(keepdims=True)]


def _fit(positive: np.ndarray, unlabelled: np.ndarray, slopes, seed: int, steps: int) -> list[np.ndarray]:
    """Adam over random batches of both; ``slopes(weights, p, u)`` is the gradient of the risk."""
    r, f = np.random.default_rng(seed), np.float32
    size = positive.shape[1]
    weights = [r.normal(0, 1 / np.sqrt(size), (size, HIDDEN)).astype(f), np.zeros(HIDDEN, f), r.normal(0, 0.3, HIDDEN).astype(f), np.zeros(1, f)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        gradient = slopes(weights, positive[r.integers(0, len(positive), BATCH)], unlabelled[r.integers(0, len(unlabelled), BATCH)])
        for w, g, m, v in zip(weights, gradient, first, second):
            g = g + DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= RATE * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 1) -> float:
    """Share of positives among the unlabelled. A network learns to tell the two apart on one half of each; on the other
    half, the share of unlabelled rows above a score is at least the prior times that of positives, and the tightest such
    bound over all scores, with a margin for few rows, is the estimate."""

    def slopes(weights, p, u):
        _, a = _slope(weights, p, lambda s: (_sigmoid(s) - 1) / len(p))
        _, b = _slope(weights, u, lambda s: _sigmoid(s) / len(u))
        return [x + y for x, y in zip(a, b)]

    w1, b1, w2, b2 = _fit(positive[::2], unlabelled[::2], slopes, seed, STEPS // 2)
    p, u = (np.sort(np.maximum(x[1::2] @ w1 + b1, 0) @ w2 + b2) for x in (positive, unlabelled))
    cuts = np.concatenate([[-np.inf], np.quantile(p, np.linspace(0, 0.95, 96))])
    q_p = 1 - np.searchsorted(p, cuts) / len(p)
    q_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((q_u + margin) / np.maximum(q_p, 1e-9))
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 1) -> Classifier:
    """Classifier from features of trusted positives and of unlabelled documents."""
    mean, deviation = unlabelled.mean(0), unlabelled.std(0) + 0.01
    p_all, u_all = (scaled(x, mean, deviation).astype(np.float32) for x in (positive, unlabelled))
    prior = estimate_prior(p_all, u_all, seed)

    def slopes(weights, p, u):
        # Sigmoid loss: l(f, +) = s(-f), l(f, -) = s(f); its slope is s(f) s(-f).
        steep = lambda s: _sigmoid(s) * _sigmoid(-s)
        # l(f, +) and -l(f, -) have the same slope, so the positives' share counts once in each part of the risk.
        raw_p, from_p = _slope(weights, p, lambda s: -prior * steep(s) / len(p))
        raw_u, from_u = _slope(weights, u, lambda s: steep(s) / len(u))
        negative_risk = _sigmoid(raw_u).mean() - prior * _sigmoid(raw_p).mean()
        if negative_risk < 0:  # over-fitted: step back along the negative part alone
            return [-(a + b) for a, b in zip(from_u, from_p)]
        return [2 * b + a for a, b in zip(from_u, from_p)]

    return Classifier(mean, deviation, _fit(p_all, u_all, slopes, seed + 1, STEPS), prior)


def _with_features(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    @F.pandas_udf("binary")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).tobytes() for t in texts])

    return docs.select(*keep, vectors(F.col(text)).alias("x"))


def _matrix(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, N_FEATURES)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Classifier | None:
    """Classifier from rows outside the test fold, None where there is no trusted positive or no text. Rows are drawn by a hash of
    their ids, as many as the bounds say or so, and never more than twice that."""
    ids = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.xxhash64(F.lit(13), id_col).alias("h"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(~held_out("id")).distinct()
    positives = ids.join(good, "id", "left_semi")

    def drawn(rows: DataFrame, bound: int) -> DataFrame:
        n = rows.count()
        return rows.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / max(1, n)))).orderBy("h", "id").limit(2 * bound)

    def vectors(rows: DataFrame) -> np.ndarray:
        chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows.select("id").distinct()), "id", "left_semi")
        return _matrix(_with_features(chosen, "text", ["id"]).orderBy("id", "x").collect())

    p, u = vectors(drawn(positives, POSITIVES)), vectors(drawn(ids, UNLABELLED))
    return fit(p, u) if min(len(p), len(u)) > 1 else None


def score(docs: DataFrame, model: Classifier | None, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every row; without a model the score is 0.5."""
    # Plain values: a class of this package could not be unpickled where the package isn't installed.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.mean, model.deviation, model.weights, model.prior))
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Classifier(*shared.value)
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                x = np.stack([features(t.as_py()) for t in part.column(part.num_columns - 1)])
                scores = model.scores(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores.astype(np.float64))], names=schema.names)

    return slim.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The id, ``held_out``, ``score`` (higher: rather good) and ``predicted`` of every row.

    Null and empty texts are scored like others, as texts without words. Rows stay as they are, repeated ones and null
    ids included; an empty table gives an empty result. The score depends on the text alone, read whole, so equal texts
    have equal scores, and one of exactly 0.5 is predicted as good.
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    slim = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__input"))
    return score(slim, model, "__input", [id_col, "held_out"])
