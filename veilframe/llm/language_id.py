"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions and gives every byte position a probability for
each language; a document's are the mean over its positions. Gates are piecewise linear, which numpy computes several
times faster than exponentials. It is trained in numpy by backpropagation through time on a bounded sample of labelled
rows; whole texts are then labelled in one narrow pass, each task a batch of windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

# The sample: documents of each language and of all, windows of a document, and bytes in a window. It is what comes to the
# driver, 77 MB at most; with more than 200 languages each has fewer documents in it, one at least.
DOCS_PER_LANGUAGE, DOCS_IN_ALL, WINDOWS_PER_DOC, TRAIN_WINDOW = 400, 80_000, 24, 40
WINDOW, BATCH = 64, 2048
HIDDEN, STEPS, BATCH_WINDOWS, RATE = 8, 500, 256, 0.02
UNKNOWN = "und"


@dataclass
class Network:
    """``embed`` (2, 3H, 256), ``recur`` (2, 3H, H) and ``out`` (K, 2H + 1), forward direction first. Of the 3H rows the
    first two thirds are the update and reset gates, the last the candidate."""

    labels: list[str]
    embed: np.ndarray
    recur: np.ndarray
    out: np.ndarray

    @classmethod
    def random(cls, labels: Sequence[str], hidden: int, seed: int = 1) -> Network:
        r, f = np.random.default_rng(seed), np.float32
        embed = r.normal(0, 0.3, (2, 3 * hidden, 256)).astype(f)
        recur = r.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(f)
        return cls(list(labels), embed, recur, r.normal(0, 0.3, (len(labels), 2 * hidden + 1)).astype(f))

    def states(self, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (time, 2H + 1, windows) of byte ids (time, windows); the last row is 1, for the bias.

        z, r = gate(x + U h); n = clip(x + r * (U h)); h = n + z * (h - n), with gate(a) = clip(a + 1/2) to [0, 1]."""
        time, size = ids.shape
        hidden = self.recur.shape[2]
        out = np.ones((time, 2 * hidden + 1, size), np.float32)
        h = np.zeros((2, hidden, size), np.float32)
        x = np.empty((2, 3 * hidden, size), np.float32)
        for t in range(time):
            np.take(self.embed[0], ids[t], axis=1, out=x[0], mode="clip")
            np.take(self.embed[1], ids[time - 1 - t], axis=1, out=x[1], mode="clip")
            a = self.recur @ h
            gates = a[:, : 2 * hidden]
            gates += x[:, : 2 * hidden]
            gates += 0.5
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            z, r = gates[:, :hidden], gates[:, hidden:]
            if trace is None:
                n = a[:, 2 * hidden :]
                n *= r
            else:
                n = a[:, 2 * hidden :] * r
            n += x[:, 2 * hidden :]
            np.maximum(n, -1, out=n)
            np.minimum(n, 1, out=n)
            if trace is not None:
                trace.append((h, z, r, n, a[:, 2 * hidden :]))
                h = n + z * (h - n)
            else:
                h -= n
                h *= z
                h += n
            out[t, :hidden] = h[0]
            out[time - 1 - t, hidden : 2 * hidden] = h[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(time, K, windows)"""
        p = self.out @ states
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradients(self, ids: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its derivatives by backpropagation through time."""
        time, size = ids.shape
        hidden = self.recur.shape[2]
        trace: list = []
        states = self.states(ids, trace)
        p = self.probabilities(states)
        loss = -float(np.log(p[:, labels, np.arange(size)] + 1e-9).mean())
        p[:, labels, np.arange(size)] -= 1
        p /= time * size
        d_out = np.einsum("tks,ths->kh", p, states, optimize=True)
        d_states = self.out.T @ p
        d_embed, d_recur = np.zeros_like(self.embed), np.zeros_like(self.recur)
        carried = np.zeros((2, hidden, size), np.float32)
        for t in range(time - 1, -1, -1):
            before, z, r, n, raw = trace[t]
            carried[0] += d_states[t, :hidden]
            carried[1] += d_states[time - 1 - t, hidden : 2 * hidden]
            d_n = carried * (1 - z) * (np.abs(n) < 1)
            d_z = carried * (before - n) * ((z > 0) & (z < 1))
            d_r = d_n * raw * ((r > 0) & (r < 1))
            d_x = np.concatenate([d_z, d_r, d_n], axis=1)
            d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_recur += d_a @ before.transpose(0, 2, 1)
            carried = carried * z + self.recur.transpose(0, 2, 1) @ d_a
            for way, at in ((0, t), (1, time - 1 - t)):
                order = np.argsort(ids[at], kind="stable")
                seen, first = np.unique(ids[at][order], return_index=True)
                d_embed[way][:, seen] += np.add.reduceat(d_x[way][:, order], first, axis=1)
        return loss, [d_embed, d_recur, d_out]

    def label(self, texts: Sequence[bytes]) -> np.ndarray:
        """(documents, K): mean probabilities over all bytes of each text; no text is empty."""
        sizes = np.array([len(t) for t in texts])
        windows = -(-sizes // WINDOW)
        ends = np.cumsum(windows)
        padded = b"".join(t.ljust(n * WINDOW, b" ") for t, n in zip(texts, windows.tolist()))
        ids = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
        sums = np.empty((len(ids), len(self.labels)), np.float32)
        filled = np.full(len(ids), WINDOW)
        filled[ends - 1] = sizes - (windows - 1) * WINDOW
        for a in range(0, len(ids), BATCH):
            part = np.ascontiguousarray(ids[a : a + BATCH].T).astype(np.intp)
            p = self.probabilities(self.states(part))
            p *= np.arange(WINDOW)[:, None, None] < filled[a : a + BATCH]
            sums[a : a + BATCH] = p.sum(0).T
        return np.add.reduceat(sums, ends - windows, axis=0, dtype=np.float64) / sizes[:, None]


def train(windows: np.ndarray, labels: np.ndarray, names: Sequence[str], steps: int = STEPS, seed: int = 1) -> Network:
    """Adam over random batches with as many windows of each language. ``windows`` is (n, bytes)."""
    net, r = Network.random(names, HIDDEN, seed), np.random.default_rng(seed)
    places = [np.flatnonzero(labels == k) for k in range(len(names))]
    each = -(-BATCH_WINDOWS // len(names))
    first = [np.zeros_like(w) for w in (net.embed, net.recur, net.out)]
    second = [np.zeros_like(w) for w in (net.embed, net.recur, net.out)]
    for step in range(1, steps + 1):
        at = np.concatenate([r.choice(p, each) for p in places])
        _, slopes = net.gradients(windows[at].T.astype(np.intp), labels[at])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        size = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        for w, s, m, v in zip((net.embed, net.recur, net.out), slopes, first, second):
            s *= min(1, 1 / (size + 1e-9))
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def _drawn(text: str, key: int) -> bytes:
    """Windows of a text for training, side by side: all over it, at places that its key decides."""
    data = text.encode()
    r = np.random.default_rng(key & 0xFFFFFFFF)
    starts = np.sort(r.integers(0, max(1, len(data) - TRAIN_WINDOW + 1), WINDOWS_PER_DOC))
    return b"".join(data[a : a + TRAIN_WINDOW].ljust(TRAIN_WINDOW, b" ") for a in starts.tolist())


def training_windows(docs: DataFrame, text_col: str, label_col: str, key: Column) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their labels' numbers and the labels, of ``DOCS_PER_LANGUAGE`` rows of each label or so (fewer where that would
    be more than ``DOCS_IN_ALL``): those whose key's hash is under the share that this number is of the label's rows. Only
    windows come to the driver, and a count for each label."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(key, text_col).alias("key"))
    rows = rows.where("label IS NOT NULL AND length(text) > 0")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    each = min(DOCS_PER_LANGUAGE, max(1, DOCS_IN_ALL // max(1, len(names))))
    if not names:
        return np.zeros((0, TRAIN_WINDOW), np.uint8), np.zeros(0, int), []
    share = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, each / counts[n]))]), F.col("label"))
    chosen = rows.where(F.pmod("key", F.lit(1 << 30)) / float(1 << 30) < share).orderBy("key", "label").limit(2 * each * len(names))

    @F.pandas_udf("binary")
    def drawn(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([_drawn(t, k) for t, k in zip(texts, keys)])

    picked = chosen.select("label", drawn("text", "key").alias("windows")).collect()
    windows = np.frombuffer(b"".join(r.windows for r in picked), np.uint8).reshape(-1, TRAIN_WINDOW)
    labels = np.repeat([names.index(r.label) for r in picked], WINDOWS_PER_DOC)
    seen = np.unique(labels)
    return windows, np.searchsorted(seen, labels), [names[k] for k in seen]


def predict(docs: DataFrame, net: Network, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score``, the mean probability of that language. Texts that are null or without a letter are
    ``und`` with score 1."""
    # Plain values: a class of this package could not be unpickled where the package isn't installed.
    shared = docs.sparkSession.sparkContext.broadcast((net.labels, net.embed, net.recur, net.out))
    slim = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shared.value)
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                texts = part.column(part.num_columns - 1).to_pylist()
                real = [i for i, t in enumerate(texts) if net.labels and next(filter(str.isalpha, t), None)]
                names, scores = [UNKNOWN] * len(texts), [1.0] * len(texts)
                if real:
                    p = net.label([texts[i].encode() for i in real])
                    for i, k, x in zip(real, p.argmax(1).tolist(), p.max(1).tolist()):
                        names[i], scores[i] = net.labels[k], min(1.0, x)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names), pa.array(scores, pa.float64())], names=schema.names)

    return slim.mapInArrow(label, schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id, ``held_out``, ``lang_pred`` and ``score`` of every row.

    Learned from text and language of rows outside the test fold only. Rows stay as they are, repeated ones and null ids
    included; with nothing to learn from, every text is ``und``, and an empty table gives an empty result. Of languages that
    are equally likely the first by name is taken. Texts are read whole, however long, a batch of windows at a time.
    """
    fold = held_out(id_col)
    windows, labels, names = training_windows(docs.where(~fold), text_col, lang_col, F.col(id_col))
    net = train(windows, labels, names) if len(names) else Network.random([], HIDDEN)
    slim = docs.select(F.col(id_col), fold.alias("held_out"), F.col(text_col).alias("__input"))
    return predict(slim, net, "__input", [id_col, "held_out"])
