"""Language identification by a bidirectional gated recurrent network over bytes.

Two minimal gated units read each window of WINDOW bytes, one from either side; every position
gets label probabilities from both states, and a text's probabilities are the mean over
all its positions. The network is trained in numpy by backpropagation through time, on the driver, on at
most SAMPLE_TEXTS texts of each language (chosen by hash of doc_id, so the sample's size does not grow
with the table) of the training folds, WINDOWS windows spread evenly over each, every other one cut to SHORT bytes as
short texts are. Prediction reads whole
texts, in batches of windows, and needs no shuffle.

A held-out row is one with crc32(doc_id) mod FOLDS = HELD_OUT; it is never learned from. The only
input of a prediction is the text. Edge cases: a null text, or one without a letter, is `und` with score 0; so is
every text if there is nothing to learn from; a null doc_id is not held out (crc32 of null is
unknown) and not learned from; rows with a null lang are predicted only; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow, documents
from ._text import buffers

FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
WINDOW, HIDDEN = 128, 12
SAMPLE_TEXTS, WINDOWS, SHORT, EPOCHS, BATCH, RATE, SEED = 600, 6, 32, 8, 128, 0.01, 7
#: Windows predicted at once.
AT_ONCE = 2048
PAD = 256

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(z: np.ndarray) -> np.ndarray:
    z *= np.float32(0.5)
    np.tanh(z, out=z)
    z *= np.float32(0.5)
    z += np.float32(0.5)
    return z


@dataclass
class Unit:
    """A minimal gated unit: f = s(F[x] + h A), g = tanh(G[x] + (f h) B), h' = h + f (g - h)."""

    F: np.ndarray
    G: np.ndarray
    A: np.ndarray
    B: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator, hidden: int) -> Unit:
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        unit = cls(draw(PAD + 1, hidden), draw(PAD + 1, hidden), draw(hidden, hidden), draw(hidden, hidden))
        unit.pad()
        return unit

    def pad(self) -> None:
        """Padding closes the gate: the state stays as it is."""
        self.F[PAD], self.G[PAD] = -40, 0

    def states(self, x: np.ndarray, order: range, keep: dict | None = None) -> np.ndarray:
        """State after each position of x (positions x windows), read in order."""
        h = np.zeros((x.shape[1], self.A.shape[0]), np.float32)
        out = np.empty((x.shape[0], *h.shape), np.float32)
        if keep is not None:
            keep["f"], keep["g"], keep["h"] = np.empty_like(out), np.empty_like(out), np.empty_like(out)
        for t in order:
            f = self.F.take(x[t], 0)
            f += h @ self.A
            f = _sigmoid(f)
            g = self.G.take(x[t], 0)
            g += (f * h) @ self.B
            np.tanh(g, out=g)
            if keep is not None:
                keep["f"][t], keep["g"][t], keep["h"][t] = f, g, h
            g -= h
            g *= f
            h = np.add(h, g, out=out[t])
        return out

    def gradients(self, x: np.ndarray, order: range, keep: dict, d_out: np.ndarray) -> Unit:
        """Backpropagation through time of the loss gradients d_out at the states."""
        grad = Unit(*(np.zeros_like(p) for p in (self.F, self.G, self.A, self.B)))
        dzf, dzg = np.empty_like(d_out), np.empty_like(d_out)
        dh = np.zeros(d_out.shape[1:], np.float32)
        for t in reversed(order):
            f, g, h = keep["f"][t], keep["g"][t], keep["h"][t]
            dh = dh + d_out[t]
            dz = dzg[t] = dh * f * (1 - g * g)
            back = dz @ self.B.T
            grad.B += (f * h).T @ dz
            df = dh * (g - h) + back * h
            dh = dh * (1 - f) + back * f
            dz = dzf[t] = df * f * (1 - f)
            grad.A += h.T @ dz
            dh += dz @ self.A.T
        at = x.ravel()
        for k in range(self.A.shape[0]):
            grad.F[:, k] = np.bincount(at, dzf[..., k].ravel(), PAD + 1)
            grad.G[:, k] = np.bincount(at, dzg[..., k].ravel(), PAD + 1)
        grad.F[PAD] = grad.G[PAD] = 0
        return grad


@dataclass
class Network:
    labels: list[str]
    units: list[Unit] = field(default_factory=list)
    out: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        n = len(labels)
        return cls(labels, [Unit.new(rng, hidden) for _ in range(2)], [(rng.standard_normal((hidden, n)) * 0.3).astype(np.float32) for _ in range(2)], np.zeros(n, np.float32))

    def probabilities(self, x: np.ndarray, keep: list[dict] | None = None) -> np.ndarray:
        """Label probabilities at each position: labels x positions x windows."""
        t, b = x.shape
        orders = [range(t), range(t - 1, -1, -1)]
        states = [u.states(x, o, None if keep is None else keep[i]) for i, (u, o) in enumerate(zip(self.units, orders, strict=True))]
        if keep is not None:
            for k, s in zip(keep, states, strict=True):
                k["out"] = s
        p = sum(v.T @ s.reshape(t * b, -1).T for v, s in zip(self.out, states, strict=True)) + self.bias[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(len(self.labels), t, b)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, seed: int = SEED) -> None:
        """Cross-entropy at every position, by Adam. x: positions x windows; y: label of each window."""
        rng = np.random.Generator(np.random.PCG64(seed))
        params = [p for u in self.units for p in (u.F, u.G, u.A, u.B)] + self.out + [self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t, step, steps = x.shape[0], 0, epochs * max(1, -(-x.shape[1] // batch))
        for _ in range(epochs):
            order = rng.permutation(x.shape[1])
            for a in range(0, len(order), batch):
                mine = order[a : a + batch]
                xb, yb, keep = np.ascontiguousarray(x[:, mine]), y[mine], [{}, {}]
                d = self.probabilities(xb, keep)
                live = xb != PAD
                d[yb, :, np.arange(len(mine))] -= 1
                d *= live / max(1, int(live.sum()))
                d = d.reshape(len(self.labels), -1).astype(np.float32)
                orders = [range(t), range(t - 1, -1, -1)]
                grads: list[np.ndarray] = []
                for u, v, k, o in zip(self.units, self.out, keep, orders, strict=True):
                    g = u.gradients(xb, o, k, (d.T @ v.T).reshape(k["out"].shape))
                    grads += [g.F, g.G, g.A, g.B]
                grads += [(d @ k["out"].reshape(-1, v.shape[0])).T for v, k in zip(self.out, keep, strict=True)] + [d.sum(1)]
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for p, g, m, s in zip(params, grads, first, second, strict=True):
                    np.clip(g, -1, 1, out=g)
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                for u in self.units:
                    u.pad()

    def pooled(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean label probabilities over all positions of each text; 0 for an empty one."""
        sizes = np.diff(offs)
        count = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), count)
        start = np.repeat(offs[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        end = np.minimum(start + WINDOW, offs[1:][text])
        total = np.zeros((len(sizes), len(self.labels)))
        steps = np.arange(WINDOW)[:, None]
        for a in range(0, len(text), AT_ONCE):
            s, e = start[a : a + AT_ONCE], end[a : a + AT_ONCE]
            at = s + steps
            live = at < e
            x = np.where(live, data[np.minimum(at, len(data) - 1)], PAD)
            p = self.probabilities(x) * live
            np.add.at(total, text[a : a + AT_ONCE], p.sum(1, dtype=np.float64).T)
        return total / np.maximum(sizes, 1)[:, None]

    def positions(self, text: str) -> list[str]:
        """The label of every byte of a text."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.int64)
        out: list[str] = []
        for a in range(0, len(data), WINDOW):
            out += [self.labels[k] for k in self.probabilities(data[a : a + WINDOW, None])[:, :, 0].argmax(0)]
        return out


def windows_of(text: bytes, n: int = WINDOWS) -> list[bytes]:
    """Up to n windows, spread evenly over the whole text."""
    last = max(0, len(text) - WINDOW)
    starts = {last * k // max(1, n - 1) for k in range(n)} if last else {0}
    return [text[s : s + WINDOW] for s in sorted(starts) if text]


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"))


def learn(docs: DataFrame) -> Network | None:
    """A network trained on the sample of docs (with_fold); None if no row has text and lang."""
    rows = docs.where("not held_out and doc_id is not null and lang is not null and length(text) > 0")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    labels = sorted(counts)
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, 1_000_000 * SAMPLE_TEXTS // n + 1)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("doc_id", "lang", "text")
    taken: dict[str, int] = {}
    x, y = [], []
    for r in sorted(sample.collect()):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= 2 * SAMPLE_TEXTS:
            for k, w in enumerate(windows_of(r.text.encode("utf-8"))):
                w = w[:SHORT] if k % 2 else w
                x.append(np.pad(np.frombuffer(w, np.uint8).astype(np.int64), (0, WINDOW - len(w)), constant_values=PAD))
                y.append(labels.index(r.lang))
    if not x:
        return None
    network = Network.new(labels)
    network.train(np.array(x).T, np.array(y))
    return network


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER[np.frombuffer(text, np.uint8)].any()) or any(c.isalpha() for c in text.decode("utf-8"))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per row of docs (doc_id, held_out, lang_pred, score)."""
    spark = docs.sparkSession
    arrow(spark)
    sent = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            n = batch.num_rows
            lang, score = [UNKNOWN] * n, np.zeros(n)
            if net is not None:
                data, offs = buffers(batch.column(2))
                p = net.pooled(data, offs)
                best = p.argmax(1)
                for i in range(n):
                    if offs[i + 1] > offs[i] and has_letter(data[offs[i] : offs[i + 1]].tobytes()):
                        lang[i], score[i] = net.labels[best[i]], round(min(1.0, float(p[i, best[i]])), 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(documents(spark, sf_dir))
    return predict(docs, learn(docs))
