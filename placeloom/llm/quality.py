"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters of
eight bytes at a stride of four run over every chunk, the strongest response of each filter in the chunk is kept
(max pooling), a small dense layer turns the pooled responses into a chunk logit, and the length-weighted mean of the
chunk logits gives one probability per document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP, STRIDE, EMBED, FILTERS, HIDDEN = 256, 32, 4, 6, 32, 32
STEP = CHUNK - OVERLAP
TILE = 64


@dataclass
class Params:
    """Fitting bounds: at most ``per_class`` labelled rows of each label, of texts up to ``longest`` characters."""

    per_class: int = 2000
    longest: int = 16384
    epochs: int = 8
    least_steps: int = 800
    batch: int = 32
    rate: float = 3e-3
    seed: int = 11


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) bytes, zero padded, and the bytes that each chunk adds; empty texts are one empty chunk."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-max(0, len(data) - OVERLAP) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data
    out = np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))
    size = np.minimum(CHUNK, len(data) - np.arange(n) * STEP)
    return out, np.maximum(size, 1).astype(np.float32)


class ByteConvNet:
    NAMES = ("emb", "wa", "wb", "bias", "v1", "c1", "v2", "c2")

    def __init__(self, seed: int = 0):
        g = np.random.default_rng(seed)
        group = STRIDE * EMBED
        self.emb = (g.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.wa = (g.standard_normal((group, FILTERS)) / 6).astype(np.float32)
        self.wb = (g.standard_normal((group, FILTERS)) / 6).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.v1 = (g.standard_normal((FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(np.float32)
        self.c1 = np.zeros(HIDDEN, dtype=np.float32)
        self.v2 = (g.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.c2 = np.zeros(1, dtype=np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        groups = self.emb[x].reshape(len(x) * (CHUNK // STRIDE), STRIDE * EMBED)
        a = (groups @ self.wa).reshape(len(x), -1, FILTERS)
        b = (groups @ self.wb).reshape(len(x), -1, FILTERS)
        r = a[:, :-1]
        r += b[:, 1:]
        if not where:
            return r.max(axis=1) + self.bias
        at = r.argmax(axis=1)
        return np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias, at, groups.reshape(len(x), -1, STRIDE * EMBED)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), TILE):
            h = np.maximum(self.pooled(x[at : at + TILE]), 0)
            parts.append(np.maximum(h @ self.v1 + self.c1, 0) @ self.v2 + self.c2)
        return np.concatenate(parts)[:, 0]

    def score(self, texts) -> np.ndarray:
        """Probability of label 1 for every whole text."""
        held, owner, size, count = [], [], [], 0

        def flush():
            z, w, o = self.logits(np.concatenate(held)).astype(np.float64), np.concatenate(size).astype(np.float64), np.concatenate(owner)
            total[:] += np.bincount(o, z * w, len(texts))
            weight[:] += np.bincount(o, w, len(texts))

        total, weight = np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts):
            x, s = chunks_of(text)
            for at in range(0, len(x), 4096):
                held.append(x[at : at + 4096])
                size.append(s[at : at + 4096])
                owner.append(np.full(len(held[-1]), i))
                count += len(held[-1])
                if count >= 4096:
                    flush()
                    held, owner, size, count = [], [], [], 0
        if held:
            flush()
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(weight, 1e-9), -50, 50)))

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, p: Params) -> ByteConvNet:
        cut = [chunks_of(t) for t in texts]
        g = np.random.default_rng(p.seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        each = -(-len(texts) // p.batch)
        epochs = max(p.epochs, -(-p.least_steps // each))  # small samples get as many steps
        t, steps = 0, epochs * each
        for _ in range(epochs):
            order = g.permutation(len(texts))
            for at in range(0, len(order), p.batch):
                ids = order[at : at + p.batch]
                grads = self._gradients(
                    np.concatenate([cut[i][0] for i in ids]),
                    np.concatenate([cut[i][1] / cut[i][1].sum() for i in ids]),
                    np.repeat(np.arange(len(ids)), [len(cut[i][0]) for i in ids]),
                    labels[ids],
                    weights[ids],
                )
                t += 1
                rate = p.rate * (1 - 0.9 * t / steps)
                for k, d in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
        return self

    def _gradients(self, x, share, owner, y, w) -> dict[str, np.ndarray]:
        pooled, at, groups = [], [], []
        for k in range(0, len(x), TILE):
            a, b, c = self.pooled(x[k : k + TILE], True)
            rows = np.arange(len(a))[:, None]
            pooled.append(a)
            at.append(b)
            groups.append((c[rows, b], c[rows, b + 1]))  # inputs of each filter's strongest place
        m, at = np.concatenate(pooled), np.concatenate(at)
        ga, gb = (np.concatenate([q[i] for q in groups]) for i in (0, 1))
        h = np.maximum(m, 0)
        k = np.maximum(h @ self.v1 + self.c1, 0)
        z = (k @ self.v2 + self.c2)[:, 0]
        doc = np.bincount(owner, z * share, len(y))
        prob = 1 / (1 + np.exp(-doc))
        dz = (((prob - y) * w / w.sum())[owner] * share).astype(np.float32)[:, None]
        dk = dz @ self.v2.T * (k > 0)
        dm = dk @ self.v1.T * (m > 0)
        demb = np.zeros_like(self.emb)
        for shift, weight in ((0, self.wa), (STRIDE, self.wb)):
            back = (dm[:, :, None] * weight.T[None]).reshape(len(x), FILTERS, STRIDE, EMBED)
            pos = at[:, :, None] * STRIDE + shift + np.arange(STRIDE)
            byte = x[np.arange(len(x))[:, None, None], pos].ravel()
            flat = back.reshape(-1, EMBED)
            for e in range(EMBED):
                demb[:, e] += np.bincount(byte, flat[:, e], 256).astype(np.float32)
        return {
            "emb": demb,
            "wa": np.einsum("cf,cfk->kf", dm, ga, optimize=True),
            "wb": np.einsum("cf,cfk->kf", dm, gb, optimize=True),
            "bias": dm.sum(axis=0),
            "v1": h.T @ dk,
            "c1": dk.sum(axis=0),
            "v2": k.T @ dz,
            "c2": dz.sum(axis=0),
        }


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Params | None = None) -> ByteConvNet:
    """Fit on a bounded sample of labelled rows outside the held-out fold: the first ``per_class`` of each label in
    hash order. Weights restore the label shares of all learnable rows. Labels that are null or not 0/1 are ignored;
    without rows of both labels the net is left as initialised and its ``learned`` is False."""
    p = params or Params()
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    net = ByteConvNet(p.seed)
    net.learned = False
    if len(shares) < 2:
        return net
    rows = []
    for label in (0, 1):
        # twice the bound: some of these rows have too long a text or none in docs
        ids = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * p.per_class)
        got = (
            docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .where(F.length("text") <= p.longest)
            .join(F.broadcast(ids), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
            .limit(p.per_class)
        )
        rows += [(r["text"], label) for r in got.select("text").collect()]
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return net
    net.learned = True
    have = {k: float((y == k).sum()) for k in (0, 1)}
    w = np.array([shares[int(k)] / have[int(k)] for k in y], dtype=np.float64)
    return net.fit([r[0] for r in rows], y, w / w.mean(), p)


def score_udf(net: ByteConvNet):
    @F.pandas_udf(T.DoubleType())
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(net.score(texts.tolist()))

    return udf


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, params: Params | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, held_out, score, predicted)``, one row per input row; null and empty
    texts are scored too, very long ones whole. Only the text is an input of a score, so repeated rows score alike and
    other columns do not matter; an empty table gives no rows. Without labels of both kinds scores are those of an untaught
    net."""
    net = fit_quality(spark, docs, labels, params)
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score_udf(net)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
