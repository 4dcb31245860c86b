"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into windows of ``WIDTH`` bytes, each starting ``STRIDE`` bytes after the one before, so that windows
overlap and cover the whole text. Every window gets the activation of ``FILTERS`` learned filters over learned byte
embeddings. Chunks of ``CHUNK`` windows are max-pooled; the mean and the maximum of a document's chunks are combined
into one logistic probability. Nothing but the bytes of the text goes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, lean

WIDTH, STRIDE, CHUNK, EMBED, FILTERS = 8, 4, 64, 6, 16
SPAN = CHUNK * STRIDE
PAD = 256


def chunks_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a text, one row of SPAN + WIDTH - STRIDE symbols each, and which of their windows start inside
    the text. An empty text has one chunk of padding with one window."""
    n = max(1, -(-len(text) // SPAN))
    x = np.full(n * SPAN + WIDTH - STRIDE, PAD, np.int16)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.as_strided(x, (n, SPAN + WIDTH - STRIDE), (x.strides[0] * SPAN, x.strides[0]))
    starts = np.arange(n * CHUNK).reshape(n, CHUNK) * STRIDE
    return rows, starts < max(1, len(text))


class ByteCNN:
    """The network's weights, its forward pass and its training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (PAD + 1, EMBED)),
            "kernel": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.fold()

    def fold(self) -> None:
        """Embedding and kernel folded into one table a window offset: a filter's response is a sum of lookups."""
        e = self.w["embed"].copy()
        e[PAD] = 0
        self.tables = np.einsum("be,kef->kbf", e, self.w["kernel"]).astype(np.float32)

    def pooled(self, rows: np.ndarray, live: np.ndarray, where: bool = False):
        """Max-pooled activations of chunks; with ``where`` also the windows that they come from."""
        out = np.empty((len(rows), FILTERS), np.float32)
        at = np.empty((len(rows), FILTERS), np.int64) if where else None
        bias = self.w["bias"].astype(np.float32)
        for a in range(0, len(rows), 1024):
            part = rows[a : a + 1024]
            act = np.zeros((len(part), CHUNK, FILTERS), np.float32)
            for j in range(WIDTH):
                act += self.tables[j].take(part[:, j : j + SPAN : STRIDE], axis=0)
            act[~live[a : a + 1024]] = -np.inf
            out[a : a + 1024] = act.max(1)
            if where:
                at[a : a + 1024] = act.argmax(1)
        out += bias
        return np.maximum(out, 0), at

    def features(self, pools: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.hstack([np.add.reduceat(pools, first, 0) / count[:, None], np.maximum.reduceat(pools, first, 0)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1. Long texts are pooled piece by piece, so memory stays bounded."""
        out, held, size = [], [], 0
        flush = lambda: self._scores(held)
        for t in texts:
            if len(t) > 1 << 20:
                out.append(flush()) if held else None
                held, size = [], 0
                out.append(self._long(t))
                continue
            held.append(t)
            size += len(t)
            if size > 1 << 20:
                out.append(flush())
                held, size = [], 0
        if held:
            out.append(flush())
        return np.concatenate(out) if out else np.zeros(0)

    def _long(self, t: bytes) -> np.ndarray:
        total, top, n = np.zeros(FILTERS), np.zeros(FILTERS), 0
        for a in range(0, len(t), SPAN * 2048):
            rows, live = chunks_of(t[a : a + SPAN * 2048 + WIDTH - STRIDE])
            keep = min(len(rows), 2048)
            pools, _ = self.pooled(rows[:keep], live[:keep])
            total, top, n = total + pools.sum(0), np.maximum(top, pools.max(0)), n + keep
        return self.logistic(np.concatenate([total / n, top])[None])

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [chunks_of(t) for t in texts]
        count = np.array([len(p[0]) for p in parts])
        pools, _ = self.pooled(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return self.logistic(self.features(pools, np.r_[0, np.cumsum(count)[:-1]], count))

    def logistic(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(f @ self.w["out"] + self.w["shift"], -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int, seed: int = 11) -> ByteCNN:
        """Adam on the logistic loss; gradients reach a filter only through the windows that won their chunk."""
        r = np.random.default_rng(seed)
        self.w["shift"][:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        parts = [chunks_of(t) for t in texts]
        m, v, step = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), 48):
                pick = order[a : a + 48]
                rows, live = np.concatenate([parts[i][0] for i in pick]), np.concatenate([parts[i][1] for i in pick])
                count = np.array([len(parts[i][0]) for i in pick])
                first = np.r_[0, np.cumsum(count)[:-1]]
                pools, at = self.pooled(rows, live, True)
                f = self.features(pools, first, count)
                err = (self.logistic(f) - labels[pick]) / len(pick)
                grad = {"out": f.T @ err + 1e-4 * self.w["out"], "shift": np.array([err.sum()])}
                doc = np.repeat(np.arange(len(pick)), count)
                g_mean, g_max = np.outer(err, self.w["out"][:FILTERS]), np.outer(err, self.w["out"][FILTERS:])
                g = g_mean[doc] / count[doc, None] + g_max[doc] * (pools >= f[doc, FILTERS:])
                g *= pools > 0
                grad["bias"] = g.sum(0)
                i = at[:, :, None] * STRIDE + np.arange(WIDTH)
                symbols = rows[np.arange(len(rows))[:, None, None], i].astype(np.int64)
                flat = (np.arange(WIDTH) * (PAD + 1) + symbols) * FILTERS + np.arange(FILTERS)[None, :, None]
                t = np.bincount(flat.ravel(), np.repeat(g.ravel(), WIDTH), WIDTH * (PAD + 1) * FILTERS)
                t = t.reshape(WIDTH, PAD + 1, FILTERS)
                grad["embed"] = np.einsum("kbf,kef->be", t, self.w["kernel"]) + 1e-5 * self.w["embed"]
                grad["kernel"] = np.einsum("kbf,be->kef", t, self.w["embed"]) + 1e-5 * self.w["kernel"]
                step += 1
                rate = 0.02 * (1 - 0.9 * step / (epochs * (1 + len(order) // 48)))
                for k, x in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.w[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                self.fold()
        return self

    def packed(self) -> bytes:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> ByteCNN:
        net, flat, a = cls(), np.frombuffer(data, "<f8"), 0
        for k in sorted(net.w):
            net.w[k] = flat[a : a + net.w[k].size].reshape(net.w[k].shape).copy()
            a += net.w[k].size
        net.fold()
        return net


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 3000, max_bytes: int = 10_000_000, epochs: int = 8) -> bytes:
    """Weights fitted on at most ``max_docs`` labelled whole documents of at most ``max_bytes`` bytes together (a
    document that would go beyond is left out), in one retried task. Which ones is decided by ids and sizes before any
    text is fetched; of rows that repeat an id, the text of the smallest hash counts. Null texts are empty ones. Without
    documents of both labels the untrained output layer is cleared, so that every score is the share of label 1 (1/2
    without labels)."""
    sample = labelled_sample(labels, label, max_docs)
    body = F.coalesce(F.col("text"), F.lit(""))
    thin = documents.select("doc_id", F.xxhash64(body).alias("hash"), F.octet_length(body).alias("size")).join(F.broadcast(sample), "doc_id")
    one = thin.groupBy("doc_id", "label").agg(F.min(F.struct("hash", "size")).alias("x")).select("doc_id", "label", "x.hash", "x.size")
    used, chosen = 0, []
    for r in sorted(one.collect(), key=lambda r: (hash_of(r.doc_id), r.doc_id)):  # max_docs rows at most
        if used + r["size"] <= max_bytes:
            used += r["size"]
            chosen.append((r.doc_id, r["hash"], r.label))
    shares = sum(label for *_, label in chosen)
    if not 0 < shares < len(chosen):
        net = ByteCNN()
        net.w["out"][:] = 0
        net.w["shift"][:] = np.log((shares + 1) / (len(chosen) - shares + 1))
        return net.packed()
    kind = documents.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(documents.sparkSession.createDataFrame(chosen, f"doc_id {kind}, hash long, label int"))
    rows = documents.select("doc_id", F.xxhash64(body).alias("hash"), body.cast("binary").alias("bytes")).join(wanted, ["doc_id", "hash"]).dropDuplicates(["doc_id"])

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[tuple[int, bytes, int]] = []
        for p in parts:
            texts += zip(p.doc_id, map(bytes, p.bytes), p.label)
        texts.sort(key=lambda x: (hash_of(x[0]), x[0]))
        net = ByteCNN().fit([x[1] for x in texts], np.array([x[2] for x in texts], float), epochs)
        yield pd.DataFrame({"weights": [net.packed()]})

    return bytes(lean(rows).repartition(1).mapInPandas(fit, "weights binary").collect()[0].weights)


def hash_of(doc_id: int) -> int:
    """The order in which documents are taken into the fit."""
    return (int(doc_id) * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64 >> 20


def score(documents: DataFrame, weights: bytes, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``, whole texts.

    Null texts count as empty ones, which get the score of one window of padding. Repeated rows and ids get a row each;
    a null doc_id stays null and isn't held out. Other columns are not read. An empty table gives no rows."""

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = ByteCNN.unpacked(weights)
        for p in parts:
            yield pd.DataFrame({"doc_id": p.doc_id, "held_out": p.held_out, "score": net.scores(list(p.bytes))})

    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    return lean(rows).mapInPandas(apply, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
