"""Operator 2: language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of 128 bytes in both directions, gives every position a distribution over the languages, and a
document's probabilities are the means over all its positions. It is trained in numpy, by backpropagation through time, on
a bounded sample: of each language about ``SAMPLE_DOCS`` documents of the training folds, by a hash of id and text, and of
each at most ``SAMPLE_WINDOWS`` windows. Every position of every whole text is labelled.

Cases: null texts and texts without a letter are ``und`` with score 0, as are all where nothing is labelled; repeated rows
give repeated results; ties go to the language first in order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_arrow, table

WINDOW = 128
HIDDEN = 8
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 4
STEPS = 240
BATCH = 64
PAD = 256


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions, stacked: inputs (2, 257, 3H), recurrent (2, H, 3H), bias (2, 3H), labels (2H, K)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.w = {
            "x": r.normal(0, 0.3, (2, PAD + 1, 3 * hidden)).astype(np.float32),
            "u": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32),
            "b": np.zeros((2, 1, 3 * hidden), np.float32),
            "o": r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes)).astype(np.float32),
            "c": np.zeros(classes, np.float32),
        }

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (T, 2, B, H) of windows x (T, B), in reading order of each direction; what training needs."""
        t_max, n = x.shape
        h, k = np.zeros((2, n, self.h), np.float32), self.h
        table = self.w["x"] + self.w["b"]
        out, kept = np.empty((t_max, 2, n, k), np.float32), []
        gx = np.empty((2, n, 3 * k), np.float32)
        for t in range(t_max):
            np.take(table[0], x[t], axis=0, out=gx[0])
            np.take(table[1], x[t_max - 1 - t], axis=0, out=gx[1])
            gh = np.matmul(h, self.w["u"])
            zr = sigmoid(gx[..., : 2 * k] + gh[..., : 2 * k])
            z, r, un = zr[..., :k], zr[..., k:], gh[..., 2 * k :]
            new = np.tanh(gx[..., 2 * k :] + r * un)
            before = h
            h = new + z * (before - new)
            out[t] = h
            if keep:
                kept.append((before, z, r, un, new))
        return out, kept

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, K) at every position."""
        h, _ = self.states(x)
        k = self.h
        logits = h[:, 0] @ self.w["o"][:k] + h[::-1, 1] @ self.w["o"][k:] + self.w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions that aren't padding, by backpropagation through time."""
        h, kept = self.states(x, keep=True)
        k, (t_max, n) = self.h, x.shape
        both = np.concatenate([h[:, 0], h[::-1, 1]], axis=2)
        logits = both @ self.w["o"] + self.w["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(n), y] -= 1
        real = (x != PAD)[..., None]
        d = p * real / max(1, real.sum())
        g = {"o": np.tensordot(both, d, ([0, 1], [0, 1])), "c": d.sum(axis=(0, 1)), "x": np.zeros_like(self.w["x"]), "u": np.zeros_like(self.w["u"]), "b": np.zeros_like(self.w["b"])}
        dh_out = d @ self.w["o"].T
        dh_out = np.stack([dh_out[..., :k], dh_out[::-1, :, k:]], axis=1)
        dh = np.zeros((2, n, k), np.float32)
        ut = self.w["u"].transpose(0, 2, 1)
        for t in range(t_max - 1, -1, -1):
            before, z, r, un, new = kept[t]
            dh = dh + dh_out[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=2)
            dgh = np.concatenate([dz, dr, dn * r], axis=2)
            g["u"] += before.transpose(0, 2, 1) @ dgh
            np.add.at(g["x"][0], x[t], da[0])
            np.add.at(g["x"][1], x[t_max - 1 - t], da[1])
            g["b"] += da.sum(axis=1, keepdims=True)
            dh = dh * z + dgh @ ut
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 3) -> None:
        """Adam on random batches of windows x (n, T), as many of each language in the mean."""
        r = np.random.default_rng(seed)
        share = 1 / np.bincount(y, minlength=self.w["c"].size)[y]
        share /= share.sum()
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            at = r.choice(len(x), batch, p=share)
            grads = self.gradients(x[at].T, y[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, size) over whole texts, padded with PAD, and the text of each."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    out = np.full((int(counts.sum()), size), PAD, np.int16)
    at = 0
    for t, c in zip(texts, counts.tolist(), strict=True):
        out[at : at + c].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += c
    return out, np.repeat(np.arange(len(texts)), counts)


def predict(net: Network, texts: list[bytes], chunk: int = 1024) -> np.ndarray:
    """Mean probabilities (texts, K) over all positions."""
    x, owner = windows(texts)
    total = np.zeros((len(texts), net.w["c"].size))
    for a in range(0, len(x), chunk):
        part = x[a : a + chunk].T
        p = net.labels(part)
        if (part[-1] == PAD).any():
            p = p * (part != PAD)[..., None]
        np.add.at(total, owner[a : a + chunk], p.sum(axis=0))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def sample(docs: DataFrame, per_language: int, per_document: int) -> list[tuple[str, bytes]]:
    """Labelled windows of a bounded sample of ``docs``."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    rate = F.coalesce(*(F.when(F.col("lang") == k, per_language / n) for k, n in sorted(sizes.items())), F.lit(0.0))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000 * rate)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, parts = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if not has_letter(text):
                continue
            starts = np.random.default_rng(zlib.crc32(text)).integers(0, max(1, len(text) - WINDOW + 1), per_document)
            for a in sorted(set(starts.tolist())):
                langs.append(lang), parts.append(text[a : a + WINDOW])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    most = 4 * per_language * per_document * max(1, len(sizes))
    rows = map_arrow(chosen.select("lang", "text"), cut, "lang string, part binary").limit(most).collect()
    return sorted((r["lang"], bytes(r["part"])) for r in rows)


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS, per_document: int = SAMPLE_WINDOWS, steps: int = STEPS) -> tuple[Network | None, list[str]]:
    """A network from the labelled rows of ``docs`` (text, lang, doc_id), and its languages."""
    rows = sample(docs, per_language, per_document)
    langs = sorted({k for k, _ in rows})
    if not langs:
        return None, []
    net = Network(len(langs))
    x, _ = windows([p for _, p in rows])
    net.fit(x, np.array([langs.index(k) for k, _ in rows]), steps)
    return net, langs


def identify(df: DataFrame, net: Network | None, langs: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score for every whole text."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(text))
        letters = [has_letter(t) for t in texts]
        known = [i for i, ok in enumerate(letters) if ok and net is not None]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            p = predict(net, [texts[i] for i in known])
            for i, row in zip(known, p, strict=True):
                pred[i], score[i] = langs[int(row.argmax())], round(min(1.0, float(row.max())), 6)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keep), "lang_pred string", "score double"])
    return map_arrow(df.select(*dict.fromkeys([*keep, text])), run, schema, rows=256)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    net, langs = train(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs, net, langs, keep=("doc_id", "held_out"))
