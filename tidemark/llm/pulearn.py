"""Operator 11: a quality classifier learned from trusted positives and unlabelled text (non-negative PU learning).

No negative label is ever read. A two-layer network over statistics of a text's bytes and words is trained in numpy to minimise

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where R_p and R_u are mean logistic losses over positives and unlabelled texts; where the second term of a batch falls below
zero the step goes up its slope instead, so the network can't win by pushing memorised positives out of the unlabelled ones. A
score is that of the mean logit of ``NETWORKS`` networks, as rare kinds of text are few in every batch.

The class prior is estimated from classifiers of positives against unlabelled texts: on folds that they weren't fitted on, no set
of texts can hold a smaller share of the unlabelled than the prior times its share of the positives, so the least ratio of both
shares over upper sets of scores, with bounds for chance, is the estimate (best bin).

Training reads a bounded sample: about ``POSITIVES`` trusted positives and ``UNLABELLED`` texts, drawn by hashes; only their
features reach the driver. Labels and folds decide who is a positive, nothing else; unlabelled texts are drawn from all folds. Scoring is one pass
over whole texts without a shuffle.

Cases: null and empty texts have the features of an empty text and a score like any other; without a positive or without an
unlabelled text every score is 0.5; an id with conflicting labels is no positive; a null doc_id is neither held out nor
positive; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, map_arrow, quoted, table

POSITIVES = 4000
UNLABELLED = 8000
HIDDEN = 12
NETWORKS = 4
STEPS = 3000
BATCH = 256
THRESHOLD = 0.3
HASHED = 256

#: Classes of bytes, for shares of single ones and of pairs of neighbours.
GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".", b",", b"!?", b";:", b"'\"`", b"()[]{}", b"#*$%&", b"|", b"<>=/\\", b"@_~^+-"]
KINDS = len(GROUPS) + 1
KIND = np.full(256, KINDS - 1, np.uint16)
for k, group in enumerate(GROUPS):
    KIND[np.frombuffer(group, np.uint8)] = k
STATISTICS = 8
WIDTH = KINDS * KINDS + HASHED + STATISTICS


def statistics(text: bytes) -> list[float]:
    """How long, how long its words and lines, and how much of it says something again."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(words)) / 5, np.log1p(len(text) / n) / 2, np.log1p(len(words) / max(1, len(lines))) / 4, len(set(words)) / n, again / n, 1 - pairs / max(1, len(words) - 1),
        1 - len(set(lines)) / max(1, len(lines)), sum(w.isupper() for w in words) / n,
    ]


def features(text: bytes, part: int = 1 << 22) -> np.ndarray:
    """Roots of the shares of neighbouring byte classes and of hashed byte triples, and the statistics. Pairs and triples are
    counted in parts, so that the numbers beside a very long text stay few."""
    pairs, triples = np.zeros(KINDS * KINDS, np.int64), np.zeros(HASHED, np.int64)
    for a in range(0, len(text), part):
        b = np.frombuffer(text, np.uint8)[a : a + part + 2]
        kind = KIND[b[: part + 1]]
        pairs += np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
        if len(b) > 2:
            c = (b[:-2].astype(np.uint32) * 65536 + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)
            triples += np.bincount(c >> np.uint32(24), minlength=HASHED)
    return np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), np.sqrt(triples / max(1, triples.sum())), statistics(text)]).astype(np.float32)


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Scorer:
    """Standardised features, a layer of rectified units, one logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.w = [(r.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden))).astype(np.float32), np.zeros(hidden, np.float32), r.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3], h

    def gradient(self, z: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Of the sum of logits weighted by ``d``."""
        dh = d[:, None] * self.w[2] * (h > 0)
        return [z.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)]


def scores(nets: list[Scorer], x: np.ndarray) -> np.ndarray:
    """Of the mean logit; 0.5 without a network."""
    if not nets:
        return np.full(len(x), 0.5)
    return sigmoid(np.mean([n.logit(n.standard(x))[0].astype(np.float64) for n in nets], axis=0))


def risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of logits of positives and unlabelled texts, and the slopes to descend: those of the risk, or,
    where its second term is negative, of minus that term."""
    rest = softplus(f_u).mean() - prior * softplus(f_p).mean()
    up, down = sigmoid(f_u) / len(f_u), prior * sigmoid(f_p) / len(f_p)
    if rest < 0:
        return float(prior * softplus(-f_p).mean()), down, -up
    return float(prior * softplus(-f_p).mean() + rest), -prior * sigmoid(-f_p) / len(f_p) - down, up


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, rate: float = 2e-2, decay: float = 3e-4, seed: int = 0) -> Scorer:
    """Adam on the non-negative risk; without a prior, on positives against unlabelled texts as if those were negatives."""
    everything = np.concatenate([positive, unlabelled])
    net = Scorer(everything.mean(axis=0), everything.std(axis=0) + 1e-2, seed=seed)
    zp, zu, r = net.standard(positive), net.standard(unlabelled), np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for step in range(1, steps + 1):
        p, u = zp[r.integers(0, len(zp), BATCH)], zu[r.integers(0, len(zu), BATCH)]
        (f_p, h_p), (f_u, h_u) = net.logit(p), net.logit(u)
        if prior is None:
            d_p, d_u = -0.5 * sigmoid(-f_p) / len(f_p), 0.5 * sigmoid(f_u) / len(f_u)
        else:
            _, d_p, d_u = risk(f_p, f_u, prior)
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, (a, b) in enumerate(zip(net.gradient(p, h_p, d_p), net.gradient(u, h_u, d_u), strict=True)):
            g = a + b
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] -= (lr * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8) + decay * net.w[k])).astype(np.float32)
    return net


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, folds: int = 5, rate: float = 1e-2, decay: float = 1e-3) -> float:
    """The share of positives among the unlabelled: the best bin's ratio, each text scored by a network fitted without it."""
    folds = min(folds, len(positive), len(unlabelled))
    s_p, s_u = np.empty(len(positive)), np.empty(len(unlabelled))
    for k in range(folds):
        rest_p, rest_u = (np.arange(len(x)) % folds != k for x in (positive, unlabelled))
        net = fit(positive[rest_p], unlabelled[rest_u], None, steps, rate, decay)
        s_p[~rest_p], s_u[~rest_u] = scores([net], positive[~rest_p]), scores([net], unlabelled[~rest_u])
    s_p, s_u = np.sort(s_p), np.sort(s_u)
    cuts = np.quantile(s_p, np.linspace(0, 0.95, 96))
    q_p = np.maximum(1 - np.searchsorted(s_p, cuts) / len(s_p), 1e-9)
    q_u = 1 - np.searchsorted(s_u, cuts) / len(s_u)
    chance = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(s_p)) + 1 / np.sqrt(len(s_u)))
    at = int(np.argmin((q_u + chance) / q_p))
    return float(np.clip(q_u[at] / q_p[at], 0.01, 0.99))


def chosen(share: float, *columns: str) -> Column:
    """A share of rows, by a hash of ``columns``."""
    return F.pmod(F.xxhash64(F.lit("pu"), *columns), F.lit(1 << 30)) < int(share * (1 << 30))


def gathered(texts: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` texts, in an order of their own."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(as_bytes(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], ["x"])

    rows = sorted(bytes(r["x"]) for r in map_arrow(texts.select("text"), run, "x binary").limit(most).collect())
    x = np.frombuffer(b"".join(rows), np.float32).reshape(-1, WIDTH)
    return x[np.random.default_rng(1).permutation(len(x))]


def samples(docs: DataFrame, labels: DataFrame, held_out: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features of trusted positives of the training folds and of unlabelled texts of all, each a bounded sample. ``docs``: doc_id,
    text; ``labels``: doc_id, quality; ``held_out``: a condition on doc_id, under which no label is read."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    n_good, n_docs = good.count(), docs.count()
    ids = good.filter(chosen(positives / max(1, n_good), "doc_id")).select("doc_id").limit(2 * positives)
    trusted = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    web = docs.filter(chosen(unlabelled / max(1, n_docs), "doc_id", "text"))
    return gathered(trusted, 2 * positives), gathered(web, 2 * unlabelled)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, steps: int = STEPS, networks: int = NETWORKS) -> tuple[list[Scorer], float]:
    """The networks and the estimated prior; no network without both kinds of texts."""
    positive, unlabelled = samples(docs, labels, held_out)
    if len(positive) < 2 or len(unlabelled) < 2:
        return [], 0.5
    prior = estimated_prior(positive, unlabelled)
    return [fit(positive, unlabelled, prior, steps, seed=k) for k in range(networks)], prior


def scored(df: DataFrame, nets: list[Scorer], text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with score (0 to 1) and predicted of every whole text."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(len(keep)))
        s = np.round(scores(nets, matrix(texts)), 6)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join([*(f"{quoted(k)} {fields[k]}" for k in keep), "score double", "predicted int"])
    return map_arrow(df.select(*map(quoted, keep), F.col(quoted(text)).alias("__text")), run, schema, rows=256)


def op11_pulearn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out).select("doc_id", "text", "held_out")
    nets, _ = train(docs, table(spark, sf_dir, "labels"), held_out)
    return scored(docs, nets, keep=("doc_id", "held_out"))
