"""Quality classifier by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled web text are told apart by a small network under the non-negative unbiased
risk: prior * R+(P) + max(0, R-(U) - prior * R-(P)). The class prior is estimated by best-bin estimation: of a first
network that tells P from U, the smallest ratio of how much of U and of P scores above a threshold. Labels 0 are never
used. A score is the network's probability of label 1.

The fit uses SAMPLE rows of each kind at most (chosen by a hash of doc_id, only rows that are not held out); features
are counts over the whole text, and every text is scored.

Defined results: a null or empty text has the features of no words and is scored like any other; a row with a null
doc_id is scored, is not held out and is never learnt from; rows that repeat are scored each; without any positives, or
without any unlabelled text, there is nothing to learn from and every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of positives and of unlabelled text that a fit may use.
SAMPLE, THRESHOLD = 20_000, 0.7

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|", b"#$%&*~^@", b"'\"()-", b"<>[]{}=/\\_+`", bytes(range(128, 256))]
_CLASS = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g), _i] = 1
N_FEATURES = len(_GROUPS) + 10


def features(text: str | None) -> list[float]:
    """What a text looks like: shares of byte classes, and how its words and lines vary and repeat."""
    raw = (text or "").encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *np.sqrt(hist / len(raw)).tolist(),
        np.log1p(n) / 5,
        len(counts) / n,
        len(counts) / n**0.8,
        pairs / max(1, n - 1),
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / (n + 20),
        len(raw) / n / 10,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))) / 5,
        sum(w.isupper() for w in counts) / len(counts),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts]).reshape(-1, N_FEATURES)


class Net:
    """One hidden layer of tanh units and a logit, trained by Adam."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 16, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [r.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.p
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def gradient(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Of a loss whose derivative by the logits is d."""
        w, b, v, _ = self.p
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ w + b)
        back = d[:, None] * v * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]

    def train(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 1) -> Net:
        """prior None: tell positives from unlabelled; else the non-negative risk under that prior."""
        r = np.random.default_rng(seed)
        m, s, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        steps = max(1, max(len(pos), len(unl)) // batch)
        for epoch in range(max(epochs, 600 // steps)):
            for _ in range(steps):
                a, u = pos[r.integers(0, len(pos), batch)], unl[r.integers(0, len(unl), batch)]
                ga, gu = self.score(a), self.score(u)
                if prior is None:
                    grads = self.gradient(np.vstack([a, u]), np.concatenate([ga - 1, gu]) / batch)
                else:
                    as_negative = [np.mean(-np.log1p(-np.clip(g, 0, 1 - 1e-9))) for g in (gu, ga)]
                    gap = as_negative[0] - prior * as_negative[1]
                    low = self.gradient(np.vstack([u, a]), np.concatenate([gu, -prior * ga]) / batch)
                    if gap < 0:  # the negatives' risk fell below zero: step back up
                        grads = [-x for x in low]
                    else:
                        grads = [x + y for x, y in zip(self.gradient(a, prior * (ga - 1) / batch), low, strict=True)]
                t += 1
                lr = rate * (1 - 0.9 * epoch / max(epochs, 600 // steps))
                for i, g in enumerate(grads):
                    g = g + 1e-4 * self.p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        return self


def estimated_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives in unlabelled data, from scores of a network that tells them apart."""
    cuts = np.quantile(pos, np.linspace(0, 0.9, 91))
    p, u = (np.array([(x >= c).mean() for c in cuts]) for x in (pos, unl))
    slack = np.sqrt(np.log(4 / delta) / 2 / len(pos)) + np.sqrt(np.log(4 / delta) / 2 / len(unl))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


class QualityModel:
    def __init__(self, net: Net | None, prior: float) -> None:
        self.net, self.prior = net, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.net.score(x) if self.net else np.full(len(x), self.prior)


def fit(pos: np.ndarray, unl: np.ndarray) -> QualityModel:
    if not len(pos) or not len(unl):
        return QualityModel(None, 0.5)
    both = np.vstack([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 0.02
    half_p, half_u = len(pos) // 2, len(unl) // 2
    first = Net(mean, scale).train(pos[:half_p] if half_p else pos, unl[:half_u] if half_u else unl, None, epochs=20)
    prior = estimated_prior(first.score(pos[half_p:]), first.score(unl[half_u:]))
    return QualityModel(Net(mean, scale, seed=2).train(pos, unl, prior), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """A model from at most `sample` positives and `sample` unlabelled texts that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().where(~held_out(F.col("doc_id")))
    marked = {"p": rows.join(good, "doc_id", "left_semi"), "u": rows.join(good, "doc_id", "left_anti")}
    counts = {k: v.select("doc_id").count() for k, v in marked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(matrix(b.column(1)).tolist(), pa.list_(pa.float64()))], ["h", "x"])

    def taken(df: DataFrame, n: int, take: int) -> np.ndarray:
        h = F.xxhash64("doc_id").alias("h")
        some = df.where((F.shiftrightunsigned(F.xxhash64("doc_id"), 34)) <= int(2**30 * min(1.0, 1.02 * take / max(n, 1))))
        got = some.select(h, "text").mapInArrow(run, "h long, x array<double>").orderBy("h", F.hash("x")).limit(take)
        return np.array([r.x for r in got.collect()]).reshape(-1, N_FEATURES)

    pos = taken(marked["p"], counts["p"], sample)
    # Unlabelled text is a mixture of all texts: the unmarked ones, and as many of the positives as belong among them.
    share = counts["p"] / max(1, sum(counts.values()))
    unmarked = taken(marked["u"], counts["u"], round(sample * (1 - share)))
    extra = pos[: round(len(unmarked) * share / max(1e-9, 1 - share))] if share < 1 else pos
    unl = np.vstack([unmarked, extra])
    r = np.random.default_rng(5)
    return fit(pos[r.permutation(len(pos))], unl[r.permutation(len(unl))])


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the column `name`: the probability of label 1. All other columns stay."""
    at = docs.columns.index(text_col)
    keep = [c for c in docs.columns if c != name]
    known = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = known.value.score(matrix(b.column(at)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, name])

    schema = docs.select(*keep).schema.add(name, "double")
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
