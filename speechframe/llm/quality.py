"""Quality classification with naive Bayes support vectors.

A text's features are the byte 1- to 4-grams that occur in it, hashed to
2**BITS, and the n-grams of its word repetitions (a word equal to the one before
it; runs of such; their share).  An indicator is scaled by its log-count ratio between the classes, the
row is normalised, and a linear hinge-loss model is fitted by dual coordinate
descent; its margins become scores by a logistic fit on rows kept apart.

Fitting takes at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their id,
so the broadcast of their ids and the one task that fits are bounded whatever the corpus;
scoring reads every whole text and only the text.

Defined results: a null text is an empty one; an empty text has no feature and
gets the model's intercept; with rows of one class only (or none) every score is
that class (or 0.5); rows with a null label or id teach nothing; of rows that
repeat an id in ``labels`` the larger label counts; repeated documents count each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_arrow, map_rows, schema

SAMPLE_ROWS, BITS, C, EPOCHS, ALPHA = 8192, 18, 1.0, 12, 1.0
#: Odd multipliers of the n-gram hashes. Fixed values.
MULTIPLY = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Lengths of runs of repeated words, and shares of repeated words, that are features.
RUNS, SHARES = (1, 2, 3, 5, 8), (0.02, 0.1, 0.2, 0.4, 0.6, 0.8)
SIZE = (1 << BITS) + len(RUNS) + len(SHARES)


def features(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted indices of the n-grams in a text. flags: SIZE of False, left so."""
    raw = (text or "").encode()
    words = raw.split()
    same = bytes(map(eq, words, words[1:]))
    for k, n in enumerate(RUNS):
        flags[(1 << BITS) + k] = b"\1" * n in same
    for k, share in enumerate(SHARES):
        flags[(1 << BITS) + len(RUNS) + k] = same.count(1) > share * len(words)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        g = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            g |= b[k : len(b) - n + 1 + k] << np.uint32(8 * k)
        g *= np.uint32(MULTIPLY[n - 1])
        g ^= g >> np.uint32(15)
        flags[(g * np.uint32(MULTIPLY[-n])) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


class Model:
    """u: weight times ratio per feature; square: squared ratio; then intercept and the logistic fit."""

    def __init__(self, u: np.ndarray, square: np.ndarray, bias: float, a: float, b: float):
        self.u, self.square, self.bias, self.a, self.b = u, square, bias, a, b

    def margin(self, x: np.ndarray) -> float:
        return float(self.u[x].sum() / math.sqrt(self.square[x].sum() + 1e-12)) + self.bias

    def score(self, x: np.ndarray) -> float:
        z = self.a * self.margin(x) + self.b
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

    def pack(self) -> bytes:
        return np.concatenate([[self.bias, self.a, self.b], self.u, self.square]).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        v = np.frombuffer(data, "<f4").astype(np.float64)
        n = (len(v) - 3) // 2
        return cls(v[3 : 3 + n], v[3 + n :], *map(float, v[:3]))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratios of the features between label 1 and label 0."""
    count = [np.full(SIZE, ALPHA), np.full(SIZE, ALPHA)]
    for x, t in zip(rows, y):
        count[int(t > 0)][x] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised hinge loss; classes weigh alike."""
    scale = np.array([1 / math.sqrt((r[x] ** 2).sum() + 1e-12) for x in rows])
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum()))) * C
    norm = np.array([1.0 if len(x) else 0.0 for x in rows]) + 1.0  # the row's own, and the intercept's
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            v = r[rows[i]] * scale[i]
            gradient = y[i] * (w[rows[i]] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps with a small ridge."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    t = (t * (t.sum() + 1) + (1 - t)) / np.where(t > 0, t.sum() + 2, (1 - t).sum() + 2)  # smoothed targets
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-7:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], labels: list[int]) -> Model:
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    zero = np.zeros(SIZE)
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(zero, zero, 0.0, 0.0, 0.0 if not len(y) else 20.0 * y[0])
    apart = np.arange(len(y)) % 5 == 4
    if not ((y[apart] > 0).any() and (y[apart] < 0).any()):
        apart[:] = True
    inner = ~apart if not apart.all() else apart
    pick = lambda m: [x for x, k in zip(rows, m) if k]
    r = ratios(pick(inner), y[inner])
    w, bias = dual_descent(pick(inner), y[inner], r)
    model = Model(w * r, r * r, bias, 1.0, 0.0)
    model.a, model.b = logistic(np.array([model.margin(x) for x in pick(apart)]), y[apart])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label); only ids in both teach."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample_rows / total))
    # About sample_rows narrow rows: the bound of the broadcast, and of what the fitting task reads.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, bool)
        found = [(i, x, y) for b in batches for i, x, y in zip(b.column(0).to_pylist(), (features(t, flags).astype(np.int32) for t in b.column(1).to_pylist()), b.column(2).to_pylist())]
        found.sort(key=lambda t: (t[0], len(t[1]), t[2]))
        model = train([x for _, x, _ in found], [y for _, _, y in found])
        yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary())], schema=to_arrow_schema(schema("model binary")))

    made = map_arrow(rows.repartition(1), run, schema("model binary")).collect()
    return Model.unpack(made[0].model) if made else train([], [])


def score(df: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to every row of df (text)."""
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    kind = T.StructType([df.schema[c] for c in kept] + list(schema("score double,predicted int")))
    shared = df.sparkSession.sparkContext.broadcast(model.pack())  # two floats a hash bucket

    def make():
        own, flags = Model.unpack(shared.value), np.zeros(SIZE, bool)

        def f(batch: pa.RecordBatch) -> list:
            got = [own.score(features(x, flags)) for x in batch.column("text").to_pylist()]
            return [batch.column(c) for c in kept] + [got, [int(x >= threshold) for x in got]]

        return f

    return map_rows(df, kind, make)
