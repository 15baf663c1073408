"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

Score: w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), through a logistic function.

The model is fitted on the driver on a bounded sample: at most ``PER_CLASS`` labelled rows of each class, the first
by a hash of doc_id. Scoring is a map over rows without a shuffle; whole texts, batch by batch.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import with_package

BUCKETS, RANK, PER_CLASS, EPOCHS, SEED = 4096, 8, 2000, 30, 7
THRESHOLD = 0.3
UPPER, DIGIT, MARK, STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*!|@^~<>{}[]=+_\\", b".,;:?"
STATS = 14


def statistics(text: str, counts: Counter, n: int) -> list[float]:
    """Structure and metadata: sizes, shares of kinds of characters, repetition of words and lines."""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    without = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    lines = text.split("\n")
    words = max(1, n)
    marked = sum(c for w, c in counts.items() if w[-1] in "#$%&*!|")
    return [
        min(1.0, np.log1p(n) / 20),
        min(1.0, np.log1p(len(lines)) / 20),
        min(2.0, len(text) / words / 10),
        without(UPPER) * 4,
        without(DIGIT) * 4,
        without(MARK) * 4,
        without(STOP) * 4,
        raw.count(b"|") / size * 10,
        marked / words,
        1 - len(counts) / words,
        max(counts.values(), default=0) / words,
        1 - len(set(lines)) / len(lines),
        raw.count(b"\n") / size * 10,
        sum(c for w, c in counts.items() if len(w) <= 3) / words,
    ]


class Features:
    """Turns texts into sparse rows; words' buckets are remembered up to a bound."""

    def __init__(self, remembered: int = 300_000):
        self.bucket, self.remembered = {}, remembered

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.lower().split()
        counts = Counter(words)
        if len(self.bucket) > self.remembered:
            self.bucket.clear()
        index = []
        for w in counts:
            at = self.bucket.get(w)
            if at is None:
                at = self.bucket[w] = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
            index.append(at)
        value = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
        value /= max(1e-6, float(np.sqrt((value**2).sum())))
        stats = np.array(statistics(text, counts, len(words)), np.float32)
        return np.concatenate([np.array(index, np.int32), np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32)]), np.concatenate([value, stats])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *[len(r[0]) for r in rows[:-1]]])
        part = self.factors[index] * value[:, None]
        total = np.add.reduceat(part, starts)
        squares = np.add.reduceat(part**2, starts)
        z = self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (total**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """Adam on the logistic loss, classes weighted equally; without two classes, a constant score."""
    n, d = len(rows), BUCKETS + STATS
    machine = Machine(0.0, np.zeros(d, np.float32), np.zeros((d, RANK), np.float32))
    if n == 0 or len(set(y.tolist())) < 2:
        machine.bias = 3.0 if n == 0 or y[0] == 1 else -3.0
        return machine
    x = np.zeros((n, d), np.float32)
    for i, (index, value) in enumerate(rows):
        np.add.at(x[i], index, value)
    rng = np.random.default_rng(SEED)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))).astype(np.float32)
    parameters = [np.zeros(1, np.float32), machine.linear, rng.normal(0, 0.02, (d, RANK)).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    decay, step = (0.0, 2e-4, 1e-3), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            b = order[at : at + 128]
            xb, bias, linear, v = x[b], *parameters
            sums, x2 = xb @ v, xb**2
            z = bias[0] + xb @ linear + 0.5 * (sums**2 - x2 @ v**2).sum(1)
            delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b] / len(b)
            slopes = [delta.sum(keepdims=True), xb.T @ delta, xb.T @ (delta[:, None] * sums) - v * (x2.T @ delta)[:, None]]
            step += 1
            for p, g, (m1, m2), l2 in zip(parameters, slopes, moments, decay):
                g = g + l2 * p
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g**2 - m2)
                p -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return Machine(float(parameters[0][0]), parameters[1], parameters[2])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Machine:
    """Fit on at most ``per_class`` labelled documents of each class. Labels but 0 and 1 are left out; of several labels of a
    document the smallest counts, of several texts the first in order; documents without a text count as empty."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).cast("int").alias("__y"))
    draw = [known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    sample = docs.join(F.broadcast(draw[0].unionByName(draw[1])), F.col(doc_id) == F.col("__id")).groupBy("__id").agg(F.min("__y").alias("y"), F.min(text).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in parts:
            rows = [features(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("y"), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["id", "y", "i", "v"])

    kind = dict(sample.dtypes)["__id"]
    got = sorted(with_package(sample).mapInArrow(batches, f"id {kind}, y int, i binary, v binary").collect(), key=lambda r: r.id)
    return fit([(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32)) for r in got], np.array([r.y for r in got], np.float32))


def _scored(docs: DataFrame, machine: Machine, text: str, columns: list[str], only: float | None) -> DataFrame:
    read = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in parts:
            texts, scores = part.column("__text"), []
            for at in range(0, len(texts), 256):
                scores.append(model.value.scores([features(t.as_py()) for t in texts[at : at + 256]]))
            score = np.concatenate(scores) if scores else np.zeros(0)
            out = pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.array(score, pa.float64())], [*columns, "__score"])
            yield out if only is None else out.filter(pa.array(score >= only))

    return with_package(read).mapInArrow(batches, read.drop("__text").schema.add("__score", "double"))


def score_quality(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with score (0 to 1) and predicted (1 if the score is at least 0.3). Null texts count as empty."""
    kept = [c for c in keep if c not in ("score", "predicted")]
    return _scored(docs, machine, text, kept, None).select(*kept, F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores 0.3 or more."""
    return _scored(docs, machine, text, docs.columns, THRESHOLD).drop("__score")
