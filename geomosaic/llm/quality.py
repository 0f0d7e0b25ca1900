"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

1. One pass over the texts makes a short vector of statistics for each document (shares of character classes, word and line
   shapes, repetition). It is written out; everything else reads these vectors.
2. cos(W x + b) with Gaussian W approximates a Gaussian kernel over the standardised statistics.
3. Every partition sums its outer products Z'Z and Z'y, one sum for each of FOLDS folds; the sums are added up in two levels
   and solved on the driver, where only FOLDS matrices of DIMENSION squared arrive, whatever the input's size.
4. Each fold is scored by the solution of the other folds; counts of those scores in fixed bins give an isotonic curve
   (pool adjacent violators), which maps the final solution's scores to 0..1.

All labelled rows that may be learned from are used; there is no sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import common
from geomosaic.llm.toxicity import fold

DIMENSION, FOLDS, RIDGE, SEED = 192, 4, 2.0, 11
THRESHOLD = 0.7
BINS, LOW, HIGH = 400, -0.5, 1.5
STATISTICS = ("log_bytes", "upper", "lower", "digit", "blank", "line_feed", "sentence_mark", "exclaim", "bar", "odd_symbol", "other_symbol", "control", "high", "word_length", "distinct_words", "repeated_lines", "line_length", "marked_words", "log_words")


def _classes() -> np.ndarray:
    k = np.zeros((256, 13))
    for c in range(256):
        ch = chr(c)
        i = 12 if c >= 128 else 1 if "A" <= ch <= "Z" else 2 if "a" <= ch <= "z" else 3 if "0" <= ch <= "9" else 4 if ch == " " else 5 if ch == "\n" else 6 if ch in ".,;:'?" else 7 if ch == "!" else 8 if ch == "|" else 9 if ch in "#$%&*@^~=+<>{}[]\\" else 11 if c < 32 or c == 127 else 10
        k[c, i] = 1
    return k


_CLASS = _classes()


def statistics(text: str) -> np.ndarray:
    """The vector of STATISTICS; zeros for an empty text."""
    out = np.zeros(len(STATISTICS))
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    out[:13] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)
    out[0] = np.log1p(len(raw))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if words:
        out[13] = np.log1p(len(text) / len(words))
        out[14] = len(set(words)) / len(words) ** 0.9
        out[17] = sum([not w[-1].isalnum() for w in words]) / len(words)
        out[18] = np.log1p(len(words))
    if lines:
        out[15] = 1 - len(set(lines)) / len(lines)
        out[16] = np.log1p(len(text) / len(lines))
    return out


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of doubles): the statistics of every row's whole text. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return common.mapped(common.texts(docs), run, "doc_id long, x array<double>")


@dataclass
class Features:
    mean: np.ndarray
    scale: np.ndarray
    seed: int = SEED

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        d = len(self.mean)
        self.w = r.standard_normal((d, DIMENSION)) / np.sqrt(d) * 1.2
        self.b = r.uniform(0, 2 * np.pi, DIMENSION)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2.0) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)


@dataclass
class Model:
    features: Features
    beta: np.ndarray
    edges: np.ndarray  # raw scores
    heights: np.ndarray  # what they are calibrated to, ascending

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, self.edges, self.heights)


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame) -> np.ndarray:
    """Add up the partitions' sums (column ``s``, doubles as bytes, of one length) in two levels."""

    def add(batches):
        total = None
        for b in batches:
            for s in b.column(0).to_pylist():
                v = np.frombuffer(s)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    got = [np.frombuffer(r[0]) for r in common.mapped(rows.repartition(4), add, "s binary").collect()]
    return sum(got) if got else np.zeros(0)


def pool_adjacent(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The isotonic (ascending) fit of positive / total with weights total."""
    blocks: list[list[float]] = []
    for n, p in zip(total.tolist(), positive.tolist()):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, p / n) for n, p, k in blocks]) if blocks else np.zeros(0)


def train(spark: SparkSession, stats: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Fit on all labelled rows for which ``learn`` (a condition on doc_id) holds. Null labels and ids are left out; a document
    labelled twice counts by its larger label. Without labels every score is 0.5; with one label alone its smoothed share."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(learn)
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = session.written(spark, stats.join(marked, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "quality-rows")
    d = len(STATISTICS)

    def moments(batches):
        s = np.zeros(2 * d + 2)
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
                s += np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    m = _summed(common.mapped(rows, moments, "s binary"))
    n, pos = (float(m[-2]), float(m[-1])) if len(m) else (0.0, 0.0)
    if not 0 < pos < n:
        share = (pos + 0.5) / (n + 1)
        f = Features(np.zeros(d), np.ones(d))
        return Model(f, np.zeros(DIMENSION + 1), np.array([0.0, 1.0]), np.array([share, share]))
    mean = m[:d] / n
    features = Features(mean, np.sqrt(np.maximum(m[d : 2 * d] / n - mean**2, 0)) + 1e-3)
    k = DIMENSION + 1

    def equations(batches):
        s = np.zeros((FOLDS, k, k + 1))
        for b in batches:
            if b.num_rows:
                z, y, f = features(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                for i in range(FOLDS):
                    own = z[f == i]
                    s[i, :, :k] += own.T @ own
                    s[i, :, k] += own.T @ y[f == i]
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    sums = _summed(common.mapped(rows, equations, "s binary")).reshape(FOLDS, k, k + 1)
    damp = np.diag([*[RIDGE] * DIMENSION, 1e-6])
    solve = lambda s: np.linalg.solve(s[:, :k] + damp, s[:, k])
    whole = sums.sum(0)
    betas = [solve(whole - sums[i]) for i in range(FOLDS)]

    def binned(batches):
        s = np.zeros((2, BINS))
        for b in batches:
            if b.num_rows:
                z, y, f = features(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                raw = (z * np.stack(betas)[f]).sum(1)
                at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
                s += np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    total, positive = _summed(common.mapped(rows, binned, "s binary")).reshape(2, BINS)
    held = total > 0
    centre = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    return Model(features, solve(whole), centre[held], pool_adjacent(total[held], positive[held]))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of ``vectors``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], ["doc_id", "score"])

    return common.mapped(stats, run, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, as they are, repeated ones and null ids included. No shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            x = np.stack([statistics(t or "") for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(model.score(x) >= least, pa.bool_()))

    return common.mapped(docs, run, docs.schema)


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from the rows of folds 0, 1 and 3 of 4 only, judges every row. Null texts
    count as empty, whose statistics are zeros; very long texts are read whole; repeated rows and null ids are judged each; an
    empty table gives no rows. Other columns are left out."""
    stats = session.written(spark, vectors(docs), "statistics")
    model = train(spark, stats, labels, fold(4) != 2)
    return scored(stats, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
