"""Toxicity: a counterfactual-regularised logistic classifier over the presence of words and word beginnings.

Insults are inflected, so beside whole words a text's features are the beginnings of its words (STEMS letters), and whether
two or three different words share one. Features are chosen from a bounded sample of labelled rows: those whose share among
toxic documents differs most clearly from their share among the others (a two-proportion z value), with copies of one document
counting as one (documents with the same minimum shingle hash share a weight of 1). Identity terms are always features.

The counterfactual term: in every labelled text that mentions an identity term, the term is swapped for each other one of its
group, all features are made anew, and the squared change of the score's logit is added to the loss. So the label may not
depend on which group is named, and neutral mentions of a group that is often attacked don't raise the score.

A corpus may hardly name any group. So every other labelled text gets a frame, a mention of one term that a hash of the text
chooses, whatever its label; the mention is swapped as any other. Terms are then seen with both labels, and a term that chance
put into more toxic texts than its neighbours is held to them by the penalty.

The labelled sample is at most MAX_LABELLED rows (smallest hash of doc_id), a documented bound; scoring covers every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import common

#: Labelled rows that a model is fitted on, features that it has, and the least z value of a feature.
MAX_LABELLED, MAX_FEATURES, LEAST_Z = 20_000, 400, 4.0
THRESHOLD = 0.7
STEMS, SEVERAL = (4, 5, 6), (2, 3)
#: Entries of a model's word cache; beyond it the cache starts anew.
CACHE_ENTRIES = 300_000
#: Terms that may be swapped for each other. A parameter; these are the defaults.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("disabled", "blind", "deaf"),
    ("christ", "moslem", "jude", "buddhistin", "atheistin"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("chrétien", "musulman", "juif", "hindou", "athée"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("cristiano", "musulmán", "judío", "hindú", "ateo"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """The words; "abcd*" for a beginning; "abcd*2" if two different words share it, and so on."""
    count = Counter([f"{w[:n]}*" for w in words for n in STEMS if len(w) > n])
    return {*words, *count, *(f"{p}{n}" for p, c in count.items() if c > 1 for n in SEVERAL if c >= n)}


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.stems = {w.partition("*")[0] + "*" for w in self.weights if "*" in w}
        self.cache: dict[str, tuple[str, ...]] = {}

    def _hits(self, word: str) -> tuple[str, ...]:
        """What of the model's features (counts apart) a word brings."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        own = (word,) if word in self.weights else ()
        self.cache[word] = found = own + tuple(p for n in STEMS if len(word) > n and (p := f"{word[:n]}*") in self.stems)
        return found

    def logit(self, words: set[str]) -> float:
        cache = self.cache
        count = Counter([f for w in words for f in (cache[w] if w in cache else self._hits(w))])
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) + sum([get(f"{f}{n}", 0.0) for n in SEVERAL if c >= n]) for f, c in count.items()])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -30, 30))))


def swaps(present: set[str], groups: Iterable[tuple[str, ...]]) -> list[tuple[str, str]]:
    """(term, other) for each identity term present and each other term of its group that is not."""
    return [(a, b) for g in groups for a in g if a in present for b in g if b not in present]


def frame(pick: int, groups: Iterable[tuple[str, ...]]) -> str | None:
    """The term that is put into a text of hash ``pick``: every other text gets one."""
    groups = [g for g in groups if g]
    if pick % 2 or not groups:
        return None
    g = groups[pick // 2 % len(groups)]
    return g[pick // 2 // len(groups) % len(g)]


def fit(rows: list[tuple[list[int], int, float]], names: list[str], groups=IDENTITY_GROUPS, ridge: float = 0.5, counterfactual: float = 1.0, rounds: int = 40, near: list[list[str]] | None = None, frames: list[str | None] | None = None) -> Model:
    """Newton steps on the weighted log loss, a ridge and the counterfactual penalty.

    rows: (features present, label, weight). near: each row's words that share the first letters of an identity term, and the
    terms themselves (by default the words among its features). frames: a term for each row that is put into it, or None.
    Without both labels the model is constant.
    """
    n, k = len(rows), len(names)
    y, w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    if not n or y.min() == y.max():
        share = (float((y * w).sum()) + 0.5) / (float(w.sum()) + 1) if n else 0.5
        return Model(float(np.log(share / (1 - share))))
    x = np.zeros((n, k + 1))
    x[:, k] = 1
    at = {t: i for i, t in enumerate(names)}
    penalty = np.full(k + 1, ridge)
    penalty[k] = 1e-6
    h0 = np.diag(penalty)
    changes: Counter = Counter()  # (words beside the term, term, other): weight
    for i, (present, _, weight) in enumerate(rows):
        x[i, present] = 1
        held = {names[j] for j in present if "*" not in names[j]} if near is None else set(near[i])
        if frames and frames[i]:
            put = held | {frames[i]}
            x[i, [at[f] for f in features_of(put) - features_of(held) if f in at]] = 1
            held = put
        pairs = swaps(held, groups)
        for a, b in pairs:
            changes[frozenset(held), a, b] += weight / len(pairs)
    for (held, a, b), weight in changes.items():
        before, swapped = features_of(set(held)), features_of(held - {a} | {b})
        plus, minus = ([at[f] for f in sorted(z) if f in at] for z in (swapped - before, before - swapped))
        d, sign = plus + minus, np.repeat([1.0, -1.0], [len(plus), len(minus)])
        h0[np.ix_(d, d)] += counterfactual * weight * np.outer(sign, sign)
    beta = np.zeros(k + 1)

    def loss(b):
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * b @ h0 @ b)

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + h0 @ beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + h0, grad)
        t = 1.0
        while (new := loss(beta - t * step)) > now and t > 1e-4:
            t /= 2
        beta = beta - t * step
        if now - new < 1e-8 * max(1.0, now):
            break
        now = new
    return Model(float(beta[k]), {t: float(b) for t, b in zip(names, beta)})


def identity_gap(model: Model, texts: Iterable[str], groups=IDENTITY_GROUPS) -> float:
    """Mean change of the score when a mention that is put into a text is swapped for another term of its group."""
    found = []
    for text in texts:
        words = words_of(text)
        for g in groups:
            own = [1 / (1 + np.exp(-np.clip(model.logit(words | {t}), -30, 30))) for t in g]
            found += [abs(p - q) for i, p in enumerate(own) for q in own[:i]]
    return float(np.mean(found)) if found else 0.0


def _shingle_min(text: str) -> int:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    joined = [b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    return min(map(xxhash.xxh64_intdigest, joined)) - (1 << 63)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, groups=IDENTITY_GROUPS, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, counterfactual: float = 1.0) -> Model:
    """Fit on at most ``max_labelled`` labelled rows for which ``learn`` (a condition on doc_id) holds. Null labels and ids are
    left out; a document labelled twice counts by its larger label."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = common.texts(docs).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of 12 bytes

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, 1 << 20):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("toxic")), pa.array([_shingle_min(t) for t in texts], pa.int64()), pa.array([sorted(features_of(words_of(t))) for t in texts], pa.list_(pa.string()))],
                ["doc_id", "toxic", "copy", "features"],
            )

    rows = session.written(spark, common.mapped(sample, words, "doc_id long, toxic int, copy long, features array<string>"), "toxic-sample")
    share = rows.groupBy("copy").agg((1 / F.count("*")).alias("w"))  # at most max_labelled rows
    rows = rows.join(F.broadcast(share), "copy")
    total = rows.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("toxic")).alias("t")).head()
    n, t = float(total["n"] or 0), float(total["t"] or 0)
    if not n or not 0 < t < n:
        return fit([(([], int(t > 0), 1.0))] * int(n), [], groups)
    each = rows.select("toxic", "w", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum(F.col("w") * F.col("toxic")).alias("a"), F.sum("w").alias("m"))
    p, q = F.col("a") / F.lit(t), (F.col("m") - F.col("a")) / F.lit(n - t)
    mid = (F.col("m") + 1) / F.lit(n + 2)
    z = (p - q) / F.sqrt(mid * (1 - mid) * F.lit(1 / t + 1 / (n - t)))
    names = [r["feature"] for r in each.where("m >= 2.5").withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(max_features).collect()]
    names += list(dict.fromkeys(w for g in groups for w in g if w not in names))
    table = F.array(*[F.lit(w) for w in names])
    terms = sorted({w for g in groups for w in g})
    begin, least = [F.array(*[F.lit(w) for w in x]).cast("array<string>") for x in (sorted({w[: STEMS[0]] for w in terms}), terms)]
    beside = F.filter("features", lambda f: ~F.contains(f, F.lit("*")) & (F.array_contains(begin, F.substring(f, 1, STEMS[0])) | F.array_contains(least, f)))
    present = rows.select("toxic", "w", "copy", F.array_intersect("features", table).alias("found"), beside.alias("near")).collect()  # at most max_labelled rows
    at = {w: i for i, w in enumerate(names)}
    frames = [frame(r["copy"] % (1 << 62), groups) for r in present]
    return fit([([at[w] for w in r["found"]], r["toxic"], r["w"]) for r in present], names, groups, counterfactual=counterfactual, near=[r["near"] for r in present], frames=frames)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row. Null texts count as empty: their score is the model's base rate. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return common.mapped(common.texts(docs), run, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, below: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score less than ``below``, as they are, repeated ones and null ids included. No shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            yield b.filter(pa.array([model.score(t or "") < below for t in b.column(at).to_pylist()], pa.bool_()))

    return common.mapped(docs, run, docs.schema)


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from the rows of fold 0 and 2 of 3 only, judges every row.

    Null and empty texts get the model's base rate; very long texts are read whole; repeated rows and null ids are judged each;
    an empty table gives no rows; without labels every score is 0.5. Other columns are left out."""
    model = train(spark, docs, labels, fold(3) != 1)
    return scored(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
