"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A document is the multiset of its paragraphs (text between line feeds). Each paragraph hashes to a wide vector and the
vectors add up lane by lane modulo powers of two, so the order of paragraphs doesn't matter and a paragraph is inserted or
deleted by adding or subtracting its vector.

Lanes: 8 of 64 bits (BLAKE2b of the paragraph, sums modulo 2^64) decide equality; 128 of 32 bits (sums modulo 2^32) decide
likeness. A paragraph's likeness lanes add +1 or -1 for each of its five-word shingles (a shorter paragraph is one shingle),
signs taken from the shingle's hash; so they are sums over paragraphs as well. For two documents with shingle counts a and b the
mean square of the lanes' differences estimates the squared distance sum (a - b)^2, and likeness is one minus that over
sum a^2 + b^2, held to 0..1. Without repeated shingles that distance is the size of the symmetric difference; a shingle that
stands k times in one text alone counts k^2. Equal fingerprints have likeness 1.

An empty or null text is one empty paragraph. Words are runs of non-space characters.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic.llm import common

SHINGLE, LANES, SIGNS = 5, 8, 128
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORDS: dict[str, int] = {"": 0}
#: Entries of a worker's word cache; beyond it the cache starts anew.
WORD_ENTRIES = 500_000


def _word(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _lookup(words: list[str]) -> np.ndarray:
    try:
        return np.array([_WORDS[w] for w in words], np.uint64)
    except KeyError:
        pass
    if len(_WORDS) > WORD_ENTRIES:
        _WORDS.clear()
        _WORDS[""] = 0
    for w in set(words).difference(_WORDS):
        _WORDS[w] = _word(w)
    return np.array([_WORDS[w] for w in words], np.uint64)


def paragraph_vectors(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 8) uint64 and (n, 128) uint32 lanes of single paragraphs."""
    n = len(paragraphs)
    signs = np.zeros((n, SIGNS), np.uint32)
    lanes = np.frombuffer(b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * LANES).digest() for p in paragraphs]), np.uint64).reshape(n, LANES)
    words, span, owner = [], [], []
    for i, p in enumerate(paragraphs):
        if w := p.split():
            if len(w) < SHINGLE:
                w += [""] * (SHINGLE - len(w))
            words += w
            span.append(len(w))
            owner.append(i)
    if not words:
        return lanes, signs
    hashes = _lookup(words)
    block = np.repeat(np.array(owner), span)
    m = len(hashes) - SHINGLE + 1
    s = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        s += common.mix(hashes[j : m + j] + _FACTORS[j]) * _FACTORS[j]
    whole = block[:m] == block[SHINGLE - 1 :]
    s, who = s[whole], block[:m][whole]
    for a in range(0, len(s), 1 << 18):  # bounds the spread bits
        part, own = s[a : a + (1 << 18)], who[a : a + (1 << 18)]
        wide = np.stack([common.mix(part), common.mix(part + common.GOLD)], axis=1).view(np.uint8)
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(begin, len(own)))
        signs[own[begin]] += (2 * common.bit_sums(wide, begin) - count[:, None]).astype(np.uint32)
    return lanes, signs


def _prefix_sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the lanes before each paragraph (modulo, as everything), and each text's first paragraph."""
    split = [t.split("\n") for t in texts]
    lanes, signs = paragraph_vectors([p for ps in split for p in ps])
    first = np.concatenate([[0], np.cumsum([len(ps) for ps in split], dtype=np.int64)])
    zero = np.zeros((1, LANES), np.uint64), np.zeros((1, SIGNS), np.uint32)
    return np.concatenate([zero[0], np.cumsum(lanes, axis=0, dtype=np.uint64)]), np.concatenate([zero[1], np.cumsum(signs, axis=0, dtype=np.uint32)]), first


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 8) uint64 and (n, 128) uint32 lanes of the texts."""
    lanes, signs, first = _prefix_sums(texts)
    return lanes[first[1:]] - lanes[first[:-1]], signs[first[1:]] - signs[first[:-1]]


def edited_vectors(chain: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The texts' fingerprints, and for each but the last that of its edited text (see ``edited``), made from the paragraphs'
    own: the kept ones, those inserted whole from the next text, and the one or two that the cuts made anew."""
    n = len(chain) - 1
    lanes, signs, first = _prefix_sums(chain)
    kept, upto, fresh, owner = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    for i in range(n):
        own, k = chain[i], len(chain[i]) // 2
        stay, come = own[: len(own) - k], chain[i + 1][:k]
        kept[i], upto[i] = stay.count("\n"), come.count("\n")
        head = stay[stay.rfind("\n") + 1 :]
        if upto[i]:
            fresh += [head + come[: come.find("\n")], come[come.rfind("\n") + 1 :]]
            owner += [i, i]
        else:
            fresh.append(head + come)
            owner.append(i)
    whole = tuple(x[first[1:]] - x[first[:-1]] for x in (lanes, signs))
    made = paragraph_vectors(fresh)
    begin = np.searchsorted(owner, np.arange(n))
    out = []
    for x, new in zip((lanes, signs), made):
        insert = np.where((upto > 0)[:, None], x[first[1:-1] + upto] - x[first[1:-1] + np.minimum(upto, 1)], x.dtype.type(0))
        out.append(x[first[:-2] + kept] - x[first[:-2]] + insert + np.add.reduceat(new, begin, axis=0, dtype=x.dtype))
    return whole, tuple(out)


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Insert (sign 1) or delete (sign -1) b's paragraphs: lane-wise sums modulo 2^64 and 2^32."""
    return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def hexed(lanes: np.ndarray, signs: np.ndarray) -> list[str]:
    return [(x.tobytes() + y.tobytes()).hex() for x, y in zip(lanes.astype("<u8"), signs.astype("<u4"))]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0..1 for each row; 1 where the fingerprints are equal."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    d = (a[1] - b[1]).view(np.int32).astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(1 - (d * d).sum(1) / np.where(both > 0, both, 1), 0, 1)
    equal = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(equal, 1.0, np.where(both > 0, out, 0.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex). One row for each row; no shuffle."""

    def run(batches):
        for b in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexed(*vectors(b.column(1).to_pylist())), pa.string())], ["doc_id", "fingerprint"])

    return common.mapped(common.texts(docs), run, "doc_id long, fingerprint string")


def _range_of(bounds: list[tuple[int, int]], k, h):
    """How many of the bounds, in descending order, are not below (k, h). Two short scans of literals: first over every step-th
    bound, then over the step behind it."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    table = lambda rows: F.array(*[F.struct(F.lit(x).cast("long").alias("k"), F.lit(y).cast("long").alias("h")) for x, y in rows])
    upto = lambda rows: F.size(F.filter(rows, lambda b: (b["k"] > k) | ((b["k"] == k) & (b["h"] >= h))))
    coarse = upto(table(bounds[step - 1 :: step]))
    return coarse * step + upto(F.slice(table(bounds), coarse * step + 1, F.lit(step)))


def _next_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of descending (doc_id, text hash) (``part``), in order within each, and after each range's rows a copy
    of the row that follows (``tail``). One shuffle of the texts; only a key for each range comes to the driver.

    Order: doc_id descending, null ids last, equal ids by the text's hash. An id that fills several ranges (rows without one)
    is parted by the hash; equal rows stand in any order.
    """
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = common.texts(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    found = (src.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * max(1000, n))).head()[0] or []) if n > 1 else []
    bounds, lowest, width = [], -(1 << 63), 1 << 64
    for k, times in Counter(found).items():  # an id's hashes are spread evenly: as many cuts as it has bounds
        bounds += [(k, lowest + width * i // times) for i in range(times)] if times > 1 else [(k, lowest)]
    src = src.withColumn("part", _range_of(sorted(bounds, reverse=True), F.col("k"), F.col("h")))
    key = F.struct("k", "h")
    heads = sorted((r["part"], tuple(r["top"])) for r in src.groupBy("part").agg(F.max(key).alias("top")).collect())
    # each range's first row also follows the range before; the first of all follows the last
    follows = {top: heads[i - 1][0] for i, (_, top) in enumerate(heads)}
    if not follows:
        return src.withColumn("tail", F.lit(False))
    one = lambda part, tail: F.struct(part.cast("int").alias("part"), F.lit(tail).alias("tail"))
    copy = F.create_map(*[x for (k, h), p in follows.items() for x in (F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")), F.lit(p))])
    after = F.element_at(copy, key)
    dealt = src.withColumn("at", F.explode(F.when(after.isNotNull(), F.array(one(F.col("part"), False), one(after, True))).otherwise(F.array(one(F.col("part"), False)))))
    dealt = dealt.select("doc_id", "text", "k", "h", "at.part", "at.tail")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "tail", F.col("k").desc(), F.col("h").desc())


def edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document beside its edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document in descending doc_id order; the last document is followed by the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each input row.
    Null texts count as empty; null ids come last; rows of one id stand by descending text hash, equal rows in any order; a
    single row follows itself; an empty table gives no rows. Other columns are left out.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush(ids, own, nxt):
        new = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, nxt)]
        chain, e = edited_vectors(own + nxt[-1:])  # row i's next is row i + 1
        f, g = tuple(x[:-1] for x in chain), tuple(x[1:] for x in chain)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()), pa.array(hexed(*f), pa.string()), pa.array(hexed(*e), pa.string()), pa.array(likeness(f, e), pa.float64()), pa.array(likeness(f, g), pa.float64())],
            names,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, own, size = None, [], [], 0  # rows of one range, the last of them without its next as yet
        for b in common.chunks(batches):
            for doc_id, text, part, tail in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part", "tail"))):
                if own and held == part and (tail or size > common.CHUNK_BYTES):
                    yield flush(ids, own, own[1:] + [text])
                    ids, own, size = [], [], 0
                held = part
                if not tail:
                    ids.append(doc_id)
                    own.append(text)
                    size += len(text)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return common.mapped(_next_of(spark, docs).select("doc_id", "text", "part", "tail"), run, kinds)
