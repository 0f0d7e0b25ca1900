"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: every word shingle's XXH64 votes on 64 bits. Texts within a radius of differing bits are linked, and links are
closed to components.

Candidates come from an exact cover: the 64 bits are cut into ``blocks`` parts; two fingerprints within radius r differ in at
most r parts, so they agree on some choice of ``blocks - r`` parts. Every distinct fingerprint is dealt once for each choice,
by the value of the chosen bits. Within a dealt group fingerprints are held vertically, 64 to a word, a word for each bit
plane; a query's bits flip the planes, carry-save adders keep 64 distances at once in a few bit planes, and a word is
abandoned as soon as all its lanes exceed the radius. Of a group's links only a spanning forest leaves the task.

Exact copies meet before anything is compared (one row for each distinct fingerprint). Groups above GROUP_ROWS are cut
into chunks, and each pair of chunks becomes a group of its own, so no task holds an unbounded group and no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import common
from geomosaic.operators.graph import connected_components

BITS = 64
#: A dealt group beyond this many rows is compared in chunks.
GROUP_ROWS = 4096
#: Rows of one fingerprint that a task joins at once, and fingerprints (at most) that count as hot.
HOT_ROWS, HOT_PRINTS = 50_000, 1000
#: Work items (a query against a word of 64 lanes) that are compared at once.
ITEMS = 1 << 14


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words joined by blanks (fewer words: the whole sequence; none: no hash), A-Z
    lower-cased, words split at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    k = min(words, len(w))
    end = np.cumsum([len(x) + 1 for x in w])
    begin = (end - np.array([len(x) + 1 for x in w])).tolist()
    stop = (end - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(begin, stop[k - 1 :])], np.uint64)


def majority(groups: list[np.ndarray]) -> np.ndarray:
    """A bit for each plane that is set in over half of a group's hashes; 0 for an empty group."""
    out = np.zeros(len(groups), np.uint64)
    full = [i for i, g in enumerate(groups) if len(g)]
    if full:
        size = np.array([len(groups[i]) for i in full])
        h = np.concatenate([groups[i] for i in full]).astype("<u8")
        ones = common.bit_sums(h.view(np.uint8).reshape(-1, 8), np.cumsum(size) - size)
        out[full] = np.ascontiguousarray(np.packbits(2 * ones > size[:, None], axis=1)).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint). Null texts count as empty, whose fingerprint is 0. No shuffle."""

    def run(batches):
        for b in common.chunks(batches, 2 << 20):
            fp = majority([shingle_hashes(t, words, seed) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return common.mapped(common.texts(docs), run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """fps: (n, k) of k words each. (64 k, words): bit p of 64 consecutive fingerprints in one word of plane p; lane i of a word
    is its bit i."""
    n, k = -(-len(fps) // 64), fps.shape[1]
    padded = np.zeros((n * 64, k), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, 64, 8 * k), axis=2, bitorder="little")  # word, lane, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(BITS * k, n)


class _Counters:
    """64 distances to a word, in bit planes; ``over`` marks lanes beyond the radius."""

    def __init__(self, n: int, radius: int):
        self.radius = radius
        self.c = [np.zeros(n, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(n, np.uint64)

    def add(self, carries: list[np.ndarray], level: int = 0) -> None:
        """Carry-save: two carries and a plane make a sum and one carry of the next level."""
        while carries:
            if level == len(self.c):
                for x in carries:
                    self.over |= x
                return
            up, c = [], self.c[level]
            for i in range(0, len(carries) - 1, 2):
                a, b = carries[i], carries[i + 1]
                t = c ^ a
                up.append((c & a) | (t & b))
                c = t ^ b
            if len(carries) % 2:
                up.append(c & carries[-1])
                c = c ^ carries[-1]
            self.c[level], carries, level = c, up, level + 1

    def beyond(self) -> np.ndarray:
        """Lanes whose count exceeds the radius: compare the bit planes with its digits from the top."""
        more, same = self.over.copy(), ~self.over
        for i in range(len(self.c) - 1, -1, -1):
            if self.radius >> i & 1:
                same &= self.c[i]
            else:
                more |= same & self.c[i]
                same &= ~self.c[i]
        return more

    def keep(self, who: np.ndarray) -> None:
        self.c = [x[who] for x in self.c]
        self.over = self.over[who]


def links(fps: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, within ``radius``, where row i is compared with the rows of its group after it, [i + 1, last[i]).

    fps: (n,) or (n, k) words. Yields index arrays for slices of work items.
    """
    fps = fps.reshape(len(fps), -1)
    vertical = planes(fps)
    i = np.arange(len(fps))
    lo, hi = (i + 1) // 64, (last - 1) // 64  # words that hold the partners of row i
    count = np.where(last > i + 1, hi - lo + 1, 0)
    ends = np.cumsum(count)
    flip = lambda q, p: np.uint64(0) - ((fps[q, p // BITS] >> np.uint64(p % BITS)) & np.uint64(1))  # noqa: E731  all ones where the query's bit is set
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, ITEMS), side="right")
    for a, b in zip(cuts, [*cuts[1:], len(fps)]):
        b = max(a, b)
        q = np.repeat(i[a:b], count[a:b])
        if not len(q):
            continue
        nth = np.arange(len(q)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        word = lo[q] + nth
        lane0 = np.maximum(q + 1 - 64 * word, 0)
        lane1 = np.minimum(last[q] - 64 * word, 64)
        full = ~np.uint64(0)
        mask = (full << lane0.astype(np.uint64)) & (full >> (64 - lane1).astype(np.uint64))
        counters = _Counters(len(q), radius)
        for p in range(0, len(vertical), 8):
            counters.add([vertical[x, word] ^ flip(q, x) for x in range(p, p + 8)])
            left = mask & ~counters.beyond()
            who = np.flatnonzero(left)
            if len(who) < len(q):  # abandon words without a lane in reach
                q, word, mask = q[who], word[who], left[who]
                counters.keep(who)
                if not len(q):
                    break
            else:
                mask = left
        if len(q):
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, lane = np.nonzero(bits)
            yield q[item], 64 * word[item] + lane


def _forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n rows is linked with, over all pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (jump := label[label]).tolist() != label.tolist() if n < 64 else not np.array_equal(jump := label[label], label):
                label = jump
    return label


def cover(n: int, radius: int, least: int = 2) -> list[list[int]]:
    """Choices of bits (masks as lists of positions) such that any two fingerprints within the radius agree on one of them:
    ``radius + agree`` parts, any ``agree`` of them. More parts as the number of fingerprints grows, so groups stay small."""
    agree = least
    while (BITS * agree) // (radius + agree) < np.log2(max(n, 2)) - 6 and agree < 6:
        agree += 1
    parts = [list(map(int, x)) for x in np.array_split(np.arange(BITS), radius + agree)]
    return [sum((parts[i] for i in choice), []) for choice in combinations(range(radius + agree), agree)]


def _mask(positions: list[int]) -> int:
    m = sum(1 << p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def spanning_links(spark: SparkSession, fps: DataFrame, radius: int) -> DataFrame:
    """src, dst: links between distinct fingerprints (column ``fp``, a bigint) whose closure is that of all links within the
    radius."""
    n = fps.count()
    masks = [_mask(p) for p in cover(n, radius)]
    dealt = fps.select(F.col("fp").alias("node"), "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "bits"))
    return _compared(spark, dealt, radius, narrow=True)


def _compared(spark: SparkSession, dealt: DataFrame, radius: int, narrow: bool) -> DataFrame:
    """Compare the rows (choice, bits, node, fp) that share choice and bits; src, dst as nodes."""
    heavy = dealt.groupBy("choice", "bits").count().where(F.col("count") > GROUP_ROWS)
    heavy = session.written(spark, heavy.select("choice", "bits", F.ceil(2 * F.col("count") / GROUP_ROWS).cast("int").alias("cuts")), "heavy")
    dealt = dealt.join(heavy, ["choice", "bits"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("cuts").cast("long")).cast("int")
    pairs = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.least(own, x) * F.col("cuts") + F.greatest(own, x)))
    dealt = dealt.select("choice", "bits", F.explode(pairs).alias("pair"), "node", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            size = np.diff(np.append(edge, len(fp)))
            some = np.repeat(size > 1, size)  # rows alone in their group have no partner
            size, fp = size[size > 1], fp[some]
            stop = np.cumsum(size)
            root = _forest(len(fp), links(fp, np.repeat(stop, size), radius)) if len(fp) else np.zeros(0, np.int64)
            tied = root != np.arange(len(fp))
            name = node[some]
            return pa.RecordBatch.from_arrays([pa.array(name[tied], pa.int64()), pa.array(name[root[tied]], pa.int64())], ["src", "dst"])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if narrow:
                fp = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
            else:
                fp = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u8").reshape(b.num_rows, -1)
            held.append((key, b.column(3).to_numpy(zero_copy_only=False).astype(np.int64), fp))
            rows += b.num_rows
            if rows >= 1 << 15:
                key, node, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0  # the last group may go on
                if cut:
                    yield done(key[:cut], node[:cut], fp[:cut])
                held, rows = [(key[cut:], node[cut:], fp[cut:])], len(key) - cut
        if rows:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "choice", "bits", "pair").sortWithinPartitions("choice", "bits", "pair")
    return common.mapped(grouped, run, "src long, dst long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most ``radius`` bits.

    One row for each input row. Null texts count as empty; texts without words have fingerprint 0 and are linked like any
    other. Rows with a null doc_id link as others do; a component of such rows alone has a null component_id. Empty tables
    give empty results.
    """
    own = session.written(spark, fingerprints(docs, words, seed), "fingerprints")
    distinct = session.written(spark, own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    groups = connected_components(spark, spanning_links(spark, distinct.select("fp"), radius))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = session.written(spark, named, "roots")
    least = session.written(spark, named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = session.written(spark, named.join(least, "root").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _spread(spark, own, distinct, found).select("doc_id", hexed.alias("fingerprint"), "component_id")


def _spread(spark: SparkSession, own: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``own`` joined with ``found`` by fp, a hot fingerprint's rows (the empty text's, a popular copy's) dealt over several tasks.

    Those with more than a thousandth of all rows, and HOT_ROWS at least, are hot, so there are HOT_PRINTS at most to broadcast.
    """
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    bound = max(HOT_ROWS, -(-total // HOT_PRINTS))
    cuts = distinct.where(F.col("n") > bound).select("fp", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("cuts"))
    many = F.coalesce("cuts", F.lit(1))
    rows = own.join(F.broadcast(cuts), "fp", "left").withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", (F.rand(7) * 1e9).cast("long"))), many).cast("int")).drop("cuts")
    each = found.join(F.broadcast(cuts), "fp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("cuts")
    return rows.join(each, ["fp", "salt"])


# Near copies of a given Jaccard similarity of the shingle sets, decided exactly. The wide fingerprints only find most links
# early, so that large groups need no comparison of all their pairs.

#: Words of 64 bits in a wide fingerprint, and of those how many are compared for early links.
WIDE, NARROW = 8, 4
#: Sets of fewer elements pass the fingerprints' filter unseen, others within so many standard deviations.
SMALL, SIGMAS = 64, 7.0
#: Of how many sets one is looked at for common shingles, and how many of these must hold one.
SHARE, COMMON = 12, 4
#: Pairs that are enumerated at once.
PAIRS = 1 << 20
#: Members from which on a group of linked sets counts as dense, and elements of its sets that a task holds at once.
DENSE, BLOCK_ELEMENTS = 64, 1 << 18


def wide_radius(similarity: float, bits: int = BITS * WIDE, sigmas: float = 1.0) -> int:
    """Differing bits to allow for a Jaccard similarity: texts of equal size have cosine 2 s / (1 + s), each bit differs with
    the angle's share of a half turn; ``sigmas`` standard deviations are added."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)


def block_digits(n: int) -> int:
    """Hexadecimal digits of a block: more as the number of fingerprints grows, so that few agree on one by chance."""
    return min(8, max(4, -(-int(np.log2(max(n, 2)) + 2) // 4)))


def packed48(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash; the order stays."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked48(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def distinct_shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """For each text the distinct hashes, ascending, of its runs of ``words`` words (fewer words: the whole sequence; none: no
    hash), A-Z lower-cased, words split at ASCII white space. All texts at once: a word's hash is a sum over its bytes, a run's a
    sum over its words."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"".join([b" " + r for r in raw] + [b" "]), np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    begin, end = (np.flatnonzero(x) for x in (solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]))
    begin, end = begin + 1, end + 1
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    power = np.full(int((end - begin).max()), 0xD6E8FEB86659FD93, np.uint64)
    power[0] = 1
    size = end - begin
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = (data[solid].astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[at]
    h = common.mix(np.add.reduceat(value, np.cumsum(size) - size))
    edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(begin, edge)  # each text's first word
    count = np.diff(first)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    runs = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    i = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + first[owner]
    s = np.zeros(len(i), np.uint64)
    for j in range(words):
        factor = np.uint64((2 * j + 1) * int(common.GOLD) % (1 << 64))
        s += np.where(j < count[owner], common.mix(padded[i + j] + factor) * factor, np.uint64(0))
    s = common.mix(s)
    by = np.lexsort((s, owner))
    s, owner = s[by], owner[by]
    s &= ~np.uint64(0xFFFF)  # 48 bits travel
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    return np.split(s[new], np.searchsorted(owner[new], np.arange(1, len(texts))))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (the text's hash), node (a hash of the set), n (its size), fp (binary, WIDE words: each distinct shingle's hash is stretched to
    WIDE words, each bit is a majority vote), hashes (binary: the distinct shingles' hashes of 48 bits, ascending)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("fp", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, 1 << 20):
            groups = distinct_shingles(b.column(1).to_pylist(), words)
            cols = [majority([common.mix(g + np.uint64((i + 1) * int(common.GOLD) % (1 << 64))) for g in groups]) for i in range(WIDE)]
            wide = np.stack(cols, axis=1).astype("<u8")
            raw = [packed48(g) for g in groups]
            node = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            cells = [b.column(0), b.column(2), node, [len(g) for g in groups], [w.tobytes() for w in wide], raw]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    return common.mapped(common.texts(docs).withColumn("th", F.xxhash64("text")), run, "doc_id long, th long, node long, n int, fp binary, hashes binary")


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """Sets of a Jaccard similarity share one of so many first elements (in any common order) at least."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def least_overlap(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Elements that sets of n and m elements have in common at least."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def alike(spark: SparkSession, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The src, dst of ``pairs`` whose sets have the similarity, by their elements."""
    ends = session.written(spark, pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "end-nodes")
    passes = sieve(ends, ends.count())
    some = session.written(spark, sets.select("node", "hashes").where(passes("node")).join(ends, "node", "left_semi").dropDuplicates(["node"]), "ends")
    one, two = (some.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in ("src", "dst"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (unpacked48(v.as_buffer()) for v in (x, y))
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                    yes.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                yes.append(shared >= least_overlap(len(x), len(y), similarity))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(yes, pa.bool_()))

    joined = pairs.select("src", "dst").join(one, "src").join(two, "dst").select("src", "dst", "of_src", "of_dst")
    return common.mapped(joined, run, "src long, dst long")


def in_reach(spark: SparkSession, pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The src, dst of ``pairs`` whose wide fingerprints (node, n, fp) lie within SIGMAS standard deviations of what the similarity
    makes likely, so that few sets have to travel. A pair of the similarity is farther apart with a chance of about 1e-9, as
    rare as a collision among its elements' hashes; sets below SMALL elements always pass."""
    radius = wide_radius(similarity, sigmas=SIGMAS)
    one, two = (prints.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fp").alias(f"fp_{x}")) for x in ("src", "dst"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u8").reshape(-1, WIDE) for i in (3, 4))
            far = np.bitwise_count(x ^ y).sum(axis=1) > radius
            far &= b.column(2).to_numpy(zero_copy_only=False) >= SMALL
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(~far))

    joined = pairs.select("src", "dst").join(one, "src").join(two, "dst").select("src", "dst", F.least("n_src", "n_dst"), "fp_src", "fp_dst")
    return common.mapped(joined, run, "src long, dst long")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits on which the longs of the one column fall, packed into bytes."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _bit(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                own |= np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    marked = common.mapped(common.mapped(hashes, mark, "bits binary").repartition(1), join, "bits binary")  # one bitmap a task
    out = np.zeros(bits // 8, np.uint8)
    for r in marked.collect():
        out |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    return out


def sieve(keys: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test for the longs of ``keys`` (one column, ``count`` rows): true for each of them and for few others, so that rows that
    can't match need not be shuffled for the join that decides. 16 to 32 bits a key, 16 MB at most; beyond 2^27 / 16 keys more
    others pass, and the join has more to do."""
    bits = 1 << min(27, max(16, (16 * count).bit_length()))
    marks = _bitmap(keys, bits)

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        at = _bit(key.to_numpy(np.int64).view(np.uint64), bits)
        return pd.Series((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return passes


def _common(sets: DataFrame, total: int) -> np.ndarray:
    """A bitmap of hashed shingles that many documents hold: those that COMMON sets of every SHARE-th have. It only changes the
    order of elements, never the result, so its size may be bounded: elements that fall on a set bit by chance come later."""
    bits = 1 << min(27, max(20, int(total // 64).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, 2 << 20, "hashes"):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked48(b"".join(b.column(0).to_pylist())).view(np.int64))], ["hash"])

    some = sets.where(F.pmod("node", F.lit(SHARE)) == 0).dropDuplicates(["node"]).select("hashes")
    found = common.mapped(some, run, "hash long").groupBy("hash").count().where(F.col("count") >= COMMON).select("hash")
    return _bitmap(found, bits)


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (common.mix(hashes + common.GOLD) % np.uint64(bits)).astype(np.int64)


def _few(tok: np.ndarray) -> np.ndarray:
    """Elements of the lowest quarter of hashes: most of a prefix, as that holds a set's lowest ones."""
    return tok >> np.uint64(62) == 0


def _pairs(tok: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, similarity: float, single: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """src, dst, whether these are dense groups (1: src, 2: dst), how many elements ``tok`` they must have in common (among
    prefixes) and have, for nodes of different roots whose sizes allow the similarity. A negative size marks an element of a dense
    group, named by its root: its members' elements count as one set's, and what is asked for is the least of any member.
    ``single``: under each element (of ``_few``) one node of each root (another for each element), paired with
    the next root's in an order that changes from element to element; so no more pairs than elements."""
    if single:
        by = np.lexsort((common.mix(node.view(np.uint64) ^ tok), common.mix(root.view(np.uint64) ^ common.mix(tok)), tok))
        tok, node, root, n = tok[by], node[by], root[by], n[by]
        first = np.concatenate([[True], (tok[1:] != tok[:-1]) | (root[1:] != root[:-1])]) if len(tok) else np.zeros(0, bool)
        tok, node, n = tok[first], node[first], n[first]
        i = np.flatnonzero(tok[1:] == tok[:-1])
        i = i[np.minimum(n[i], n[i + 1]) >= similarity * np.maximum(n[i], n[i + 1]) - 1e-9]
        none = np.zeros(len(i), np.int64)
        yield np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1]), none, none, none + 1
        return
    by = np.lexsort((n, node, root, tok))
    tok, node, root, n = tok[by], node[by], root[by], n[by]
    # exact copies came several times, as did members of equal size
    fresh = np.concatenate([[True], (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])])
    tok, node, root, n = tok[fresh], node[fresh], root[fresh], n[fresh]
    dense, n = (n < 0).astype(np.int64), np.abs(n)
    last = np.searchsorted(tok, tok, side="right")
    run = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (root[1:] != root[:-1])]))
    after = np.repeat(np.append(run[1:], len(tok)), np.diff(np.append(run, len(tok))))  # rows of its own root are linked already
    count = last - after
    ends = np.cumsum(count)
    rest = n - prefix_size(n, similarity)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), PAIRS), side="left"), len(tok)))
    for a, b in zip(cuts, cuts[1:]):
        i = np.repeat(np.arange(a, b), count[a:b])
        j = after[i] + np.arange(len(i)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        fit = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        by = np.lexsort((tok[i], node[j], node[i]))
        i, j = i[by], j[by]
        new = np.concatenate([[True], (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])])
        edge, another = np.flatnonzero(new), new.copy()
        another[1:] |= tok[i][1:] != tok[i][:-1]
        need = least_overlap(n[i], n[j], similarity) - np.maximum(rest[i], rest[j])
        yield node[i][edge], node[j][edge], (dense[i] + 2 * dense[j])[edge], np.minimum.reduceat(need, edge), np.add.reduceat(another.astype(np.int64), edge)


def candidates(spark: SparkSession, sets: DataFrame, similarity: float, often: np.ndarray, total: int, single: bool = False) -> DataFrame:
    """src, dst, kind: every pair of nodes with different ``root`` that can have the similarity (and others that share enough).
    Nodes whose root is ``dense`` are named by it: one row stands for all pairs with its members, so that a large group makes
    as many rows as it has neighbours, not as many as pairs (kind 1: src is such a group, 2: dst is, 3: both are).
    ``single``: only some pairs of one node of each root, whatever they share; links among these join groups, so that fewer
    pairs are left for the whole enumeration.

    Prefix filter: in one order of all shingles (common ones last, else by hash), sets of the similarity share an element of
    their prefixes. Prefix elements are dealt to slices by their hash, packed into arrays. An element shared beyond the shorter
    prefix stands among the rest of that set, so overlap <= shared prefix elements + the larger rest: pairs below fall out.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(4 * parts, int(total * (1 - similarity)) >> 18)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, 8 << 20, "hashes"):
            n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            h = unpacked48(b"".join(b.column(3).to_pylist()))
            dense = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            own = np.repeat(np.arange(len(n)), n)
            bit = _bit(h, 8 * len(often))
            late = (often[bit >> 3] >> (bit & 7)) & 1
            by = np.lexsort((h, late, own))  # own ascends already
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = by[place < np.repeat(prefix_size(n, similarity), n)]
            tok, own = h[first], own[first]
            if single:
                few = _few(tok)
                tok, own = tok[few], own[few]
            to = (common.mix(tok) % np.uint64(slices)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            tok, own, to = tok[by], own[by], to[by]
            node, root = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            node, size = np.where(dense, root, node), np.where(dense, -n, n).astype(np.int32)
            alone = (node == root)[own]
            for some in (alone, ~alone):  # a root that is the node itself stays at home
                if not some.any():
                    continue
                at, who = to[some], own[some]
                begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist()
                cut = list(zip(begin, [*begin[1:], len(at)]))
                cols = [[x[p:q].tobytes() for p, q in cut] for x in (tok[some], node[who], size[who])]
                roots = [b""] * len(cut) if some is alone else [root[who[p:q]].tobytes() for p, q in cut]
                yield pa.RecordBatch.from_arrays([pa.array(at[begin], pa.int64()), *[pa.array(x, pa.binary()) for x in (*cols[:2], roots, cols[2])]], ["slice", "tok", "node", "root", "n"])

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            tok, node, root, n = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held), ("<u8", "<i8", "<i8", "<i4")))
            _, where, often = np.unique(tok, return_inverse=True, return_counts=True)
            some = often[where] > 1
            if some.any():
                for found in _pairs(tok[some], node[some], root[some], n[some].astype(np.int64), similarity, single):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["src", "dst", "kind", "need", "shared"])

        current, held = None, []
        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and key != current:
                    yield from done(held)
                    held = []
                current = key
                row[2] = row[2] or row[1]
                held.append(row)
        if held:
            yield from done(held)

    dealt = common.mapped(sets.select("node", "n", "root", "hashes", "dense"), deal, "slice long, tok binary, node binary, root binary, n binary")
    found = common.mapped(dealt.repartition(parts, "slice").sortWithinPartitions("slice"), match, "src long, dst long, kind long, need long, shared long")
    if single:
        return found.select("src", "dst", "kind").distinct()
    found = found.groupBy("src", "dst").agg(F.max("kind").alias("kind"), F.min("need").alias("need"), F.sum("shared").alias("shared"))
    return found.where("shared >= need").select("src", "dst", "kind")


def attached(spark: SparkSession, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """src, dst: links of at least the similarity between nodes and dense groups (or two of these) that ``pairs`` (src, dst, kind)
    name; one for each node and block of the group's members if there is any, since these are linked with each other.

    A group's sets are dealt to blocks of about BLOCK_ELEMENTS elements; each node visits all of them, so sets travel once a block
    and no row stands for a pair. Overlaps with all members are counted from the block's sorted elements.
    """
    once = sets.dropDuplicates(["node"])
    members = session.written(spark, once.where("dense").select("root", "node", "n", "hashes"), "members")
    cuts = session.written(spark, members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("cuts")), "cuts")
    single = pairs.where("kind < 3").select(F.when(F.col("kind") == 1, F.col("dst")).otherwise(F.col("src")).alias("node"), F.when(F.col("kind") == 1, F.col("src")).otherwise(F.col("dst")).alias("root"))
    both = pairs.where("kind = 3").join(members.select(F.col("root").alias("src"), "node"), "src").select("node", F.col("dst").alias("root"))
    visits = session.written(spark, single.unionByName(both), "visits")
    ends = session.written(spark, visits.select("node").distinct(), "end-nodes")
    passes = sieve(ends, ends.count())
    some = once.select("node", "hashes").where(passes("node"))
    cut = F.pmod(F.xxhash64("node"), F.col("cuts").cast("long")).cast("int")
    at_home = members.join(cuts, "root").select("root", cut.alias("cut"), F.lit(False).alias("late"), "node", "hashes")
    guests = visits.join(cuts, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "node").join(some, "node").select("root", "cut", F.lit(True).alias("late"), "node", "hashes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for b in batches:
            found = []
            for root, cut, late, node, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (root, cut) != key:
                    key, held, block = (root, cut), [], None
                own = unpacked48(raw)
                if not late:
                    held.append((node, own))
                    continue
                if block is None:
                    size = np.array([len(x) for _, x in held], np.int64)
                    tok = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in held]])
                    by = np.argsort(tok, kind="stable")
                    block = tok[by], np.repeat(np.arange(len(held)), size)[by], size
                tok, owner, size = block
                begin, end = np.searchsorted(tok, own, side="left"), np.searchsorted(tok, own, side="right")
                many = end - begin
                at = np.repeat(end - np.cumsum(many), many) + np.arange(int(many.sum()))
                shared = np.bincount(owner[at], minlength=len(held))
                alike = np.flatnonzero(shared >= least_overlap(np.int64(len(own)), size, similarity))
                if len(alike):
                    found.append((node, held[alike[0]][0]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["src", "dst"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return common.mapped(at_home.unionByName(guests).repartition(parts, "root", "cut").sortWithinPartitions("root", "cut", "late"), run, "src long, dst long")


def copies(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """doc_id, th (the text's hash, which tells rows of one id or without an id apart), keep (the doc_id and th of the row that
    stays of its group of near copies: the smallest, null ids last) for every row; and the doc_id, th that stand in several rows.

    Groups are the components of all links of at least the similarity. Texts without words are copies of each other. Wide
    fingerprints that agree on any block of bits give links early, then pairs of one member of each group do; every link is
    decided by the sets' elements, and the prefix filter brings every pair that is not connected yet. Pairs with a member of a
    dense group aren't enumerated: the other set is compared with all members at once (``attached``).
    """
    sets = session.written(spark, shingle_sets(docs, words), "sets")
    full = sets.where("n > 0")
    distinct = session.written(spark, full.select("node", "n", "fp").dropDuplicates(["node"]), "distinct")
    per = block_digits(distinct.count())
    blocks = F.transform(F.sequence(F.lit(0), F.lit(16 * WIDE // per - 1)), lambda i: F.conv(F.substring(F.hex("fp"), i * per + 1, F.lit(per)), 16, 10).cast("long"))
    dealt = distinct.select("node", "fp", F.posexplode(blocks).alias("choice", "bits")).withColumn("fp", F.substring("fp", 1, 8 * NARROW))
    near = session.written(spark, _compared(spark, dealt, wide_radius(similarity, BITS * NARROW), narrow=False), "near")
    links = session.written(spark, alike(spark, near, full, similarity), "early")
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    often, done = _common(full, total), [near]
    for single in (True, False):
        roots = session.written(spark, connected_components(spark, links), "roots")
        large = roots.groupBy("component").agg((F.count("*") >= DENSE).alias("dense"))
        named = roots.withColumn("dense", F.lit(False)) if single else roots.join(large, "component")
        rooted = full.join(named, "node", "left").select("node", "n", F.coalesce("component", "node").alias("root"), "hashes", F.coalesce("dense", F.lit(False)).alias("dense"))
        others = session.written(spark, candidates(spark, rooted, similarity, often, total, single), "candidates")
        within = session.written(spark, in_reach(spark, others.where("kind = 0"), distinct, similarity), "in-reach")
        more = links.union(alike(spark, within, full, similarity))
        if others.where("kind > 0").limit(1).count():
            more = more.union(attached(spark, others.where("kind > 0"), rooted, similarity))
        more = session.written(spark, more, "links")
        done += [roots, others, within, links]
        links = more
    groups = connected_components(spark, links)
    own = sets.select("doc_id", "th", "node").join(groups, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("root"))
    own = session.written(spark, own, "own")
    session.discard(spark, sets, distinct, links, *done)
    named = own.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("keep"))
    named = named.select("root", F.struct("keep.doc_id", "keep.th").alias("keep"))
    return own.join(named, "root").select("doc_id", "th", "keep"), own.groupBy("doc_id", "th").count().where(F.col("count") > 1).select("doc_id", "th")


def deduplicated(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies: that of the smallest doc_id (null ids come last; of
    one id's texts, the one of the smallest hash). Rows of one id with different texts are different documents. All columns
    stay as they are."""
    found, repeats = copies(spark, docs, words, similarity)
    gone = found.where(~(F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.th") == F.col("th"))))
    named = [F.coalesce("doc_id", F.lit(0)).alias("_did"), F.isnull("doc_id").alias("_none"), F.col("th").alias("_th")]
    gone = session.written(spark, gone.select(*named).distinct(), "gone")
    repeats = session.written(spark, repeats.select(*named), "repeats")

    def same(rows: DataFrame, keys: DataFrame) -> Column:
        did, th = rows["doc_id"].cast("long"), F.xxhash64(F.coalesce(rows["text"], F.lit("")))
        return (F.coalesce(did, F.lit(0)) == keys["_did"]) & (did.isNull() == keys["_none"]) & (th == keys["_th"])

    # only rows that may go are shuffled
    did, th = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    may_go = sieve(gone.select(F.xxhash64("_did", "_none", "_th").alias("key")), gone.count())(F.xxhash64(F.coalesce(did, F.lit(0)), did.isNull(), th))
    rest = docs.where(may_go)
    kept = docs.where(~may_go).union(rest.join(gone, same(rest, gone), "left_anti"))
    if not repeats.limit(1).count():
        return kept
    again = kept.join(repeats, same(kept, repeats), "left_semi").withColumn("_text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return kept.join(repeats, same(kept, repeats), "left_anti").unionByName(again)
