"""Suffix-array dedup: a run-length index over candidate contexts, streamed for matching statistics.

Every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus is marked. No task could index the
whole corpus, so windows are routed first, without losing a match:

1. A window's anchor is the least hash of its GRAM-byte strings. Equal windows have equal anchors, so all copies of a window
   meet under one anchor. Consecutive windows with one anchor form a run; a run's context is the bytes of its windows. Anchors
   that occur once in the corpus are dropped (counts, then a semi-join): their windows are unique.
2. Runs are grouped by anchor and context; groups that can hold a repeat (several contexts under an anchor, a context found more
   than once, an anchor twice in its run) send one or two of their contexts' bodies, cut from their documents.
3. Per bin of anchors the different bodies are concatenated (distinct separators), each with the number of times that it came,
   and indexed: suffix order by prefix doubling, the Burrows-Wheeler transform cut into runs, and samples kept at run heads and
   run ends alone, each with the length of its match with the neighbour in suffix order. A body that came twice stands there
   twice, beside itself. Streaming over the text, the match length at a position follows from the last sample before it, less
   the distance; the larger of both neighbours' is the longest match with any other position. Positions with LENGTH or more
   are marked: repetitive contexts have few runs, so few matches are ever compared.
4. Marks go back to all runs of the same context, and each document cuts the union of its marked windows.

Every mark comes from an index over bytes; hashes only route windows, and tell which runs have the context that was indexed.

Anchors with more than HOT contexts (a passage in a large share of all documents, before ever different text) would put an
unbounded group into one bin. Their contexts' windows are dealt again, by a longer string that they must share (``CORES``):
windows in which the anchor stands about as far from the window's begin have a core of LENGTH - step + 1 bytes in common if
they are equal. Cores that occur once are dropped as anchors are. The last step's core is the window itself, so no group stays
hot, and only windows at the passage's very ends get so far. This works on the bodies that were sent, not on the documents.

Texts are shuffled twice, compressed; runs once. Contexts and spans of one document are bounded by its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import common

LENGTH, GRAM = 200, 24
#: Windows in a run at most; longer ones (periodic text) are cut.
RUN = 256
#: Bytes of a text that are scanned at once, and bytes of contexts in one index.
SEGMENT, BIN_BYTES = 1 << 18, 1 << 17
#: Different contexts under one key beyond which its windows are dealt again, and by how many places of the anchor each time.
HOT = 512
CORES = (44, 11, 1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


class _Rolling:
    """Hashes of any substrings of a byte array: prefix sums of bytes times powers, modulo 2^64."""

    _powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(16, int(len(data) + 1).bit_length())
        if (which, size) not in self._powers:
            up, down = np.full(size, _BASES[which]), np.full(size, _INVERSE[which])
            up[0] = down[0] = 1
            self._powers[which, size] = np.cumprod(up), np.cumprod(down)
        up, self.down = self._powers[which, size]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        down = self.down[: len(self.sums)]
        return common.mix((self.sums[end] - self.sums[begin]) * down[begin])


def _sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def scan(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of the byte strings: which part, first window, windows, anchor, context hash, and whether the anchor stands in the
    run more than once (only then can windows of one run equal each other)."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    roll = _Rolling(data, 0)
    grams = roll(slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
    low = _sliding(grams, width)
    begin = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)[: len(low)]
    valid = np.arange(len(low)) + LENGTH <= (begin + sizes)[part]
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    value, owner = low[at], part[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(within % RUN == 0)
    count = np.diff(np.append(first, len(at)))
    start, anchor, owner = at[first], value[first], owner[first]
    stop = start + count + LENGTH - 1
    # How often each run's anchor stands in it: only grams that are some window's least can be an anchor.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, low, 0), np.zeros(width - 1, np.uint64)])
    place = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(grams)] == grams)
    kinds, rank = np.unique(grams[place], return_inverse=True)
    keys = np.sort(rank.astype(np.int64) * (len(data) + 1) + place)
    own = np.searchsorted(kinds, anchor).astype(np.int64) * (len(data) + 1)
    several = np.searchsorted(keys, own + stop - GRAM, side="right") - np.searchsorted(keys, own + start) > 1
    context = _Rolling(data, 1)(start, stop)
    return owner, start - begin[owner], count, anchor.view(np.int64), context.view(np.int64), several


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of about SEGMENT bytes: (text's number, offset, bytes). Long texts are cut so that each window is in one piece."""
    who, base, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            piece = t[a : a + SEGMENT + LENGTH - 1]
            who.append(i)
            base.append(a)
            parts.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield who, base, parts
                who, base, parts, size = [], [], [], 0
    if parts:
        yield who, base, parts


def _runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
            for who, base, parts in _segments(texts):
                owner, start, count, anchor, context, several = scan(parts)
                if not len(owner):
                    continue
                row = np.array(who)[owner]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(start + np.array(base)[owner], pa.int64()), pa.array(count, pa.int32()), pa.array(anchor, pa.int64()), pa.array(context, pa.int64()), pa.array(several, pa.bool_())],
                    ["did", "th", "ws", "wn", "h", "c", "several"],
                )

    return common.mapped(docs.select("did", "th", "text"), run, "did long, th long, ws long, wn int, h long, c long, several boolean")


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several strings, with samples at run heads and run ends.

    times: how often each string stands in the collection. Copies would be neighbours in every row, so a row counts for all of
    them, and its match with the next one is its whole rest.
    """

    def __init__(self, strings: list[bytes], times: list[int] | None = None):
        size = np.array([len(s) for s in strings])
        n = int(size.sum()) + len(strings)
        text = np.zeros(n, np.int64)  # a byte plus 1; 0 is a separator
        self.begin = np.cumsum(size + 1) - size - 1
        solid = np.ones(n, bool)
        solid[self.begin + size] = False
        text[solid] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        left = np.repeat(self.begin + size, size + 1) - np.arange(n)  # bytes up to the separator
        self.text, self.left = text, left
        self.several = np.repeat(np.array(times or [1] * len(strings)) > 1, size + 1)
        order = self._suffix_order(int(size.max()) if len(size) else 0)
        # The transform. Separators differ from each other, so each is a run of its own.
        before = np.where(order > 0, text[order - 1], 0)
        before = np.where(before == 0, -order - 1, before)
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.n_runs = int(head.sum())
        heads, ends = np.flatnonzero(head), np.flatnonzero(np.concatenate([head[1:], [True]]))
        self.samples = []
        for rows, other in ((heads, -1), (ends, 1)):
            inside = (rows + other >= 0) & (rows + other < n)
            place, match = order[rows], np.zeros(len(rows), np.int64)
            match[inside] = self._common(place[inside], order[rows[inside] + other])
            by = np.argsort(place)
            self.samples.append((place[by], match[by]))

    def _suffix_order(self, longest: int) -> np.ndarray:
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(6, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = (key << 9) | np.where(self.left > j, padded[j : j + n], 0)
        self.seven = np.concatenate([key, np.zeros(7, np.int64)])  # seven symbols at once, for comparisons
        order = np.argsort(key)
        rank = np.empty(n, np.int64)  # a suffix's rank is the place of the first that is equal to it so far
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], key[order][1:] != key[order][:-1]]), np.arange(n), 0))
        tied = np.bincount(rank, minlength=n)[rank] > 1
        some, h = np.flatnonzero(tied), 7
        while len(some) and h < longest:  # only what is still tied is sorted again, by what follows
            later = np.where(self.left[some] > h, rank[np.minimum(some + h, n - 1)] + 1, 0)
            fine = rank[some] * (n + 1) + later
            by = np.argsort(fine)
            some, fine, place = some[by], fine[by], np.arange(len(some))
            coarse = rank[some]
            new = np.concatenate([[True], fine[1:] != fine[:-1]])
            first, group = (np.maximum.accumulate(np.where(x, place, 0)) for x in (new, np.concatenate([[True], coarse[1:] != coarse[:-1]])))
            rank[some] = coarse + first - group
            size = np.diff(np.append(np.flatnonzero(new), len(some)))
            some = some[np.repeat(size > 1, size)]
            h *= 2
        return np.argsort(rank * n + np.arange(n))  # equal suffixes of different strings: in the order of their separators

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, within their strings."""
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        for width, at in ((7, self.seven), (1, self.text)):
            live = np.arange(len(a))
            while len(live):
                d = out[live]
                live = live[(d + width <= most[live]) & (at[np.minimum(a[live] + d, len(at) - 1)] == at[np.minimum(b[live] + d, len(at) - 1)])]
                out[live] += width
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match of its suffix with any other suffix."""
        out, i = np.zeros(len(self.text), np.int64), np.arange(len(self.text))
        for place, match in self.samples:
            last = np.searchsorted(place, i, side="right") - 1
            out = np.maximum(out, np.where(last >= 0, match[last] - (i - place[last]), 0))
        return np.where(self.several, self.left, np.minimum(out, self.left))


def _spans(flags: np.ndarray) -> np.ndarray:
    """(n, 2): first and last of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


def _packed(starts: np.ndarray) -> bytes:
    return starts.astype("<i4").tobytes()


_CONTEXT = ["h", "c", "marks"]


def _together(bodies: DataFrame, parts: int) -> DataFrame:
    """h, c, n, body: all bodies of an anchor (or core) in one task, one after the other.

    Dealt by a hash of h, not by h itself: after a join by h Spark would leave such a shuffle out, and then read the join's own
    shuffle by map task or in pieces (a join turned into a broadcast, a skewed partition), so that copies would not meet.
    """
    return bodies.select("h", "c", "n", "body").repartition(parts, F.xxhash64("h")).sortWithinPartitions("h", "c")


def _marked_contexts(bodies: DataFrame) -> DataFrame:
    """h, c, marks for bodies (h, c, n, body) that lie together by h: one index for about BIN_BYTES of whole groups."""

    def flush(rows):
        strings: dict[tuple[int, bytes], int] = {}
        for h, _, n, body in rows:
            strings[h, body] = strings.get((h, body), 0) + n
        index = RunLengthIndex([body for _, body in strings], list(strings.values()))
        long = index.matching_statistics() >= LENGTH
        spans = {}
        for key, b in zip(strings, index.begin.tolist()):
            flags = long[b : b + len(key[1])]
            spans[key] = _packed(_spans(flags)) if flags.any() else b""
        out = {(h, c, m) for h, c, _, body in rows if (m := spans[h, body])}
        cols = list(zip(*sorted(out))) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], _CONTEXT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if rows and size >= BIN_BYTES and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush(rows)

    return common.mapped(bodies, run, "h long, c long, marks binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """did, th (a text's hash): together they name a row; rows that share both are equal in all that matters here."""
    return common.texts(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("th"), "doc_id", "text")


def _compressed(docs: DataFrame) -> DataFrame:
    """The texts for a shuffle: did, th, doc_id, z."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], ["did", "th", "doc_id", "z"])

    return common.mapped(docs, run, "did long, th long, doc_id long, z binary")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, c, n, body, hot of the wanted contexts (h, c, n, hot, did, th, ws, wn), cut from their documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, seen = zstandard.ZstdDecompressor(), None
        for b in batches:
            rows = []
            for did, th, z, want in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (did, th) == seen:  # a repeated row
                    continue
                seen, text = (did, th), expand.decompress(z)
                rows += [(w["h"], w["c"], w["n"], text[w["ws"] : w["ws"] + w["wn"] + LENGTH - 1], w["hot"]) for w in want]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], ["h", "c", "n", "body", "hot"])

    per = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("h", "c", "n", "hot", "ws", "wn")).alias("want"))
    joined = _compressed(docs).hint("merge").join(per, ["did", "th"])  # sorted, so that repeated rows stand together
    return common.mapped(joined.select("did", "th", "z", "want"), run, "h long, c long, n int, body binary, hot boolean")


def cores(text: bytes, rows: list[tuple[int, int, int, int]], step: int) -> list[tuple[int, int, int, int, int]]:
    """Parts of runs whose windows must share a core if they are equal: (place in rows, first window, windows, key, context).

    rows: (first window, windows, anchor, key so far). A window's place in a run is told by the anchor's first occurrence in it,
    ``j`` bytes from its begin; windows with equal ``j // step`` share the bytes from the anchor less step * (j // step) on.
    """
    out = []
    for nth, (ws, wn, anchor, key) in enumerate(rows):
        data = np.frombuffer(text, np.uint8, wn + LENGTH - 1, ws)
        roll, context = _Rolling(data, 0), _Rolling(data, 1)
        places = np.flatnonzero(roll(slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1)).view(np.int64) == anchor)
        i = np.arange(wn)
        at = places[np.searchsorted(places, i)]
        band = (at - i) // step
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (band[1:] != band[:-1])]))
        count = np.diff(np.append(new, wn))
        begin = at[new] - step * band[new]
        core = roll(begin, begin + LENGTH - step + 1)
        name = common.mix(core ^ common.mix(np.uint64(key % (1 << 64)) + band[new].astype(np.uint64) * common.GOLD + np.uint64(step))).view(np.int64)
        body = context(new, new + count + LENGTH - 1).view(np.int64)
        out += zip([nth] * len(new), (new + ws).tolist(), count.tolist(), name.tolist(), body.tolist())
    return out


_PART = "h long, c long, n int, h0 long, c0 long, off long, body binary"


def _dealt_again(hot: DataFrame, step: int) -> DataFrame:
    """The windows of contexts (or parts of them) by cores: key h and hash c of each part, its place ``off`` in the context h0, c0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, _, n, h0, c0, off, body in zip(*(b.column(i).to_pylist() for i in range(7))):
                for _, ws, wn, key, c in cores(body, [(0, len(body) - LENGTH + 1, h0, h)], step):
                    out.append((key, c, n, h0, c0, off + ws, body[ws : ws + wn + LENGTH - 1]))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], [c.split()[0] for c in _PART.split(", ")])

    return common.mapped(hot, run, _PART)


def _shifted(marks: DataFrame) -> DataFrame:
    """h, c, marks of whole contexts from those of their parts (h0, c0, off, marks)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved = [(np.frombuffer(m, "<i4") + np.int32(off)).tobytes() for off, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(moved, pa.binary())], _CONTEXT)

    return common.mapped(marks.select("h0", "c0", "off", "marks"), run, "h long, c long, marks binary")


def _marks_of_hot(spark: SparkSession, hot: DataFrame, parts: int) -> DataFrame:
    """h, c, marks for the contexts (h, c, n, body) of hot anchors."""
    cur, found = hot.select("h", "c", "n", F.col("h").alias("h0"), F.col("c").alias("c0"), F.lit(0).cast("long").alias("off"), "body"), []
    for at, step in enumerate(CORES):
        cur = session.written(spark, _dealt_again(cur, step), "cores")
        distinct = cur.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("body").alias("one"), F.max("body").alias("two"))
        distinct = session.written(spark, distinct, "parts")
        keys = distinct.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("nd")).where("n > 1")
        keys = session.written(spark, keys.select("h", (F.col("nd") > HOT if at < len(CORES) - 1 else F.lit(False)).alias("again")), "keys")
        cold = distinct.join(keys.where("NOT again"), "h").select("h", "c", F.least("n", F.lit(2)).cast("int").alias("n"), F.explode(F.array_distinct(F.array("one", "two"))).alias("body"))
        marks = session.written(spark, _marked_contexts(_together(cold, parts)), "part-marks")
        found.append(_shifted(cur.join(marks, ["h", "c"])))
        if not keys.where("again").limit(1).count():
            break
        cur = cur.join(keys.where("again").select("h"), "h", "left_semi")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _cut(text: bytes, found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by marked windows. found: runs with ws and marks."""
    if not found:
        return []
    pairs = []
    for f in found:
        for m in f["marks"]:
            pairs.append(np.frombuffer(m, "<i4").reshape(-1, 2).astype(np.int64) + f["ws"])
    p = np.concatenate(pairs)
    p = p[np.argsort(p[:, 0], kind="stable")]
    end = np.maximum.accumulate(p[:, 1] + LENGTH)
    new = np.concatenate([[True], p[1:, 0] > end[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(p) - 1)
    return list(zip(p[first, 0].tolist(), end[last].tolist()))


def found_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """did, th, found: the runs with marks of each document that has any. ``docs`` as ``_keyed`` gives them.

    Rows that share did and th are one document that stands there ``k`` times.
    """
    common.small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = session.written(spark, _runs(docs), "all-runs")  # texts are scanned once
    counts = runs.groupBy("h").agg(F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("n"))
    anchors = session.written(spark, counts.where("n > 1").select("h"), "anchors")
    cand = runs.join(anchors, "h", "left_semi").groupBy("h", "c", "wn", "did", "th", "ws", "several").agg(F.count("*").alias("k"))
    cand = session.written(spark, cand, "runs")
    session.discard(spark, runs)
    place = F.struct("did", "th", "ws")
    distinct = cand.groupBy("h", "c", "wn").agg(F.sum("k").alias("n"), F.max("several").alias("several"), F.min(place).alias("one"), F.max(place).alias("two"))
    distinct = session.written(spark, distinct, "contexts")
    keys = distinct.groupBy("h").agg(F.count("*").alias("nd"), F.max("n").alias("most"), F.max("several").alias("several"))
    keys = session.written(spark, keys.where("nd > 1 OR most > 1 OR several").select("h", (F.col("nd") > HOT).alias("hot"), (F.col("nd") > 1).alias("mixed")), "keys")
    # alone under its anchor a context is a repeat of itself or nothing; beside others, one that came once counts as well
    use = distinct.join(keys, "h").where("n > 1 OR several OR mixed")
    each = F.when(F.col("n") < 2, F.array(F.struct("one", F.lit(1).alias("n")))).when(F.col("one") == F.col("two"), F.array(F.struct("one", F.lit(2).alias("n")))).otherwise(F.array(F.struct("one", F.lit(1).alias("n")), F.struct(F.col("two").alias("one"), F.lit(1).alias("n"))))
    wanted = use.select("h", "c", "wn", "hot", F.explode(each).alias("e")).select("h", "c", "wn", "hot", "e.n", "e.one.*")
    bodies = session.written(spark, _contexts(docs, wanted), "bodies")
    found = _marked_contexts(_together(bodies.where("NOT hot"), parts))
    if keys.where("hot").limit(1).count():
        found = found.unionByName(_marks_of_hot(spark, bodies.where("hot"), parts))
    marks = session.written(spark, found.groupBy("h", "c").agg(F.collect_set("marks").alias("marks")), "marks")
    session.discard(spark, anchors, distinct, keys, bodies)
    return cand.join(marks, ["h", "c"]).groupBy("did", "th").agg(F.collect_list(F.struct("ws", "marks")).alias("found"))


def marked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """did, th, doc_id, z (the text compressed), found: each document's runs with marks (null if none)."""
    docs = _keyed(docs)
    return _compressed(docs).join(found_runs(spark, docs), ["did", "th"], "left")


def _whole(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, as far as they cover whole characters."""
    out, at = [], 0
    for a, e in spans:
        while a < e and text[a] & 0xC0 == 0x80:
            a += 1
        while e > a and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        out.append(text[at:a])
        at = e
    out.append(text[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def cleaned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut from ``text`` (whole characters only) and ``n_chars``, if there is such a
    column, counted anew. A null text stays null; repeated rows are copies of each other, so both lose what they share. Other
    columns stay as they are."""
    found = found_runs(spark, _keyed(docs))
    key = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("th"))
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            cols = {n: row.field(n) for n in schema.names}
            texts = [t if t is None or not f else _whole(t.encode("utf-8", "surrogatepass"), _cut(b"", f)) for t, f in zip(cols["text"].to_pylist(), b.column(1).to_pylist())]
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return common.mapped(key.join(found, ["did", "th"], "left").select("row", "found"), run, schema)


def removed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each input row.

    Texts are UTF-8 bytes; null texts count as empty; texts shorter than LENGTH lose nothing. Repeated rows are copies of each
    other and lose every window. Null ids are kept. Empty tables give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, z, found in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = expand.decompress(z)
                spans = _cut(text, found)
                digest, at = hashlib.sha256(), 0
                for a, e in spans:
                    digest.update(text[at:a])
                    at = e
                digest.update(text[at:])
                rows.append((doc_id, len(text), sum(e - a for a, e in spans), len(spans), digest.hexdigest()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return common.mapped(marked(spark, docs).select("doc_id", "z", "found"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
