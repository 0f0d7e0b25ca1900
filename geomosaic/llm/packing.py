"""Packing: order-preserving dynamic programming.

Documents are tokenised in doc_id order, each ending with a separator id, and the stream of ids is cut into windows of at
most ``window`` ids. A cut may stand at a document's end (free), at a sentence's end (a small truncation penalty) or, only
where sentences are longer than a window, anywhere (a large one). A window costs its padding: up to ``window``, or nothing if
its length is a power of two (of LEAST_POWER or more: shorter sequences aren't worth their place in a batch). With positions p and f the least cost up to a boundary,

    f(j) = penalty(j) + min(  min over p(j) - window <= p(i) < p(j) of [f(i) + p(i)] + window - p(j),
                              min over p(j) - p(i) a power of two of f(i)  )

The first minimum slides with j and is kept by a monotone queue, so the work is linear in the boundaries. A stream's last
window may also be cut into powers of two, each such cut at the large penalty.

Ranges of (doc_id, the text's hash) are packed side by side, so rows of one id or without an id part as well; within one,
blocks of about BLOCK ids are packed one after the other, which bounds memory. So only block ends cost anything beyond the optimum. One shuffle of the texts, none of ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic.llm import common

WINDOW = 4096
#: Cost, in ids of padding, of a cut at a sentence's end, and of one inside a sentence.
SENTENCE_CUT, HARD_CUT = 16, 64
LEAST_POWER = 512
#: Ids that are packed at once.
BLOCK = 1 << 20
#: Entries of a worker's cache (about 200 bytes each); beyond it the half that was used most stays.
CACHE_ENTRIES = 240_000

#: Words of lower-case Latin letters (in UTF-8). Their letters are precomposed, so that normalisation leaves them as they are.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: What a sentence's last word ends with.
_STOPS = frozenset((b".", b"!", b"?"))
#: Of bytes: whether they are ASCII letters or marks, and what A-Z become.
_LETTER, _MARK = (np.array([32 < i < 127 and chr(i).isalnum() is x and not chr(i).isdigit() for i in range(256)]) for x in (True, False))
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def split(texts: list[str], lower: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The parts of all texts in a row (UTF-8), where each text's parts end, which parts a line ends with, and which stand directly
    behind the part before. Texts are parted at blanks and line feeds (white space that is doubled or stands at an end parts
    empty strings), and between a Latin letter and an ASCII mark, where no pre-tokeniser's piece goes on.

    ``lower``: A-Z and the capitals of Latin-1 become small, unless a code point from U+0300 on follows, which may combine with them.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    after = np.append(data[1:], np.uint8(0))
    latin = np.concatenate([[False], data[:-1] == 0xC3])[: len(data)] & (data != 0x97) & (data != 0xB7)  # second bytes
    marks = np.flatnonzero((_LETTER[data] | latin) & _MARK[after]) + 1
    line = data == 10
    low = data
    if lower:
        low = _LOWER[data]
        low[latin & (data < 0x9F)] += np.uint8(32)
        low = np.where(after >= 0xCC, data, low)
    flat = np.insert(np.where(line, np.uint8(32), low), marks, 32)
    blanks = np.flatnonzero(flat == 32)
    part_at = lambda place: np.searchsorted(blanks, place + np.searchsorted(marks, place, side="right"))  # noqa: E731  that ends there
    parts = flat.tobytes().split(b" ")
    last = np.append(part_at(np.cumsum([len(r) + 1 for r in raw[:-1]], dtype=np.int64) - 1) + 1, len(parts)).astype(np.int64)
    stop, joined = np.zeros(len(parts), bool), np.zeros(len(parts), bool)
    stop[part_at(np.flatnonzero(line))] = True
    stop[last - 1] = True
    joined[part_at(marks - 1) + 1] = True
    return parts, last, stop, joined


def _gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``pool[begin[i]:begin[i] + size[i]]`` in a row."""
    upto = np.cumsum(size)
    return pool[np.repeat(begin - upto + size, size) + np.arange(int(size.sum()))].astype("<u4", copy=False)


class _Pool:
    """Ids by part. Parts have numbers; a number's ids are ``pool[begin:begin + size]``, and ``stop`` says that it may end a
    sentence. Number 0 is the empty part."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": 0}
        self.pool, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.used, self.stop = np.zeros(1, np.int64), np.zeros(1, bool)

    def add(self, names: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.size), len(self.size) + len(names))))
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])
        self.used = np.concatenate([self.used, np.zeros(len(names), np.int64)])
        self.stop = np.concatenate([self.stop, np.array([n[-1:] in _STOPS for n in names], bool)])

    def take(self, numbers: np.ndarray) -> np.ndarray:
        self.used += np.bincount(numbers, minlength=len(self.used))
        return _gathered(self.pool, self.begin[numbers], self.size[numbers])

    def shrunk(self, entries: int) -> _Pool:
        """Itself, or beyond so many entries a new one with the half of them that was used most."""
        if len(self.size) <= entries:
            return self
        best = np.sort(np.argsort(-self.used[1:], kind="stable")[: entries // 2]) + 1
        names, out = list(self.number), _Pool()  # names stand in the order of their numbers
        out.add([names[i] for i in best.tolist()], _gathered(self.pool, self.begin[best], self.size[best]), self.size[best])
        out.used[1:] = self.used[best] // 2
        return out


class WordIds:
    """Ids of texts, by a cache over their parts (``split``).

    The vocabulary drops white space and no merge crosses it, nor a word's end, so a text's ids are those of its parts in a row.
    Unseen parts go to the tokenizer in batches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.parts = _Pool()
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")

    def _tokenise(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each part."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.array([*map(len, found)], np.int64)

    def tokenise(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids in a row, how many belong to each part, and the parts in that order: plain words last."""
        plain, odd = [], []
        for p in parts:
            (plain if _PLAIN.fullmatch(p) else odd).append(p)
        ids, size = self._tokenise([p.decode("utf-8", "surrogatepass") for p in odd])
        all_ids, all_sizes = [ids], [size]
        for i in range(0, len(plain), 1000):  # many words to a text: each ends with its only word-end token
            some = plain[i : i + 1000]
            ids, _ = self._tokenise([b" ".join(some).decode()])
            size = np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)
            if len(size) != len(some):
                raise ValueError("a word without an end, or with several")
            all_ids.append(ids)
            all_sizes.append(size)
        return np.concatenate(all_ids), np.concatenate(all_sizes), odd + plain

    def ids(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """Each text's ids (little-endian unsigned 32-bit), and after how many of them a sentence or line ends."""
        if not texts:
            return []
        self.parts = self.parts.shrunk(CACHE_ENTRIES)
        parts, last, stop, _ = split(texts, lower=True)
        known = self.parts.number
        number = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            unseen = [parts[i] for i in missing.tolist()]
            ids, size, names = self.tokenise(list(dict.fromkeys(unseen)))
            self.parts.add(names, ids, size)
            number[missing] = np.fromiter(map(known.__getitem__, unseen), np.int64, len(unseen))
        flat, upto = self.parts.take(number), np.cumsum(self.parts.size[number])
        edge = np.concatenate([[0], upto[last - 1]])
        at = np.flatnonzero(stop | self.parts.stop[number])
        of, ends = np.searchsorted(last, at, side="right"), upto[at]
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (ends[1:] != ends[:-1])
        of, ends = of[new], ends[new] - edge[of[new]]
        cut = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        edge = edge.tolist()
        return [(flat[a:b].tobytes(), ends[c:d]) for a, b, c, d in zip(edge, edge[1:], cut, cut[1:])]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cuts(length: int, places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Where windows end: ascending positions, the last of them ``length``.

    places: allowed cuts, ascending, within 1..length, the last being ``length``; penalty: what each costs.
    """
    steps = np.diff(places, prepend=0)
    if (steps > window).any():  # hard cuts where allowed ones are too far apart
        extra = [np.arange(b - s + window, b, window) for b, s in zip(places[steps > window].tolist(), steps[steps > window].tolist())]
        more = np.concatenate(extra)
        places, penalty = np.concatenate([places, more]), np.concatenate([penalty, np.full(len(more), HARD_CUT)])
        order = np.argsort(places, kind="stable")
        places, penalty = places[order], penalty[order]
    pos = np.concatenate([[0], places])
    n = len(pos)
    p, cost = array("q", pos.astype(np.int64).tobytes()), array("q", np.concatenate([[0], penalty]).astype(np.int64).tobytes())
    cost[-1] = 0
    at = np.full(length + 1, -1, np.int32)
    at[pos] = np.arange(n)
    exact: dict[int, list[int]] = {}
    power = LEAST_POWER
    while power < window:  # boundaries that a power of two parts
        src = at[np.maximum(pos - power, 0)]
        hit = np.flatnonzero((pos >= power) & (src >= 0))
        for j, i in zip(hit.tolist(), src[hit].tolist()):
            exact.setdefault(j, []).append(i)
        power *= 2
    # The queue holds boundaries with ascending f(i) + p(i); its first is the best of those in reach.
    f, come = array("d", bytes(8 * n)), array("q", bytes(8 * n))
    q_at, q_key, q_i, top = array("q", [0]), array("d", [0.0]), array("q", [0]), 0
    for j in range(1, n):
        here = p[j]
        while here - q_at[top] > window:
            top += 1
        best, value = q_i[top], q_key[top] + window - here
        if j in exact:
            for i in exact[j]:
                if f[i] < value:
                    value, best = f[i], i
        value += cost[j]
        f[j], come[j] = value, best
        k = value + here
        while len(q_key) > top and q_key[-1] >= k:
            q_key.pop()
            q_at.pop()
            q_i.pop()
        q_key.append(k)
        q_at.append(here)
        q_i.append(j)
    # The last window, whole or cut into powers of two.
    lo = int(np.searchsorted(pos, length - window))
    tail = [(f[i] + min(0 if (length - p[i]).bit_count() == 1 else window - length + p[i], HARD_CUT * ((length - p[i]).bit_count() - 1)), i) for i in range(lo, n - 1)]
    _, i = min(tail)
    rest, out = length - p[i], [length]
    if rest.bit_count() > 1 and HARD_CUT * (rest.bit_count() - 1) < window - rest:
        end = p[i]
        for b in range(rest.bit_length() - 1, -1, -1):
            if rest >> b & 1:
                end += 1 << b
                out.append(end)
        out = sorted(set(out), reverse=True)
    while i:
        out.append(p[i])
        i = come[i]
    return out[::-1]


def _pieces(docs: list[tuple[int, bytes, np.ndarray]], window: int) -> list[tuple]:
    """(doc_id, start, length, ids_crc32, doc_tokens, window's number, offset) of a block."""
    size = [len(ids) // 4 for _, ids, _ in docs]
    first = np.cumsum([0, *size])
    places = np.concatenate([np.append(ends[(ends > 0) & (ends < n)], n) + b for (_, _, ends), n, b in zip(docs, size, first.tolist())])
    penalty = np.full(len(places), SENTENCE_CUT)
    penalty[np.searchsorted(places, first[1:])] = 0
    ends = cuts(int(first[-1]), places, penalty, window)
    out, w, begin = [], 0, 0
    for (doc_id, ids, _), n, b in zip(docs, size, first.tolist()):
        view, done = memoryview(ids), 0
        while done < n:
            while ends[w] <= b + done:
                begin = ends[w]
                w += 1
            take = min(n - done, ends[w] - b - done)
            out.append((doc_id, done, take, zlib.crc32(view[4 * done : 4 * (done + take)]), n, w, b + done - begin))
            done += take
    return out


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Null texts count as empty: their only id is ``end_id``. Repeated rows and ids are documents of their own; null ids come
    first. Documents stand in doc_id order (equal ids by the text's hash) and keep it within and across a partition's
    sequences; sequence ids ascend with it. Empty tables give no rows.
    """
    tail = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = word_ids(vocabulary), TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes, np.ndarray]] = []
        total, used = 0, 0

        def flush():
            nonlocal held, total, used
            cols = list(zip(*_pieces(held, window)))
            seq = np.array(cols[5], np.int64) + base + used
            used += cols[5][-1] + 1
            held, total = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols[:5], seq, cols[6])], names)

        for b in common.chunks(batches, 1 << 20):
            for doc_id, (ids, ends) in zip(b.column(0).to_pylist(), words.ids(b.column(1).to_pylist())):
                held.append((doc_id, ids + tail, ends))
                total += len(ids) // 4 + 1
                if total >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = common.texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return common.mapped(dealt, run, ", ".join(f"{c} long" for c in names))
