"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A batch of changes is folded to one additive row for each (source, lang, tokenizer_version) before anything is stored: an
insert adds a document and its tokens, a delete subtracts both, a revision adds the new count less the old. ``totals`` sums what
is committed; ``compact`` folds all committed batches into a snapshot. Only sums are shuffled, after partial sums in each task,
so a hot source or language costs one row a task.

Commits. A batch's sums are written to a folder of their own, ``data/<uuid>``, that nobody reads as yet. It is committed by
creating the file ``open/<batch id>``, which holds the folder's name, without leave to overwrite: of two writers one gets an
error and drops its folder. A snapshot is published in the same way, as ``snapshots/<number>`` with its folder and the batches
that it folds in; then ``folded/<batch id>`` is created for each of these and its open file goes. A batch that is folded, or
that the newest snapshot names, is never counted again, so a batch may be replayed after any failure and a compaction may end
anywhere. What the driver holds is bounded by the batches since the last compaction. An open file without a folder's name means
that a writer died in the act; it counts as an error until it is deleted.

Null sources, languages and versions are groups of their own; null counts count as 0. Groups whose documents and tokens are
both 0 are left out of the totals. Repeated rows count as often as they stand in the batch. Null and unknown operations are an
error. Empty batches are committed as any other and change nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import byte_bpe, common, packing

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: Parts of which a worker keeps the counts (about 150 bytes each); beyond it the half that was used most stays.
COUNT_ENTRIES = 500_000

#: Word characters' runs between ASCII white space, and that white space.
_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def utf8_bytes(text: Column) -> Column:
    """The count of a byte-level tokenizer without merges."""
    return F.octet_length(text).cast("long")


def space_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


#: Versions that need no vocabulary.
NATIVE = {"utf8_bytes_v1": utf8_bytes, "space_words_v1": space_words}


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        p = self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self._conf), p

    def _names(self, folder: str) -> list[str]:
        f, p = self._at(folder)
        return sorted(s.getPath().getName() for s in f.listStatus(p)) if f.exists(p) else []

    def _exists(self, *parts: str) -> bool:
        f, p = self._at(*parts)
        return f.exists(p)

    def _create(self, text: str, *parts: str) -> bool:
        """Create a file without leave to overwrite; False if it stands there."""
        f, p = self._at(*parts)
        f.mkdirs(p.getParent())
        try:
            out = f.create(p, False)
        except Py4JJavaError as e:
            if f.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, *parts: str) -> str:
        f, p = self._at(*parts)
        size = f.getFileStatus(p).getLen()
        data = self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream := f.open(p)) if size else b""
        if size:
            stream.close()
        if not data:
            raise RuntimeError(f"{'/'.join(parts)} is empty: its writer died; delete it and send the batch again")
        return bytes(data).decode()

    def _drop(self, *parts: str) -> None:
        f, p = self._at(*parts)
        f.delete(p, True)

    def _snapshot(self) -> tuple[int, dict]:
        """Number and content of the newest snapshot: its folder, and the batches that it folded in (not those before)."""
        names = self._names("snapshots")
        return (int(names[-1]), json.loads(self._read("snapshots", names[-1]))) if names else (-1, {"data": None, "folded": []})

    def _fresh(self, folded: list[str]) -> list[str]:
        """Committed batches that no snapshot holds."""
        return [n for n in self._names("open") if n not in set(folded) and not self._exists("folded", n)]

    def committed(self, batch_id: str) -> bool:
        return self._exists("open", batch_id) or self._exists("folded", batch_id)

    def _staged(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/data/{name}")
        return name

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch: op ("insert", "delete", "revise"), the keys, n_tokens, and old_n_tokens for revisions.

        True if it was committed now, False if it was before.
        """
        if not re.fullmatch(r"\w[\w.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_n_tokens", F.lit(0)).cast("long")
        op = F.col("op")
        known = F.when(op == "insert", F.struct(F.lit(1).alias("d"), n.alias("t"))).when(op == "delete", F.struct(F.lit(-1).alias("d"), (-n).alias("t"))).when(op == "revise", F.struct(F.lit(0).alias("d"), (n - old).alias("t"))).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))))
        deltas = changes.select(*KEYS, known.alias("x")).groupBy(*KEYS).agg(F.sum("x.d").cast("long").alias("n_docs"), F.sum("x.t").alias("n_tokens"))
        name = self._staged(deltas)
        if self._create(name, "open", batch_id):
            if not self._exists("folded", batch_id):
                return True
            self._drop("open", batch_id)  # another writer's commit was folded in meanwhile
        self._drop("data", name)
        return False

    def _sums(self) -> tuple[DataFrame, int, list[str]]:
        at, newest = self._snapshot()
        fresh = self._fresh(newest["folded"])
        names = [self._read("open", n) for n in fresh] + ([newest["data"]] if newest["data"] else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), at, fresh

    def totals(self) -> DataFrame:
        return self._sums()[0].where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; their files go only when it stands. The snapshot before stays for who
        still reads it, the one before that goes."""
        self._tidy()
        sums, at, fresh = self._sums()
        name = self._staged(sums)
        if not self._create(json.dumps({"data": name, "folded": fresh}), "snapshots", f"{at + 1:012d}"):
            self._drop("data", name)  # another compaction came first
            return
        self._tidy()
        if at >= 1:
            old = json.loads(self._read("snapshots", f"{at - 1:012d}"))
            self._drop("data", old["data"])

    def _tidy(self) -> None:
        for n in self._snapshot()[1]["folded"]:
            self._create(".", "folded", n)
            if self._exists("open", n):
                name = self._read("open", n)
                self._drop("open", n)
                self._drop("data", name)


def _cleaned(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def natively(docs: DataFrame) -> DataFrame:
    """source, lang, tokenizer_version, n_tokens, new_n_tokens, emptied: each document's count under each of NATIVE, the count
    after white space is cleaned, and whether nothing is left then."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("raw"), _cleaned(text).alias("clean"))
    per = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), f(F.col("raw")).alias("n_tokens"), f(F.col("clean")).alias("new_n_tokens")) for v, f in NATIVE.items()]))
    return src.select("source", "lang", (F.col("clean") == "").alias("emptied"), per.alias("x")).select("source", "lang", "x.*", "emptied")


class PartCounts:
    """Token counts of texts by a byte-level and a word-level vocabulary, as sums over their parts (``packing.split``).

    A part's byte-level count depends only on whether a blank stands directly before it, which then belongs to its first piece.
    Other white space is in pieces of its own: of a run before a part all but the last character, and this unless it is a
    blank; at a text's end the whole run. So cleaning white space only changes which parts have a blank and which runs remain
    (none), and one look at a text's parts gives its counts before and after. Texts with white space other than blanks and line
    feeds are encoded whole.
    """

    _ODD = re.compile("[" + "".join(map(chr, sorted(set(byte_bpe.WHITE_SPACE) - {10, 32}))) + "]")
    _RUNS = re.compile(_SPACE)

    def __init__(self, byte_path: str, word_path: str):
        self.large, self.small = byte_bpe.encoder(byte_path), packing.word_ids(word_path)
        self.number: dict[bytes, int] = {b"": 0}
        self.bytes = np.zeros((2, 1), np.int32)  # without and with a blank before; -1: not counted yet
        self.words, self.used = np.zeros(1, np.int32), np.zeros(1, np.int64)
        self.runs: dict[bytes, int] = {}

    def _byte_counts(self, parts: list[str]) -> np.ndarray:
        joined, starts, ends = byte_bpe.pretokenise(parts)
        cut, merge = starts.tolist(), self.large.merge
        slots = np.searchsorted(starts, ends)  # each part's slot is a piece of its own
        size, real = np.zeros(len(cut), np.int64), np.ones(len(cut), bool)
        real[slots] = False
        size[real] = [len(merge(joined[cut[i] : cut[i + 1]].encode("utf-8", "surrogatepass"))) for i in np.flatnonzero(real).tolist()]
        upto = np.concatenate([[0], np.cumsum(size)])
        return upto[slots] - upto[np.concatenate([[0], slots[:-1] + 1])]

    def _learn(self, unseen: list[bytes]) -> None:
        small = {p: p.lower() if p.isascii() or max(p) < 0xCC else p for p in unseen}  # else a capital may combine with what follows
        _, size, names = self.small.tokenise(list(dict.fromkeys(small.values())))
        count = dict(zip(names, size.tolist()))
        self.number.update(zip(unseen, range(len(self.words), len(self.words) + len(unseen))))
        self.words = np.append(self.words, np.array([count[small[p]] for p in unseen], np.int32))
        self.bytes = np.append(self.bytes, np.full((2, len(unseen)), -1, np.int32), axis=1)
        self.used = np.append(self.used, np.zeros(len(unseen), np.int64))

    def _shrink(self) -> None:
        if len(self.words) > COUNT_ENTRIES:
            best = np.concatenate([[0], np.sort(np.argsort(-self.used[1:], kind="stable")[: COUNT_ENTRIES // 2]) + 1])
            names = list(self.number)  # in the order of their numbers
            self.number = {names[i]: n for n, i in enumerate(best.tolist())}
            self.bytes, self.words, self.used = self.bytes[:, best], self.words[best], self.used[best] // 2
        if len(self.runs) > COUNT_ENTRIES // 10:
            self.runs.clear()

    def _run_counts(self, runs: list[bytes]) -> list[int]:
        new = list(set(runs).difference(self.runs))
        if new:
            self.runs.update(zip(new, self._byte_counts([r.decode() for r in new]).tolist()))
        return [self.runs[r] for r in runs]

    def _in_bytes(self, number: np.ndarray, blank: np.ndarray, parts: list[bytes]) -> np.ndarray:
        out = self.bytes[blank, number]
        new = np.flatnonzero(out < 0)
        if len(new):
            _, first = np.unique(2 * number[new] + blank[new], return_index=True)
            for b in (0, 1):
                some = [i for i in new[first].tolist() if blank[i] == b]
                if some:
                    self.bytes[b, number[some]] = self._byte_counts([" " * b + parts[i].decode("utf-8", "surrogatepass") for i in some])
            out = self.bytes[blank, number]
        return out.astype(np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's byte-level count, that after cleaning, its word-level count (the same after cleaning), and whether nothing
        is left by cleaning."""
        out = np.zeros((4, len(texts)), np.int64)
        odd = [i for i, t in enumerate(texts) if self._ODD.search(t)]
        for i in odd:
            clean = self._RUNS.sub(" ", texts[i]).strip(" ")
            before, after = self.large.encode([texts[i], clean])
            out[:, i] = len(before) // 4, len(after) // 4, len(self.small.ids([texts[i]])[0][0]) // 4, not clean
        plain = np.setdiff1d(np.arange(len(texts)), odd)
        if len(plain):
            out[:, plain] = self._of_plain([texts[i] for i in plain.tolist()])
        return out[0], out[1], out[2], out[3].astype(bool)

    def _of_plain(self, texts: list[str]) -> np.ndarray:
        self._shrink()
        parts, last, stop, joined = packing.split(texts, lower=False)
        number = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            unseen = [parts[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(unseen)))
            number[missing] = np.fromiter(map(self.number.__getitem__, unseen), np.int64, len(unseen))
        self.used += np.bincount(number, minlength=len(self.used))
        first, solid = np.concatenate([[0], last[:-1]]), number > 0
        starts = np.zeros(len(parts), bool)
        starts[first] = True
        feed = np.concatenate([[False], stop[:-1]]) & ~starts  # a line feed stands before
        blank = ~(starts | joined | feed)
        # where the white space before a part begins: behind the last part that isn't empty, or at the text's begin
        anchor = np.maximum.accumulate(np.where(solid | starts, np.arange(len(parts)), 0))
        before = np.concatenate([[0], anchor[:-1]])
        raw = np.where(solid, self._in_bytes(number, (blank & solid).astype(np.int64), parts), 0)
        at = np.flatnonzero(solid & feed)
        if len(at):
            raw[at] += self._run_counts([b"\n"])[0]
        char = np.where(feed, np.uint8(10), np.uint8(32)).tobytes()
        at = np.flatnonzero(solid & ~starts & (np.arange(len(parts)) - before > 1))
        raw[at] += np.array(self._run_counts([char[p + 1 : q] for p, q in zip(before[at].tolist(), at.tolist())]), np.int64)
        at = last - 1
        at = at[anchor[at] < at]
        raw[at] += np.array(self._run_counts([char[p + 1 : q + 1] for p, q in zip(anchor[at].tolist(), at.tolist())]), np.int64)
        upto = np.concatenate([[0], np.cumsum(solid)])
        filled = upto[last] > upto[first]
        leading = np.searchsorted(upto, upto[first[filled]], side="right") - 1  # each text's first part that isn't empty
        spaced = solid & ~joined
        spaced[leading] = False
        clean = np.where(solid, self._in_bytes(number, spaced.astype(np.int64), parts), 0)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (raw, clean, self.words[number].astype(np.int64))]
        return np.stack([*(x[last] - x[first] for x in sums), (~filled).astype(np.int64)])


@lru_cache(2)
def part_counts(byte_path: str, word_path: str) -> PartCounts:
    """One for each worker, so that its counts live on from task to task."""
    return PartCounts(byte_path, word_path)


def by_vocabularies(byte_path: str, word_path: str, versions: tuple[str, str] = ("byte_bpe_multi_50k", "word_bpe_49k")) -> Callable[[DataFrame], DataFrame]:
    """Like ``natively``, with counts of a byte-level and a word-level vocabulary's tokens, over whole texts. The word-level one
    drops white space, so cleaning leaves its counts as they are."""

    def counted(docs: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = part_counts(byte_path, word_path)
            for b in common.chunks(batches, 1 << 20, "raw"):
                n, new, words, emptied = counts.of(b.column(2).to_pylist())
                for version, was, now in zip(versions, (n, words), (new, words)):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([version] * b.num_rows), pa.array(was), pa.array(now), pa.array(emptied)], ["source", "lang", "tokenizer_version", "n_tokens", "new_n_tokens", "emptied"])

        src = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("raw"))
        return common.mapped(src, run, "source string, lang string, tokenizer_version string, n_tokens long, new_n_tokens long, emptied boolean")

    return counted


def maintained(spark: SparkSession, docs: DataFrame, path: str, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The totals after three batches over the whole table: all documents inserted; those revised whose counts change when
    runs of white space become one blank and the ends are trimmed; those deleted that are empty then. The first batch is sent
    twice, which changes nothing. Texts are read and counted once; the batches take their rows from the written counts."""
    rollup = Rollup(spark, path)
    counts = session.written(spark, count(docs), "token-counts")
    none = F.lit(None).cast("long").alias("old_n_tokens")
    load = counts.select(F.lit("insert").alias("op"), *KEYS, "n_tokens", none)
    rollup.apply("load", load)
    rollup.apply("load", load)  # a replay
    rollup.apply("revise", counts.where("n_tokens <> new_n_tokens").select(F.lit("revise").alias("op"), *KEYS, F.col("new_n_tokens").alias("n_tokens"), F.col("n_tokens").alias("old_n_tokens")))
    rollup.apply("delete", counts.where("emptied").select(F.lit("delete").alias("op"), *KEYS, F.col("new_n_tokens").alias("n_tokens"), none))
    rollup.compact()
    return rollup.totals()
