"""URL filters: a bit-parallel wildcard automaton.

All glob rules are packed side by side into one Shift-And bit vector of as many 64-bit words as it takes. One step reads
one byte of every URL of a batch and advances every pattern at once: ``state = (((state without last positions) << 1 with
carries) | starts) & mask[byte]``, plus the states that a wildcard keeps alive. Last positions are cleared before the shift, so
that no pattern's end begins its neighbour. A pattern's ``*`` is a position that loops on the bytes it may cover, ``?`` is one
byte; in a host neither may cover ``/``, so a wildcard never runs from the host into the path.

Batches are cut by bytes. URLs beyond LONG bytes run one by one, with the whole bit vector as one Python integer.

Canonical URL: ``"." + host + path``, UTF-8 bytes. The host stands after the first ``://`` up to ``/ ? #`` or the end, with
A-Z lower-cased; the path follows up to ``? #`` or the end. Null URLs and those without ``://`` have an empty host and path;
an empty host fits no rule. A rule ``host/path`` becomes the glob ``*.host/path*``: the dot in front of the canonical form
makes the host itself and all its subdomains match, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomosaic.llm import common

#: Bytes of URLs that are matched at once, and of a URL that runs alone.
BATCH_BYTES, LONG = 1 << 20, 2048


@dataclass(frozen=True)
class Rule:
    """verdict is "allow" or "block"; name is host + path, the path begins with "/"."""

    verdict: str
    name: str


class ShiftAnd:
    """Globs over bytes, simulated together. ``*`` before a glob's first ``/`` loops on all bytes but ``/``; later ones, and one at
    its end, on all. ``?`` is any byte, but not ``/`` before a glob's first ``/``."""

    def __init__(self, globs: list[bytes]):
        self.n = len(globs)
        length = sum(len(g.replace(b"*", b"")) for g in globs)
        self.words = max(1, -(-length // 64))
        self.mask = np.zeros((256, self.words), np.uint64)
        # first positions of globs that begin with a wildcard, and of those that may only begin at the first byte
        self.start, self.at_zero = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.accept = np.zeros((self.n, self.words), np.uint64)
        self.to_end = np.zeros(self.n, bool)  # must match up to the last byte
        self.loop = np.zeros((2, self.words), np.uint64)  # positions before an inner wildcard: on all bytes, on all but "/"
        p = 0
        for i, g in enumerate(globs):
            body = g.strip(b"*")
            word, bit = divmod(p, 64)
            (self.start if g.startswith(b"*") else self.at_zero)[word] |= np.uint64(1 << bit)
            if not body:
                raise ValueError(f"a glob of wildcards alone: {g!r}")
            for at, c in enumerate(body):
                in_host = b"/" not in body[:at]
                if c == 0x2A:
                    word, bit = divmod(p - 1, 64)
                    self.loop[int(in_host), word] |= np.uint64(1 << bit)
                    continue
                word, bit = divmod(p, 64)
                fits = [x for x in range(256) if x != 0x2F or not in_host] if c == 0x3F else [c]
                self.mask[fits, word] |= np.uint64(1 << bit)
                p += 1
            word, bit = divmod(p - 1, 64)
            self.accept[i, word] |= np.uint64(1 << bit)
            self.to_end[i] = not g.endswith(b"*")
        self.last = np.bitwise_or.reduce(self.accept, axis=0) if self.n else np.zeros(self.words, np.uint64)

    def match(self, rows: list[bytes]) -> np.ndarray:
        """A boolean matrix, rows x globs."""
        out = np.zeros((len(rows), self.n), bool)
        if not self.n:
            return out
        short = [i for i, r in enumerate(rows) if len(r) <= LONG]
        if short:
            out[short] = self._together([rows[i] for i in short])
        for i, r in enumerate(rows):
            if len(r) > LONG:
                out[i] = self._alone(r)
        return out

    def _together(self, rows: list[bytes]) -> np.ndarray:
        m = len(rows)
        length = np.array([len(r) for r in rows])
        order = np.argsort(-length, kind="stable")  # so that the rows still running are a prefix
        flat = np.frombuffer(b"".join(rows[i] for i in order), np.uint8)
        length = length[order]
        begin = np.cumsum(length) - length
        state = np.zeros((m, self.words), np.uint64)
        in_host = np.ones(m, bool)  # the wildcard in front still stands within the host
        hit = np.zeros((m, self.n), bool)
        one, top, rest = np.uint64(1), np.uint64(63), ~self.last
        live, looped = m, bool(self.loop.any())
        for t in range(int(length[0])):
            while live and length[live - 1] <= t:
                live -= 1
            c = flat[begin[:live] + t]
            s = state[:live]
            held = s & (self.loop[0] | np.where((c != 0x2F)[:, None], self.loop[1], np.uint64(0))) if looped else None
            s &= rest
            carry = s >> top
            s <<= one
            s[:, 1:] |= carry[:, :-1]
            s |= np.where(in_host[:live, None], self.start, np.uint64(0))
            if t == 0:
                s |= self.at_zero
            s &= self.mask[c]
            if looped:
                s |= held
            in_host[:live] &= c != 0x2F
            for i in range(self.n):
                now = (s & self.accept[i]).any(axis=1)
                hit[:live, i] = now & (length[:live] == t + 1) if self.to_end[i] else hit[:live, i] | now
        out = np.zeros((m, self.n), bool)
        out[order] = hit
        return out

    def _alone(self, row: bytes) -> list[bool]:
        whole = lambda words: int.from_bytes(np.ascontiguousarray(words).astype("<u8").tobytes(), "little")
        mask, accept = [whole(x) for x in self.mask], [whole(x) for x in self.accept]
        start, loop, host_loop, rest = whole(self.start), whole(self.loop[0]), whole(self.loop[1]), ~whole(self.last)
        s, seen, first = 0, 0, whole(self.at_zero)
        for c in row:
            held = s & (loop if c == 0x2F else loop | host_loop)
            s = (((s & rest) << 1) | start | first) & mask[c] | held
            seen |= s
            first = 0
            if c == 0x2F:
                start = 0
        return [bool((s if end else seen) & a) for a, end in zip(accept, self.to_end.tolist())]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if not host.islower() else host, path


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict (its own, else ``default``).

    One row for each row of ``pages``, repeated and null urls and null ids included; very long urls are judged whole; an empty
    table gives no rows; other columns are left out. No shuffle. Rules of equal length that both fit: the first given wins. The
    rules are a parameter of fixed size and travel with the task.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))  # stable
    globs = [b"*." + r.name.encode() + b"*" for r in ranked]
    names, verdicts = [r.name for r in ranked] + [None], [r.verdict for r in ranked] + [default]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        for b in common.chunks(batches, BATCH_BYTES, "url"):
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hits = automaton.match([f".{h}{p}".encode() if h else b"" for h, p in parts])
            first = np.where(hits.any(axis=1), hits.argmax(axis=1), len(ranked)).tolist() if ranked else [0] * len(parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([names[i] for i in first], pa.string()), pa.array([verdicts[i] for i in first], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return common.mapped(src, run, "page_id long, host string, path string, rule string, verdict string")
