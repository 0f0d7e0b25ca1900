"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation reads no regular expression. Every code point gets a class (letter, number, space, other) from a table; the
classes become symbols; a small automaton over the symbols says where a piece begins. Its transition functions are composed
block by block (composition is associative): first each block's function over all states, then a scan over the blocks, then a
replay of all blocks side by side from their now known states. The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+`` (L, N: Unicode letters and numbers, s: white space).

Pieces go through a bounded cache to their ids (packed little-endian); only unseen pieces are merged, lowest rank first.
The code point offsets of pieces and each id's bytes are kept, so that ids decode to the exact bytes.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geomosaic.llm import common

#: Unicode's White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)

# Symbols. A *last* space stands directly before something that is no space.
LETTER, NUMBER, OTHER, BLANK_LAST, SPACE_MID, SPACE_LAST, APOS1, APOS2, RESET = range(9)
# States: what stands before. FRESH: a text's or contraction's end; C1, C2: so many characters of a contraction to come.
FRESH, S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_SPACE, S_LAST, C1, C2 = range(9)
BLOCK = 64
#: Entries of a worker's piece cache; beyond it the cache starts anew.
CACHE_ENTRIES = 700_000


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_MID for every code point, filled by ranges from Unicode's categories."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        if (k := kinds.get(unicodedata.category(chr(cp))[0])) is not None:
            out[cp] = k
    out[list(WHITE_SPACE)] = SPACE_MID
    return out


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state, symbol] and whether a piece begins there."""
    step, begins = np.zeros((9, 9), np.uint8), np.zeros((9, 9), bool)
    plain = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER}
    for state in range(9):
        for symbol in range(9):
            if symbol == RESET:
                to, new = FRESH, True
            elif state in (C1, C2):  # inside a contraction
                to, new = (C1 if state == C2 else FRESH), False
            elif symbol in plain:
                to = plain[symbol]
                new = not (state == to or state == S_JOIN)
            elif symbol in (APOS1, APOS2):  # a contraction only where no run of others and no blank takes the apostrophe
                new = state not in (S_OTHER, S_JOIN)
                to = (C1 if symbol == APOS1 else C2) if new else S_OTHER
            elif symbol == SPACE_MID:
                to, new = S_SPACE, state != S_SPACE
            else:
                to, new = (S_JOIN if symbol == BLANK_LAST else S_LAST), True
            step[state, symbol], begins[state, symbol] = to, new
    return step, begins


def symbols(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """cps: code points of texts, each followed by a slot (its index in ``ends``) that resets the automaton."""
    k = classes()[cps]
    n = len(k)
    k[ends] = RESET
    space = k == SPACE_MID
    nxt_solid = np.zeros(n, bool)
    nxt_solid[:-1] = (k[1:] != SPACE_MID) & (k[1:] != RESET)
    last = space & nxt_solid
    k[last] = np.where(cps[last] == 32, BLANK_LAST, SPACE_LAST)
    apos = np.flatnonzero((cps == 39) & (k == OTHER))
    if len(apos):
        padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
        inside = np.concatenate([k != RESET, np.zeros(2, bool)])
        a, b = np.where(inside[apos + 1], padded[apos + 1], 0), padded[apos + 2]
        b = np.where(inside[apos + 1] & inside[apos + 2], b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(apos), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        k[apos[one]], k[apos[two]] = APOS1, APOS2
    return k


def boundaries(syms: np.ndarray) -> np.ndarray:
    """Where pieces (and resets) begin, by an associative scan of transition functions over blocks."""
    step, begins = automaton()
    n = len(syms)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, RESET, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)  # a row for each place within a block
    flat = step.ravel()
    f = np.tile(np.arange(9, dtype=np.uint8)[:, None], (1, blocks))  # f[s]: the state after the block, begun in s
    for row in grid:
        np.take(flat, f * np.uint8(9) + row, out=f)
    # Exclusive scan of the blocks' functions, by doubling.
    scan, d = f, 1
    while d < blocks:
        later = scan.copy()
        later[:, d:] = np.take_along_axis(scan[:, d:], scan[:, :-d].astype(np.intp), axis=0)  # first the left, then the right
        scan, d = later, 2 * d
    state = np.full(blocks, FRESH, np.uint8)
    state[1:] = scan[FRESH, :-1]
    out, flags = np.empty(grid.shape, bool), begins.ravel()
    for i, row in enumerate(grid):
        at = state * np.uint8(9) + row
        out[i] = flags[at]
        state = flat[at]
    return out.T.ravel()[:n]


def pretokenise(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined (one slot after each), the offsets at which pieces begin (slots included), and the slots."""
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(boundaries(symbols(cps, ends)))
    return joined, starts, ends


class Encoder:
    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank (the leftmost of equals) until none is left; heap, linear space."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= 64:
            parts = [piece[i : i + 1] for i in range(n)]
            got = [ranks.get(parts[i] + parts[i + 1], 1 << 40) for i in range(n - 1)]
            while got and (low := min(got)) < 1 << 40:
                i = got.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del got[i]
                if i < len(got):
                    got[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
                if i:
                    got[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
            return [ranks[p] for p in parts]
        import heapq

        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not live[i] or nxt[i] != j or j >= n or not live[j] or end[j] != e:
                continue
            live[j], end[i], nxt[i] = False, e, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, nxt[i], end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def packed(self, pieces: list[str]) -> list[bytes]:
        cache = self.cache
        try:
            return [cache[p] for p in pieces]
        except KeyError:
            pass
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for p in set(pieces).difference(cache):
            cache[p] = np.array(self.merge(p.encode()), "<u4").tobytes()
        return [cache[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        joined, starts, ends = pretokenise(texts)
        cut = starts.tolist()
        pieces = [joined[i:j] for i, j in zip(cut, cut[1:])] + ["\0"]
        slots = np.searchsorted(starts, ends).tolist()  # the place of each text's slot among the pieces
        out, i = [], 0
        for j in slots:
            out.append(b"".join(self.packed(pieces[i:j])))
            i = j + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each id's bytes begin in the decoded text, and its length at the end."""
        return np.concatenate([[0], np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker, so that its cache lives on from task to task."""
    return Encoder(path)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for b in common.chunks(batches, 2 << 20):
        yield b.column(0), b.column(1).to_pylist()


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit). Null texts count as empty; an empty text has no ids. No shuffle."""

    def run(batches):
        e = encoder(vocabulary)
        for ids, texts in _grouped(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(e.encode(texts), pa.binary())], ["doc_id", "ids"])

    return common.mapped(common.texts(docs), run, "doc_id long, ids binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes the ids, and digests both."""

    def run(batches):
        e = encoder(vocabulary)
        for ids, texts in _grouped(batches):
            packed = e.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(e.decode(p)).hexdigest() for p in packed], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.mapped(common.texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
