"""Media columns: content-addressed payloads in tar shards.

``store`` writes each distinct payload of a task once, as a member named by its whole SHA-256, into tar shards of about
SHARD_BYTES in the shared folder; rows carry digest, shard, offset and length. ``indexed`` keeps these rows as Parquet beside the
shards, so that stored media are found again. ``headers`` fills metadata columns by range reads of a member's first bytes alone,
``read_back`` reads whole members by range and decodes them.

The stored form is an 8-bit grayscale PNG, 64 samples wide (lossless; its deflate stream keeps shards below the payloads'
size). A shard's name is the digest of its members' names, so a task that runs again writes the same file and the same rows;
a file appears by rename, whole or not at all. A payload that several tasks hold is stored once in each of their shards: the
copies are bounded by the number of shards, not of rows, and no payload is ever shuffled. Rows of equal content have equal
digests wherever they lie.

Null payloads are stored as empty ones (64 zero bytes after padding). Empty tables give empty results. Input columns other
than the two named are left out, so that none can clash.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from geomosaic.llm import common

WIDTH = 64
#: Bytes of members after which a shard is closed; only a task's last one is smaller.
SHARD_BYTES = 32 << 20
#: Payloads whose places a task remembers; beyond it, it starts anew and may store a payload again.
KNOWN = 200_000
HEADER_BYTES = 33  # signature and IHDR
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 and zero bytes up to a positive multiple of 64; with the length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 in front of each row
    scan[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height, bit depth from a file's first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, depth = png_header(data[:HEADER_BYTES])
    if (width, depth) != (WIDTH, 8):
        raise ValueError(f"unexpected samples: {width} wide, {depth} bits")
    at, parts = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    scan = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, WIDTH + 1)
    if scan[:, 0].any():
        raise ValueError("unexpected filter")
    return scan[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """A difference hash of the samples: 8 x 9 cell means over the image, a bit for each rise to the right; then mean and
    standard deviation in hundredths. Depends on the samples alone."""
    a = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    rows = np.minimum(np.arange(9) * len(a) // 8, len(a))
    cols = np.arange(10) * WIDTH // 9
    total = np.zeros((len(a) + 1, WIDTH + 1), np.int64)
    total[1:, 1:] = a.cumsum(0, dtype=np.int64).cumsum(1)
    lo, hi = np.minimum(rows[:-1], len(a) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(a) - 1) + 1)
    box = total[hi][:, cols[1:]] - total[hi][:, cols[:-1]] - total[lo][:, cols[1:]] + total[lo][:, cols[:-1]]
    area = (hi - lo)[:, None] * (cols[1:] - cols[:-1])[None, :]
    rise = box[:, 1:] * area[:, :-1] > box[:, :-1] * area[:, 1:]
    bits = np.packbits(rise).tobytes().hex()
    n, s, s2 = a.size, int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum())
    return f"{bits}:{100 * s // n}:{int(10000 * (s2 * n - s * s) // (n * n)) }"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _shard(out: fs.FileSystem, base: str, members: dict[str, bytes]) -> tuple[str, dict[str, tuple[int, int]]]:
    """Write a tar file unless it stands there already; its name, and where each member's bytes lie."""
    name = hashlib.sha256("".join(members).encode()).hexdigest()[:32] + ".tar"
    buf, places = io.BytesIO(), {}
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for digest, data in members.items():
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            places[digest] = (buf.tell() + 512, len(data))
            tar.addfile(info, io.BytesIO(data))
    path = f"{base}/{name}"
    if out.get_file_info(path).type == fs.FileType.NotFound:
        out.create_dir(base, recursive=True)
        part = f"{path}.{hashlib.sha256(np.random.bytes(16)).hexdigest()[:12]}.part"
        with out.open_output_stream(part) as f:
            f.write(buf.getbuffer())
        out.move(part, path)
    return name, places


def store(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes (before padding), digest (of the padded payload), shard, offset, length: one row for each input row.

    ``folder`` is a URI of the shared storage that pyarrow can write (file:, hdfs:, s3: ...).
    """

    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = _open(folder)
        known: dict[str, tuple[str, int, int]] = {}  # of closed shards
        members: dict[str, bytes] = {}
        rows: list[tuple[int, int, str]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal members, rows, size
            if members:
                name, places = _shard(out, base, members)
                if len(known) > KNOWN:
                    known.clear()
                found = known | {d: (name, *p) for d, p in places.items()}
            else:
                found = known
            cols = list(zip(*[(*r, *found[r[2]]) for r in rows]))
            known.update((d, found[d]) for d in members)
            members, rows, size = {}, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in common.chunks(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, n = payload(text)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in known and digest not in members:
                    members[digest] = to_png(data)
                    size += len(members[digest])
                rows.append((doc_id, n, digest))
            if size >= SHARD_BYTES or len(rows) >= KNOWN:
                yield close()
        if rows:
            yield close()

    return common.mapped(common.texts(docs), run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def indexed(docs: DataFrame, folder: str) -> DataFrame:
    """``store``, with its rows written to ``folder``/index and read from there: what is stored stays findable, and no later step
    stores it again."""
    path = f"{folder}/index"
    rows = store(docs, folder)
    rows.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


class _Ranges:
    """Range reads over the shards, the last one kept open."""

    def __init__(self, folder: str):
        self.fs, self.base = _open(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.base}/{shard}")
        return self.file.read_at(n, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def headers(index: DataFrame, folder: str) -> DataFrame:
    """The index rows with width, height and bit_depth, from a range read of 33 bytes for each row."""

    def run(batches):
        ranges = _Ranges(folder)
        for b in batches:
            at = b.schema.get_field_index
            got = [png_header(ranges.read(s, o, HEADER_BYTES)) for s, o in zip(b.column(at("shard")).to_pylist(), b.column(at("offset")).to_pylist())]
            cols = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "width", "height", "bit_depth"])
        ranges.close()

    kinds = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)
    return common.mapped(index, run, f"{kinds}, width int, height int, bit_depth int")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """For each index row (with ``headers``' columns), from the stored bytes: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, height. Checks the payload against its address. One row for each index row, null ids and
    repeats included."""
    out_fields = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height"]

    def run(batches):
        ranges = _Ranges(folder)
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("digest", "shard", "offset", "length", "height")}
            rows, known = [], {}  # within a batch
            for digest, shard, offset, length, height in zip(*cols.values()):
                if digest not in known:
                    media = ranges.read(shard, offset, length)
                    data = from_png(media)
                    found = hashlib.sha256(data).hexdigest()
                    if found != digest or len(data) != WIDTH * height:
                        raise ValueError(f"{shard} at {offset}: content doesn't match its address")
                    known[digest] = (len(data), found, zlib.crc32(data[-64:]), length, hashlib.sha256(media).hexdigest(), feature(data), height)
                rows.append(known[digest])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            done = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("n_bytes")), *done], out_fields)
        ranges.close()

    return common.mapped(index, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int")
