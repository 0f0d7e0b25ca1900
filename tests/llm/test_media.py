"""Media shards: addresses, header reads, features, damage."""

import hashlib
import io
import tarfile

import numpy as np
import pytest
from pyarrow import fs

from geomosaic import session
from geomosaic.llm import media


@pytest.fixture()
def folder(spark):
    return session.scratch(spark, "media-test")


def files(folder, end):
    out, base = fs.FileSystem.from_uri(folder)
    return out, [f.path for f in out.get_file_info(fs.FileSelector(base)) if f.path.endswith(end)]


def test_members_are_addressed_by_their_whole_digest(spark, folder):
    rows = [(i, f"text {i % 7}") for i in range(50)] + [(None, None), (99, ""), (99, "")]
    index = media.indexed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), folder)
    out, tars = files(folder, ".tar")
    assert len(tars) == 1 and index.count() == len(rows)
    held = {}
    with tarfile.open(fileobj=io.BytesIO(out.open_input_file(tars[0]).read())) as tar:
        for m in tar.getmembers():
            held[m.name.removesuffix(".png")] = tar.extractfile(m).read()
    assert len(held) == 8
    for r in index.collect():
        data = held[r["digest"]]
        assert hashlib.sha256(media.from_png(data)).hexdigest() == r["digest"] and len(data) == r["length"]
        assert out.open_input_file(tars[0]).read_at(r["length"], r["offset"]) == data


def test_shards_are_closed_by_bytes(spark, folder, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.bytes(3000).hex()) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert media.store(docs, folder).count() == 3000
    out, tars = files(folder, ".tar")
    sizes = [out.get_file_info(t).size for t in tars]
    assert len(tars) <= 2 and sum(sizes) > 5 << 20  # 2000 rows make a batch, but not a shard


def test_headers_come_from_the_first_bytes(spark, folder):
    docs = spark.createDataFrame([(1, "a" * 640), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["width"], r["height"], r["bit_depth"]) for r in media.headers(media.indexed(docs, folder), folder).collect()}
    assert got == {1: (64, 10, 8), 2: (64, 1, 8)}
    with pytest.raises(ValueError):
        media.png_header(b"x" * 33)


def test_damage_is_told():
    whole = media.to_png(media.payload("some text")[0])
    for at in (20, 45, len(whole) - 20):
        broken = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
        with pytest.raises(Exception):
            media.from_png(broken)


def slow_feature(data):
    a = np.frombuffer(data, np.uint8).reshape(-1, 64).astype(int)
    n = len(a)
    bits = ""
    for i in range(8):
        top = min(i * n // 8, n - 1)
        end = max(min((i + 1) * n // 8, n), top + 1)
        means = [sum(int(v) for row in a[top:end] for v in row[j * 64 // 9 : (j + 1) * 64 // 9]) / ((end - top) * ((j + 1) * 64 // 9 - j * 64 // 9)) for j in range(9)]
        bits += "".join(str(int(y > x)) for x, y in zip(means, means[1:]))
    v = a.ravel()
    total, squares = int(v.sum()), int((v * v).sum())
    return f"{int(bits, 2):016x}:{100 * total // len(v)}:{10000 * (squares * len(v) - total * total) // len(v) ** 2}"


def test_the_feature_beside_plain_loops():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 8, 30):
        data = rng.integers(0, 255, 64 * n).astype(np.uint8).tobytes()
        assert media.feature(data) == slow_feature(data)
