"""Fingerprints beside an independent computation: sums of paragraph hashes, shingle counts, the order of the chain."""

import hashlib
import random
from collections import Counter

import numpy as np

from geomosaic.llm import fingerprint
from tests.llm.test_contracts import prose, sha


def counts(text):
    out = Counter()
    for p in text.split("\n"):
        w = p.split()
        if w:
            w += [""] * (5 - len(w))
            out.update(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return out


def lanes(text):
    total = np.zeros(8, np.uint64)
    for p in text.split("\n"):
        total += np.frombuffer(hashlib.blake2b(p.encode(), digest_size=64).digest(), "<u8")
    return total


def test_lanes_are_sums_over_paragraphs_and_likeness_is_the_shingles():
    rng = random.Random(6)
    base = [prose(rng, 300) for _ in range(20)]
    texts = base + [t.replace("river", "rivers") for t in base] + ["", "one", "\n\n"]
    got = fingerprint.vectors(texts)
    assert [x.tolist() for x in got[0]] == [lanes(t).tolist() for t in texts]
    for a, b in [(i, j) for i in range(len(texts)) for j in range(i)][::7]:
        x, y = counts(texts[a]), counts(texts[b])
        both = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
        true = 1 - sum((x[s] - y[s]) ** 2 for s in x | y) / both if both else 0.0
        pick = lambda i: tuple(v[i : i + 1] for v in got)
        found = float(fingerprint.likeness(pick(a), pick(b))[0])
        if (lanes(texts[a]) == lanes(texts[b])).all():
            assert found == 1
        else:
            assert abs(found - max(0.0, true)) <= 0.35, (found, true)


def test_insert_and_delete():
    rng = random.Random(7)
    one, two = prose(rng, 50).replace("\n", " "), prose(rng, 70).replace("\n", " ")
    whole, a, b = (fingerprint.vectors([t]) for t in (f"{one}\n{two}", one, two))
    for x, y in ((fingerprint.combine(a, b), whole), (fingerprint.combine(whole, b, -1), a)):
        assert all((p == q).all() for p, q in zip(x, y))


def test_repeated_paragraphs_do_not_wrap():
    line = "five words in one line"
    found = [float(fingerprint.likeness(*(fingerprint.vectors(["\n".join([line] * n)]) for n in (k, k // 2)))[0]) for k in (400, 4000, 80_000)]
    assert all(abs(f - 0.8) < 1e-9 for f in found), found


def test_the_chain_over_null_and_repeated_ids(spark):
    rng = random.Random(9)
    rows = [(None, prose(rng, 20)) for _ in range(300)] + [(5, prose(rng, 20)) for _ in range(200)] + [(i, prose(rng, 12)) for i in range(20, 60)] + [(3, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from pyspark.sql import functions as F

    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"], r["h"]), reverse=True)
    want = Counter()
    for r, n in zip(order, order[1:] + order[:1]):
        k = len(r["t"]) // 2
        edited = r["t"][: len(r["t"]) - k] + n["t"][:k]
        want[r["doc_id"], len(r["t"]), sha(edited.encode()), fingerprint.hexed(*fingerprint.vectors([r["t"]]))[0], fingerprint.hexed(*fingerprint.vectors([edited]))[0]] += 1
    got = fingerprint.edited(spark, docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want


def test_hot_ids_are_parted(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(4000)], "doc_id long, text string")
    sizes = [r["count"] for r in fingerprint._next_of(spark, docs).where("not tail").groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000
