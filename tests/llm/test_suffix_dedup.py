"""The run-length index and the routing of hot anchors beside brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import common, suffix_dedup
from tests.llm.test_contracts import prose, repeats


def longest(strings):
    """For each position of each string the longest match with any other position, within the strings."""
    places = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    out = []
    for k, i in places:
        best = 0
        for m, j in places:
            if (m, j) != (k, i):
                n = 0
                while i + n < len(strings[k]) and j + n < len(strings[m]) and strings[k][i + n] == strings[m][j + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


def test_matching_statistics_of_the_index():
    rng = random.Random(8)
    for _ in range(25):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        strings = list(dict.fromkeys([*strings, strings[0] + strings[-1]]))
        times = [rng.choice([1, 1, 2]) for _ in strings]
        index = suffix_dedup.RunLengthIndex(strings, times)
        got = index.matching_statistics()
        want = longest([s for s, n in zip(strings, times) for _ in range(n)])
        at = 0
        for s, n, b in zip(strings, times, index.begin.tolist()):
            assert got[b : b + len(s)].tolist() == want[at : at + len(s)]
            at += n * len(s)
        assert index.n_runs <= len(index.text)


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.removed(spark, docs).collect()
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def want(rows):
    return Counter((i, *x) for (i, _), x in zip(rows, repeats([(t or "").encode() for _, t in rows])))


def test_hot_anchors_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rng = random.Random(11)
    passage, other = prose(rng, 50), prose(rng, 45)
    rows = [(i, f"{prose(rng, rng.randrange(20, 60))} {passage[: rng.randrange(210, len(passage))]} {prose(rng, 30)}") for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 9)} {other} {prose(rng, 9)} {other} {passage[30:]}") for i in range(12)]
    rows += [(200, "ab" * 700), (201, "x" + "ab" * 300 + "y"), (202, "é" * 400 + passage), (203, "é" * 300), (204, passage), (204, passage), (205, None)]
    assert removed(spark, rows) == want(rows)


def test_many_identical_rows(spark):
    rng = random.Random(12)
    text = prose(rng, 80)
    rows = [(7, text)] * 10_000 + [(8, f"{text[100:]} tail"), (9, prose(rng, 80)), (None, text)]
    got = removed(spark, rows)
    n = len(text.encode())
    assert sum(v for (i, size, gone, spans, _), v in got.items() if i in (7, None) and (size, gone, spans) == (n, n, 1)) == 10_001
    assert [gone for (i, _, gone, _, _) in got if i == 8] == [len(text.encode()) - 100]
    assert [gone for (i, _, gone, _, _) in got if i == 9] == [0]


def test_cores_hold_every_window_once():
    rng = random.Random(13)
    text = bytes(rng.choice(b"abcd ") for _ in range(1500))
    owner, start, count, anchor, _, _ = suffix_dedup.scan([text])
    rows = list(zip(start.tolist(), count.tolist(), anchor.tolist(), [0] * len(start)))
    for step in suffix_dedup.CORES:
        parts = suffix_dedup.cores(text, rows, step)
        covered = np.zeros(len(text), int)
        for _, ws, wn, _, _ in parts:
            assert wn <= step
            covered[ws : ws + wn] += 1
        assert covered[: len(text) - suffix_dedup.LENGTH + 1].tolist() == [1] * (len(text) - suffix_dedup.LENGTH + 1)


def test_bodies_of_an_anchor_meet_in_one_task_after_a_join(spark):
    """A join by h that turns into a broadcast at run time: its own shuffle is then read by map task."""
    session.ship(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    bodies = spark.range(0, 8000, 1, 6).select((F.col("id") % 1000).alias("h"), F.col("id").alias("c"), F.lit(1).alias("n"), F.lit(b"x" * 300).alias("body"))
    keys = session.written(spark, spark.range(0, 5000, 1, 4).select(F.col("id").alias("h"), (F.col("id") % 1000 == 7).alias("hot")), "keys")

    def anchors(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["h"])

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = session.written(spark, bodies, "bodies").join(keys.where("hot").select("h"), "h", "left_anti")
        seen = common.mapped(suffix_dedup._together(joined, 8), anchors, "h long").select("h", F.spark_partition_id().alias("task"))
        seen = session.written(spark, seen, "seen")
        assert seen.count() == 8000 - 5 * 8 + 4 * 8
        assert seen.groupBy("h").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_texts_are_scanned_once(spark, monkeypatch):
    runs, seen = suffix_dedup._runs, spark.sparkContext.accumulator(0)

    def counted(docs):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = runs(docs)
        return df.mapInArrow(run, df.schema)

    docs = spark.createDataFrame([(i, f"{i} " + "the same words in every text, " * 10) for i in range(20)], "doc_id long, text string")
    once = runs(suffix_dedup._keyed(docs)).count()
    monkeypatch.setattr(suffix_dedup, "_runs", counted)
    assert suffix_dedup.removed(spark, docs).where("n_removed > 0").count() == 20
    assert 0 < once == seen.value
