"""The corpus pipeline: each stage's decisions beside the rows that it read."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from geomosaic import session
from geomosaic.llm import suffix_dedup
from tests.llm.test_contracts import check_packed, put, repeats

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = session.written(spark, stage(spark, docs, D), name)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_columns_stay_and_rows_only_go(steps):
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == before.columns
        assert set(rows(after)) <= set(rows(before)) and after.count() > 0


def test_toxic_and_poor_documents_go_and_clean_ones_stay(spark):
    d = "/root/testdata/sf0.01"  # the smaller table has 11 toxic documents in all, too few to learn from
    labels = {r["doc_id"]: r for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clear = session.written(spark, corpus_pipeline.drop_toxic(spark, docs, d), "clear")
    good = session.written(spark, corpus_pipeline.drop_poor(spark, clear, d), "good")
    first, second, third = (set(rows(s)) for s in (docs, clear, good))
    toxic, clean = ([i for i in first if i in labels and labels[i]["toxic"] == y] for y in (1, 0))
    caught, stayed = sum(i not in second for i in toxic) / len(toxic), sum(i in second for i in clean) / len(clean)
    fine = [i for i in second if i in labels and labels[i]["quality"] == 1]
    passed = sum(i in third for i in fine) / len(fine)
    assert caught >= 0.7 and stayed >= 0.97 and passed >= 0.9, (caught, stayed, passed)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_of_near_copies_stays(steps):
    before, after = rows(steps[2]), rows(steps[3])
    sets = {i: shingles(t) for i, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    gone = sorted(set(before) - set(after))
    for i in gone:  # nothing goes that has no copy in reach among what it was grouped with
        assert max((alike(i, j) for j in before if j != i), default=0) >= 0.6 or not sets[i]
    kept = sorted(after)
    missed = [(a, b) for n, a in enumerate(kept) for b in kept[:n] if alike(a, b) >= 0.85]
    assert not missed


def test_repeats_are_cut(steps):
    before, after = rows(steps[3]), rows(steps[4])
    ids = sorted(before)
    marks = repeats([before[i].encode() for i in ids])
    for i, (_, removed, _, _) in zip(ids, marks):
        if not removed and before[i]:
            assert after[i] == before[i]
        elif i in after:
            assert len(after[i].encode()) < len(before[i].encode())


def test_what_is_left_is_packed(steps):
    check_packed([r.asDict() for r in steps[5].collect()], sorted(rows(steps[4]).items()))


def test_awkward_rows_and_empty_tables_pass(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    put(d, [(1, None), (2, ""), (2, ""), (None, "some words without an id stand here"), (5, "x" * 20_000), (6, "plain words make a text of some length here")])
    corpus_pipeline.run(spark, d).collect()
    e = str(tmp_path_factory.mktemp("none"))
    put(e, [])
    assert corpus_pipeline.run(spark, e).count() == 0


def test_cut_texts_are_whole_code_points(spark):
    shared = "é漢" * 60
    docs = spark.createDataFrame([(1, f"aa {shared}"), (2, f"{shared} bb"), (3, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cleaned(spark, docs).collect()}
    assert got[3] == "alone" and all(t.encode().decode() == t for t in got.values())
    assert pa.array(list(got.values())).null_count == 0
