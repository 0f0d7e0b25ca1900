"""Near copies by exact Jaccard similarity: none at the bound is lost, none below it goes."""

import random

from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.llm import simhash
from tests.llm.test_pipeline import shingles


def pair(rng, size, shared):
    """Two texts with the first ``shared`` five-word shingles in common, of ``size`` shingles each."""
    word = lambda: f"w{rng.randrange(10**9)}"
    head = [word() for _ in range(shared + 4)]
    return tuple(" ".join(head + [word() for _ in range(size - shared)]) for _ in range(2))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def left(spark, pairs):
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in simhash.deduplicated(spark, docs).collect()}


def test_no_pair_from_the_bound_on_is_lost(spark):
    rng = random.Random(1)
    pairs = [pair(rng, size, shared) for size, shared in [(9, 8), (90, 80), (180, 160), (270, 240), (100, 90)] for _ in range(60)]
    assert min(jaccard(*p) for p in pairs) == 0.8
    assert left(spark, pairs) == {2 * i for i in range(len(pairs))}


def test_no_pair_below_the_bound_goes(spark):
    rng = random.Random(2)
    pairs = [pair(rng, size, shared) for size, shared in [(10, 8), (60, 51), (200, 177), (30, 26)] for _ in range(80)]
    assert 0.66 < min(jaccard(*p) for p in pairs) and max(jaccard(*p) for p in pairs) < 0.8
    assert left(spark, pairs) == set(range(2 * len(pairs)))


def test_repeated_and_missing_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (3, d), (None, d), (None, "only here and without an id"), (None, "only here and without an id"), (None, None), (7, ""), (None, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicated(spark, docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (None, "only here and without an id"), (7, "")], key=str)


def test_distinct_shingles_tell_apart_what_words_tell_apart():
    rng = random.Random(3)
    texts = ["", " \t", "a", "A", "a b", "b a", "a b c d e", "a b c d e f", "\n a  b\tc d E f ", "é É x", "a" * 3000, "ab c", "a bc"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    got = simhash.distinct_shingles(texts, 5)
    ascii_lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    words = [ascii_lower(t).split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    for g, w in zip(got, want):
        assert len(g) == len(w) and sorted(g.tolist()) == g.tolist()
    for a in range(len(texts)):
        for b in range(a):
            assert len(set(got[a].tolist()) & set(got[b].tolist())) == len(want[a] & want[b])
    assert [g.tolist() for t in texts for g in simhash.distinct_shingles([t], 5)] == [g.tolist() for g in got]


def test_the_filter_lets_pairs_of_the_similarity_pass(spark):
    rng = random.Random(4)
    pairs = [pair(rng, size, shared) for size, shared in [(90, 80), (180, 160), (270, 240), (1800, 1600)] for _ in range(50)]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    sets = simhash.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5).cache()
    node = {r["doc_id"]: r["node"] for r in sets.collect()}
    both = spark.createDataFrame([(node[2 * i], node[2 * j + 1]) for i in range(200) for j in (i, (i + 7) % 200)], "src long, dst long")
    left = {(r["src"], r["dst"]) for r in simhash.in_reach(spark, both, sets.select("node", "n", "fp"), 0.8).collect()}
    assert left == {(node[2 * i], node[2 * i + 1]) for i in range(200)}


def test_a_sieve_passes_every_key_and_few_others(spark):
    keys = spark.range(0, 40_000, 4).selectExpr("xxhash64(id) AS key")
    passes = simhash.sieve(keys, 10_000)
    left = {r["id"] for r in spark.range(40_000).where(passes(F.xxhash64("id"))).collect()}
    assert left >= set(range(0, 40_000, 4)) and len(left) < 13_000
    assert not spark.range(9).where(simhash.sieve(keys.where("false"), 0)(F.xxhash64("id"))).count()


def test_a_large_group_makes_no_pair_of_each_neighbour_and_member(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(154)]

    def changed(places):
        w = list(base)
        for i in places:
            w[i] = f"w{rng.randrange(10**9)}"
        return " ".join(w)

    members = [changed([rng.randrange(60, 150)]) for _ in range(300)]  # 0.87 or more with each other
    near = [changed([rng.randrange(5, 20), rng.randrange(30, 45), rng.randrange(70, 140)]) for _ in range(40)]  # 0.8 with few members
    far = [changed([rng.randrange(5, 15), rng.randrange(22, 32), rng.randrange(40, 50)]) for _ in range(80)]  # just below it with all
    docs = spark.createDataFrame(list(enumerate(members + near + far)), "doc_id long, text string")
    rows, written = [], session.written

    def counted(spark, df, name):
        out = written(spark, df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(session, "written", counted)
    got = {r["doc_id"] for r in simhash.deduplicated(spark, docs).collect()}
    sets = [shingles(t) for t in members + near + far]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    assert got == {root.index(r) for r in set(root)} and 60 < len(got) < 100
    assert max(n for name, n in rows if name in ("candidates", "in-reach")) < 4000, rows
