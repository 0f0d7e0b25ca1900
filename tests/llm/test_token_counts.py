"""Token counts: rows beside DuckDB and the tokenizers; commits under replays, races and broken compactions."""

import base64
import random
import re
from collections import Counter

import public_tokenizers as p
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from geomosaic import session
from geomosaic.llm import byte_bpe, packing, token_counts
from geomosaic.llm import queries as q
from tests.llm.test_contracts import duck, fixture, put, run

SQL = r"""
WITH d AS (
  SELECT source, lang, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM documents
), c AS (
  SELECT source, lang, 'utf8_bytes_v1' AS tokenizer_version, strlen(t) AS n FROM d WHERE t <> ''
  UNION ALL
  SELECT source, lang, 'space_words_v1', len(string_split(t, ' ')) FROM d WHERE t <> ''
)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    put(d, fixture())
    return d


@pytest.mark.parametrize("where", ["awkward", "whole"])
def test_native_counts_equal_sql(spark, awkward, sf_dir, where):
    d = awkward if where == "awkward" else sf_dir
    cur = duck(d).execute(SQL)
    names = [c[0] for c in cur.description]
    got = token_counts.maintained(spark, spark.read.parquet(f"{d}/documents.parquet"), session.scratch(spark, "rollup"), token_counts.natively).collect()
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(cur.fetchall())


@pytest.mark.parametrize("where", ["awkward", "whole"])
def test_the_query_counts_what_the_tokenizers_count(spark, awkward, sf_dir, where):
    d = awkward if where == "awkward" else sf_dir
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    docs, tokens = Counter(), Counter()
    for r in pq.read_table(f"{d}/documents.parquet", columns=["source", "lang", "text"]).to_pylist():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").strip(" ")
        if t:
            for version, n in (("byte_bpe_multi_50k", len(enc.encode_ordinary(t))), ("word_bpe_49k", len(tok.encode(t, add_special_tokens=False).ids))):
                docs[r["source"], r["lang"], version] += 1
                tokens[r["source"], r["lang"], version] += n
    got = run(spark, "op3_token_counts", d)
    key = lambda r: (r["source"], r["lang"], r["tokenizer_version"])
    assert {key(r): (r["n_docs"], r["n_tokens"]) for r in got} == {k: (docs[k], tokens[k]) for k in docs}
    assert "op3_token_counts" not in q.ORACLES


@pytest.fixture()
def rollup(spark):
    return token_counts.Rollup(spark, session.scratch(spark, "rollup"))


def batch(spark, *rows):
    return spark.createDataFrame([(op, "s", "en", "v", n, old) for op, n, old in rows], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long")


def totals(rollup):
    return [(r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()]


def test_replays_change_nothing_before_and_after_compaction(spark, rollup):
    assert totals(rollup) == []
    one = batch(spark, ("insert", 10, None), ("insert", None, None), ("revise", 7, 10))
    assert rollup.apply("a", one) and not rollup.apply("a", one)
    assert totals(rollup) == [(2, 7)]
    rollup.compact()
    assert not rollup.apply("a", one) and totals(rollup) == [(2, 7)]
    assert rollup.apply("b", batch(spark, ("delete", 7, None), ("delete", 0, None)))
    assert totals(rollup) == []
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == [] and not rollup.apply("b", one)


def test_of_two_writers_one_commits(spark, rollup):
    rows, other = batch(spark, ("insert", 5, None)), token_counts.Rollup(spark, rollup.path)
    staged = rollup._staged
    rollup._staged = lambda sums: other.apply("a", rows) and staged(sums)  # the other comes between the look and the commit
    assert not rollup.apply("a", rows)
    assert totals(rollup) == [(1, 5)] and len(rollup._names("data")) == 1


def test_a_commit_that_was_folded_meanwhile_is_not_counted_twice(spark, rollup):
    rows, other = batch(spark, ("insert", 5, None)), token_counts.Rollup(spark, rollup.path)
    staged = rollup._staged

    def late(sums):
        other.apply("a", rows)
        other.compact()
        return staged(sums)

    rollup._staged = late
    assert not rollup.apply("a", rows) and totals(rollup) == [(1, 5)]


def test_a_compaction_may_end_anywhere(spark, rollup):
    rollup.apply("a", batch(spark, ("insert", 5, None)))
    tidy, rollup._tidy = rollup._tidy, lambda: None
    rollup.compact()  # published, but the batch's files still stand
    assert totals(rollup) == [(1, 5)] and not rollup.apply("a", batch(spark, ("insert", 5, None)))
    rollup._tidy = tidy
    rollup.apply("b", batch(spark, ("insert", 1, None)))
    rollup.compact()
    assert totals(rollup) == [(2, 6)] and rollup._names("open") == [] and rollup._names("folded") == ["a", "b"]


def test_bad_operations_and_names_are_errors(spark, rollup):
    for op in (None, "upsert"):
        with pytest.raises(Exception):
            rollup.apply("x", batch(spark, (op, 1, None)))
    assert not rollup.committed("x")
    with pytest.raises(ValueError):
        rollup.apply("../x", batch(spark, ("insert", 1, None)))
    rollup._create("", "open", "dead")
    with pytest.raises(RuntimeError):
        rollup.totals()


def test_parts_give_the_counts_of_whole_texts(monkeypatch):
    byte_path, word_path = p.path("byte_bpe_multi_50k.tiktoken"), p.path("word_bpe_49k.json")
    own, large, small = token_counts.PartCounts(byte_path, word_path), byte_bpe.Encoder(byte_path), packing.WordIds(word_path)
    rng = random.Random(7)
    some = ["a", "Z", "é", "É,", "'", "s", "'ll", "don't", "1", "日", "\u0301", " ", " ", "\n", "\n", "\t", "\u3000", ".", "!?", "_"]
    monkeypatch.setattr(token_counts, "COUNT_ENTRIES", 150)
    for _ in range(40):
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(20))) for _ in range(100)] + ["", " ", "\n\n", " a\n"]
        clean = [re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ") for t in texts]
        want = [len(x) // 4 for x in large.encode(texts)], [len(x) // 4 for x in large.encode(clean)], [len(i) // 4 for i, _ in small.ids(texts)], [not c for c in clean]
        assert [x.tolist() for x in own.of(texts)] == list(want)


def test_a_part_is_merged_once(monkeypatch):
    own = token_counts.PartCounts(p.path("byte_bpe_multi_50k.tiktoken"), p.path("word_bpe_49k.json"))
    seen, merge = [], own.large.merge
    monkeypatch.setattr(own.large, "merge", lambda piece: seen.append(piece) or merge(piece))
    for _ in range(3):
        own.of(["some words,\nsome words. some\n\nwords"])
    assert len(seen) == len(set(seen))
