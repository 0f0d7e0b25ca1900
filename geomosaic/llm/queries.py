"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomosaic import session
from geomosaic.llm import byte_bpe, common, fingerprint, media, packing, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter

#: Rules of op9, as given.
URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    common.small_batches(spark)
    return common.table(spark, sf_dir, "documents")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(spark, _documents(spark, sf_dir))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _documents(spark, sf_dir), session.scratch(spark, "media")
    return media.read_back(media.headers(media.indexed(docs, folder), folder), folder)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = token_counts.by_vocabularies(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.maintained(spark, _documents(spark, sf_dir), session.scratch(spark, "rollup"), count)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(spark, _documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(spark, _documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spark, _documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    return url_filter.judge(common.table(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _documents(spark, sf_dir))


_OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM cut
), hosts AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT h.page_id, h.host, h.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT *, row_number() OVER () AS n FROM hosts) h
  LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
  GROUP BY h.n, h.page_id, h.host, h.path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_media": op2_media,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
}
ORACLES = {
    "op9_url_filter": _OP9_SQL,
}
