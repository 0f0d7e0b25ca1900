"""From raw documents to packed sequences: drop toxic and poor documents, keep one of each group of near copies, cut passages
that repeat, pack what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and reads
again as the next one's docs. All but the last return the columns of ``documents``. Null texts count as empty; tables without
rows give tables without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomosaic import session
from geomosaic.llm import common, packing, quality, simhash, suffix_dedup, toxicity


def _ready(spark: SparkSession) -> None:
    session.ship(spark)
    common.small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones among them, scores below its threshold."""
    _ready(spark)
    model = toxicity.train(spark, docs, common.table(spark, sf_dir, "labels"), toxicity.fold(3) != 1)
    return toxicity.kept(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, scores at a half or more."""
    _ready(spark)
    labels = common.table(spark, sf_dir, "labels")
    model = quality.train(spark, quality.vectors(docs), labels, toxicity.fold(4) != 2)
    return quality.kept(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    _ready(spark)
    return simhash.deduplicated(spark, docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings of 200 bytes that stand anywhere else among them."""
    _ready(spark)
    return suffix_dedup.cleaned(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    _ready(spark)
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that are left of ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
