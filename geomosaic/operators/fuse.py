"""Fusing overlapping detections into objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic.functions.geo import numbered
from geomosaic.operators.graph import connected_components, pivot_clusters
from geomosaic.operators.spatial_join import CorrelationConfig, HeuristicConfig, affinity_edges, heuristic_edges


def heuristic_labels(spark: SparkSession, det: DataFrame, cfg: HeuristicConfig = HeuristicConfig()) -> DataFrame:
    """det_idx, label: connected components of close, overlapping detections; alone, a detection is its own label."""
    found = connected_components(spark, heuristic_edges(det, cfg).select("src", "dst"))
    return det.select("det_idx").join(found.withColumnRenamed("node", "det_idx"), "det_idx", "left").select("det_idx", F.coalesce("component", "det_idx").alias("label"))


def correlation_labels(spark: SparkSession, det: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """det_idx, label: pivot clusters over positive affinities."""
    found = pivot_clusters(spark, det.select(F.col("det_idx").alias("node")), affinity_edges(det, cfg).select("src", "dst"))
    return found.select(F.col("node").alias("det_idx"), F.col("pivot").alias("label"))


METHODS = {"heuristic": heuristic_labels, "correlation_clustering": correlation_labels}


def labels(spark: SparkSession, det: DataFrame, method: str) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown fusion method {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](spark, det)


def stones(det: DataFrame, labelled: DataFrame, method: str) -> DataFrame:
    """One row for each label: counts, scores, the union of boxes, members in order. ``label`` is the smallest member, so
    objects stand in its order; ``with_ids`` numbers them where consecutive ids are wanted."""
    return (
        det.join(labelled, "det_idx")
        .groupBy("label")
        .agg(
            F.lit(method).alias("merge_method"), F.count("*").alias("source_detection_count"), F.count_distinct(F.coalesce("source_patch_id", F.lit(""))).alias("source_patches_span"),
            F.avg("score").alias("score_mean"), F.max("score").alias("score_max"),
            F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
            F.sort_array(F.collect_list("det_idx")).alias("detection_indices"),
        )
    )


def with_ids(found: DataFrame) -> DataFrame:
    """stone_id (``stone_000000`` on) in order of labels: ranges are counted first, then numbered side by side."""
    spark = found.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("label").repartitionByRange(n, "label").withColumn("part", F.spark_partition_id())
    from pyspark.sql import Window

    from geomosaic import session

    dealt = session.written(spark, dealt, "ordered")  # the ranges stay as they are from here on
    sizes = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each range
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("label"))).join(F.broadcast(sizes), "part")
    return found.join(ranked.select("label", (F.col("k") - 1 + F.coalesce("before", F.lit(0))).alias("si")), "label").withColumn("stone_id", numbered("stone", F.col("si")))


def fusion_summary(found: DataFrame, source: str, method: str) -> DataFrame:
    """One row: detections in, objects out, share merged, group sizes (null without groups)."""
    n = F.coalesce(F.sum("source_detection_count"), F.lit(0)).cast("long")
    return found.agg(
        F.lit(source).alias("source"), F.lit(method).alias("method"), n.alias("input_detections"), F.count("*").alias("output_stones"),
        (F.lit(1.0) - F.count("*") / F.greatest(n, F.lit(1))).alias("merge_ratio"),
        F.min("source_detection_count").alias("min_group"), F.max("source_detection_count").alias("max_group"), F.avg("source_detection_count").alias("mean_group"),
    )


def members(found: DataFrame, det: DataFrame) -> DataFrame:
    """label, det_idx and the detection's columns: objects exploded and joined back; unknown indices are dropped."""
    return found.select("label", F.explode("detection_indices").alias("det_idx")).join(det, "det_idx")


def compare(a: DataFrame, b: DataFrame, key: str = "source") -> DataFrame:
    """Two methods' summaries side by side by source; a source that one lacks stays."""
    pick = lambda d, p: d.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("output_stones", "merge_ratio", "max_group")])
    return pick(a, "a").join(pick(b, "b"), key, "full_outer")
