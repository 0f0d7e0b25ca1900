"""Statistics over objects: rows (stone_id, equivalent_diameter_m, volume_m3, area_m2, score)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Half-open diameter classes in metres.
BUCKETS = (
    ("small (1.2-1.5m)", 1.2, 1.5),
    ("medium (1.5-2.0m)", 1.5, 2.0),
    ("large (2.0-3.0m)", 2.0, 3.0),
    ("xlarge (>3.0m)", 3.0, 99.0),
)


def measures(rows: DataFrame) -> DataFrame:
    """Defaults applied once: missing measures are 0, a missing score falls back to score_avg, then 1."""
    has = set(rows.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("double")
    out = {c: F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in ("equivalent_diameter_m", "volume_m3", "area_m2")}
    return rows.withColumns(out | {"score": F.coalesce(col("score").cast("double"), col("score_avg").cast("double"), F.lit(1.0))})


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("equivalent_diameter_m > 0 AND volume_m3 >= 0")


def describe(rows: DataFrame) -> DataFrame:
    """One row: min, max, mean, median, std (population) and total of diameter (> 0), volume (>= 0) and area (> 0); 0 where
    nothing counts."""
    out = [F.count("*").alias("n")]
    for name, c, ok in (("diameter", "equivalent_diameter_m", F.col("equivalent_diameter_m") > 0), ("volume", "volume_m3", F.col("volume_m3") >= 0), ("area", "area_m2", F.col("area_m2") > 0)):
        v = F.when(ok, F.col(c))
        for what, e in (("min", F.min(v)), ("max", F.max(v)), ("mean", F.avg(v)), ("median", F.percentile(v, F.lit(0.5))), ("std", F.stddev_pop(v)), ("total", F.sum(v))):
            out.append(F.coalesce(e, F.lit(0.0)).alias(f"{name}_{what}"))
    return rows.agg(*out)


def size_buckets(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """label, n, pct of the valid rows; classes without rows stay."""
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(BUCKETS)], "i int, label string, lo double, hi double")
    d = F.col("equivalent_diameter_m")
    which = F.coalesce(*[F.when((d >= lo) & (d < hi), i) for i, (_, lo, hi) in enumerate(BUCKETS)])
    counts = valid(rows).groupBy(which.alias("i")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return table.join(counts, "i", "left").crossJoin(F.broadcast(total)).select("label", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))).alias("pct"))


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (from 1), lo, hi, n: equal widths over min..max, the last bin closed; equal values share one bin of width 1."""
    edge = rows.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    edge = edge.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).where("lo IS NOT NULL")
    at = F.least(F.width_bucket(F.col(column).cast("double"), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins).cast("long"))
    counts = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = edge.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("lo"), (F.col("lo") + F.col("bin") * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(rows: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, whiskers at the extreme values within 1.5 interquartile ranges, and how many lie beyond."""
    q = rows.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    c, lo, hi = F.col(column), F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")), F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (c >= lo) & (c <= hi)
    return rows.crossJoin(F.broadcast(q)).groupBy("q1", "median", "q3").agg(F.min(F.when(inside, c)).alias("whisker_lo"), F.max(F.when(inside, c)).alias("whisker_hi"), F.count_if(~inside).alias("outliers"))


def outliers(rows: DataFrame, column: str) -> DataFrame:
    b = boxplot(rows, column).select("q1", "q3")
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return rows.crossJoin(F.broadcast(b)).where((F.col(column) < F.col("q1") - reach) | (F.col(column) > F.col("q3") + reach)).drop("q1", "q3")


def cumulative_volume(rows: DataFrame, key: str = "stone_id") -> DataFrame:
    """Running volume and its share of the total from the largest diameter down; ties by ``key``, then by volume, so that the
    rows are the same in every run where keys repeat.

    Ranges of the order are summed first and each range adds what stands before it, so no task sorts the whole table.
    """
    from geomosaic import session

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("equivalent_diameter_m"), F.asc(key), F.asc("volume_m3")]
    dealt = session.written(spark, rows.select(key, "equivalent_diameter_m", "volume_m3").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranked")
    sums = dealt.groupBy("part").agg(F.sum("volume_m3").alias("s"), F.count("*").alias("k"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.sum("s").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("volume_m3").over(own)
    out = dealt.withColumn("r", run).withColumn("k", F.count(F.lit(1)).over(own)).join(F.broadcast(sums), "part")
    running = F.col("r") + F.col("s0")
    return out.select((F.col("k") + F.col("k0")).alias("rank"), key, "equivalent_diameter_m", "volume_m3", running.alias("running"), F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.lit(100.0) * F.try_divide(running, F.col("total"))).alias("pct"))


def cubic_sums(rows: DataFrame, x: str = "equivalent_diameter_m", y: str = "volume_m3") -> DataFrame:
    """One row: count, sums of x^k (k = 1..6) and of x^k y (k = 0..3)."""
    power = lambda k: F.pow(F.col(x), F.lit(float(k))) if k else F.lit(1.0)
    return rows.agg(F.count("*").alias("n"), *[F.sum(power(k)).alias(f"x{k}") for k in range(1, 7)], *[F.sum(power(k) * F.col(y)).alias(f"x{k}y") for k in range(4)])


def cubic_fit(rows: DataFrame, x: str = "equivalent_diameter_m", y: str = "volume_m3") -> list[float] | None:
    """Least-squares cubic, highest power first; None for fewer than four rows. x is centred before the power sums."""
    mean = rows.agg(F.avg(x)).head()[0]
    if mean is None:
        return None
    s = cubic_sums(rows.select((F.col(x) - F.lit(mean)).alias(x), y), x, y).head()
    if s["n"] <= 3:
        return None
    m = [s["n"], *[s[f"x{k}"] for k in range(1, 7)]]
    a = np.array([[m[i + j] for j in range(4)] for i in range(4)], float)
    c = np.linalg.lstsq(a, np.array([s[f"x{k}y"] for k in range(4)], float), rcond=None)[0]
    return np.poly1d(c[::-1])(np.poly1d([1.0, -mean])).c.tolist()


def fit_curve(spark: SparkSession, coefficients: list[float], lo: float, hi: float, n: int = 100) -> DataFrame:
    """n points (x, y) of the fitted curve, evenly spaced over lo..hi."""
    t = F.lit(lo) + F.col("id") * F.lit((hi - lo) / (n - 1))
    y = F.lit(0.0)
    for c in coefficients:
        y = y * t + F.lit(float(c))
    return spark.range(n).select(t.alias("x"), y.alias("y"))


def charts(spark: SparkSession, rows: DataFrame) -> dict[str, DataFrame]:
    """All chart data and the summary by name; empty without valid rows."""
    ok = valid(measures(rows))
    if not ok.limit(1).count():
        return {}
    return {
        "summary": describe(ok), "size_buckets": size_buckets(spark, ok), "diameter_histogram": histogram(ok, "equivalent_diameter_m"), "volume_histogram": histogram(ok, "volume_m3"),
        "cumulative_volume": cumulative_volume(ok), "diameter_box": boxplot(ok, "equivalent_diameter_m"), "volume_box": boxplot(ok, "volume_m3"), "cubic_sums": cubic_sums(ok),
    }
