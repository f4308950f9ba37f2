"""Region statistics: partial aggregates over the overlap join, never position by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.model import I32_MAX, I32_MIN, TILE
from tracklake.operators.intervals import overlaps

REGION = ["region_id", "chrom", "begin", "end"]


def per_region(regions: DataFrame, runs: DataFrame, *aggs: Column, by: tuple[str, ...] = (), bin_width: int = TILE) -> DataFrame:
    """Any aggregates of ``value`` and ``w`` per region; regions without data stay, with nulls."""
    return overlaps(regions, runs, bin_width, "left").groupBy(*REGION, *by).agg(*aggs)


def region_sum(regions, runs, bin_width=TILE):
    return per_region(regions, runs, F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0)).cast("long").alias("sum"), bin_width=bin_width)


def region_mean(regions, runs, bin_width=TILE):
    """Mean over the part of each region that lies on its chromosome; 0 where there is none."""
    return per_region(regions, runs, F.coalesce(F.sum(F.col("value") * F.col("w")) / F.sum("w"), F.lit(0.0)).alias("mean"), bin_width=bin_width)


def region_count(regions):
    """Nominal lengths, without looking at data."""
    return regions.withColumn("count", F.col("end") - F.col("begin"))


def region_min_max(regions, runs, bin_width=TILE):
    return per_region(regions, runs, F.coalesce(F.min("value"), F.lit(I32_MAX)).alias("min_value"), F.coalesce(F.max("value"), F.lit(I32_MIN)).alias("max_value"), bin_width=bin_width)


def coverage_above(regions, runs, thresholds: list[int], bin_width=TILE):
    """Share of each region's nominal length with values of at least each threshold, as stored."""
    n = F.col("end") - F.col("begin")
    return per_region(regions, runs, *[F.coalesce(F.sum(F.when(F.col("value") >= t, F.col("w"))), F.lit(0)).alias(f"_{t}") for t in thresholds], bin_width=bin_width).select(*REGION, *[(F.col(f"_{t}") / n).alias(f"cov_{t}") for t in thresholds])


def by_track(regions, runs, tracks: list[str], kind: str = "mean", bin_width=TILE):
    """A scalar statistic of every track, one column each."""
    one = {"mean": lambda v: F.coalesce(F.sum(v * F.col("w")) / F.sum(F.when(v.isNotNull(), F.col("w"))), F.lit(0.0)), "sum": lambda v: F.coalesce(F.sum(v * F.col("w")), F.lit(0)).cast("long")}[kind]
    return per_region(regions, runs, *[one(F.when(F.col("track") == t, F.col("value"))).alias(t) for t in tracks], bin_width=bin_width)


def value_counts(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positions per value."""
    return runs.groupBy(*by, "value").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("n"))


def histogram(runs: DataFrame, low: int = 0, high: int = 1000) -> DataFrame:
    """``(bucket, n)`` for every value of ``[low, high)``, zeros too, with ``below`` and ``above``; counts are positions."""
    counts = value_counts(runs)
    spark = runs.sparkSession
    inside = spark.range(low, high).select(F.col("id").cast("int").alias("value")).join(counts, "value", "left").select(F.col("value").cast("string").alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rest = counts.agg(F.coalesce(F.sum(F.when(F.col("value") < low, F.col("n"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("value") >= high, F.col("n"))), F.lit(0)).alias("above"))
    return inside.unionByName(rest.select(F.explode(F.array(F.struct(F.lit("below").alias("bucket"), F.col("below").alias("n")), F.struct(F.lit("above").alias("bucket"), F.col("above").alias("n")))).alias("s")).select("s.*"))


def region_histogram(regions, runs, low: int = 0, high: int = 1000, bin_width=TILE):
    """Positions below, inside and above the range, per region."""
    v, w = F.col("value"), F.col("w")
    part = lambda c, name: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("long").alias(name)
    return per_region(regions, runs, part(v < low, "below"), part((v >= low) & (v < high), "inside"), part(v >= high, "above"), bin_width=bin_width)


def region_percentile(regions, runs, p: float, mode: str = "exact", high: int = 1000, bin_width=TILE):
    """The ``p`` quantile per region.

    ``exact`` is the least value that at least ``ceil(p * n)`` positions don't exceed (of
    an empty region: null). ``compat`` is one more than the value whose cumulated count reaches
    ``round(p * n)``, in a histogram of ``[0, high)``, 0 if what lies below suffices.
    """
    counts = overlaps(regions, runs, bin_width, "left").groupBy(*REGION, "value").agg(F.sum("w").alias("n"))
    key = Window.partitionBy("region_id")
    cum = counts.withColumn("cum", F.sum("n").over(key.orderBy("value"))).withColumn("total", F.sum("n").over(key))
    if mode == "exact":
        hit = F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * F.lit(p)), F.col("value")))
        return cum.groupBy(*REGION).agg(hit.alias("percentile"))
    target = F.round(F.col("total") * F.lit(p))
    below = F.coalesce(F.max(F.when(F.col("value") < 0, F.col("cum"))), F.lit(0))
    hit = F.min(F.when((F.col("value") >= 0) & (F.col("value") < high) & (F.col("cum") >= target), F.col("value") + 1))
    return cum.groupBy(*REGION).agg(F.when(below >= F.coalesce(F.max(target), F.lit(0)), 0).otherwise(F.coalesce(hit, F.lit(high))).cast("int").alias("percentile"))


def moments(runs: DataFrame, by: tuple[str, ...] = (), low: int = 0, high: int = 1000) -> DataFrame:
    """Mean and population deviation of values inside the range, over all positions."""
    w, v = (F.col("end") - F.col("begin")).cast("double"), F.when((F.col("value") >= low) & (F.col("value") < high), F.col("value")).cast("double")
    s = runs.groupBy(*by).agg(F.sum(w).alias("n"), F.coalesce(F.sum(v * w), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(v * v * w), F.lit(0.0)).alias("s2"))
    mean = F.col("s1") / F.col("n")
    return s.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def share_below(runs: DataFrame, value: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentage of positions whose value is at most ``value``."""
    w = F.col("end") - F.col("begin")
    return runs.groupBy(*by).agg((F.lit(100.0) * F.coalesce(F.sum(F.when(F.col("value") <= value, w)), F.lit(0)) / F.sum(w)).alias("percent"))


def total_coverage(runs: DataFrame) -> DataFrame:
    w = F.col("end") - F.col("begin")
    return runs.agg((F.sum(F.col("value") * w) / F.sum(w)).alias("coverage"), F.sum(w).cast("long").alias("positions"))
