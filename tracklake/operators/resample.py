"""Down-sampling: equal bins, plot bins, server bins, and windows compared across tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.model import INDEX_BIN, TILE
from tracklake.operators.stats import by_track, region_mean, region_percentile


def _bins(regions: DataFrame, step) -> DataFrame:
    """Bins of ``step`` positions from each region's start; the last one may be short."""
    parts = regions.withColumnRenamed("region_id", "source_id").withColumn("_b", F.explode(F.sequence(F.col("begin"), F.col("end") - 1, step)))
    return parts.select("source_id", "chrom", F.col("_b").alias("begin"), F.least(F.col("_b") + step, F.col("end")).alias("end"), F.floor((F.col("_b") - F.col("begin")) / step).cast("long").alias("bin")).withColumn("region_id", F.xxhash64("source_id", "bin"))


def tumbling(regions: DataFrame, width: int) -> DataFrame:
    return _bins(regions, F.lit(width).cast("long"))


def adjusted(width: int) -> int:
    """A width that the index's bins divide."""
    return max(INDEX_BIN, width // INDEX_BIN * INDEX_BIN)


def resampled(regions: DataFrame, runs: DataFrame, width: int, kind: str = "mean", bin_width: int = TILE) -> DataFrame:
    bins = tumbling(regions, width)
    stat = region_mean(bins, runs, bin_width) if kind == "mean" else region_percentile(bins, runs, 0.5, bin_width=bin_width).withColumnRenamed("percentile", "median")
    return bins.select("region_id", "source_id", "bin").join(stat, "region_id").select("source_id", "bin", "chrom", "begin", "end", kind)


def plot_bins(regions: DataFrame, runs: DataFrame, n: int = 256, bin_width: int = TILE) -> DataFrame:
    """``n`` bins over ``end - begin + 1`` places, the remainder spread over the first ones, with their middles."""
    size = F.col("end") - F.col("begin") + 1
    each, more = F.floor(size / n).cast("long"), (size % n).cast("long")
    start = lambda i: F.col("begin") + i * each + F.least(i, more)
    bins = regions.withColumnRenamed("region_id", "source_id").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    bins = bins.select("source_id", "chrom", "bin", start(F.col("bin")).alias("_l"), start(F.col("bin") + 1).alias("_r")).where("_l < _r")
    bins = bins.select(F.xxhash64("source_id", "bin").alias("region_id"), "source_id", "bin", "chrom", F.col("_l").alias("begin"), F.col("_r").alias("end"))
    stat = region_mean(bins, runs, bin_width).select("region_id", "mean")
    return bins.join(stat, "region_id").select("source_id", "bin", F.floor((F.col("begin") + F.col("end")) / 2).cast("long").alias("x"), F.col("mean").alias("y"))


def server_bins(regions: DataFrame, runs: DataFrame, most: int = 1000, bin_width: int = TILE) -> DataFrame:
    """At most ``most`` bins of equal width per region."""
    step = F.greatest(F.lit(1).cast("long"), F.floor((F.col("end") - F.col("begin") + most - 1) / most).cast("long"))
    bins = _bins(regions, step)
    return bins.select("region_id", "source_id", "bin").join(region_mean(bins, runs, bin_width), "region_id").select("source_id", "bin", "begin", "end", "mean")


def deletion_windows(regions: DataFrame, runs: DataFrame, child: str, parents: list[str], width: int, near: float = 0.2, low: float = 0.2, bin_width: int = TILE) -> DataFrame:
    """Per region, how many bins have the child's depth below ``low`` of its chromosome's mean while both parents' are within ``near`` of theirs.

    The chromosomes' means, a row each, are broadcast, so no task gets all bins of one.
    """
    tracks = [child, *parents]
    w = F.col("end") - F.col("begin")
    usual = runs.groupBy("chrom").agg(*[(F.sum(F.when(F.col("track") == t, F.col("value") * w)) / F.sum(F.when(F.col("track") == t, w))).alias(f"usual_{i}") for i, t in enumerate(tracks)])
    bins = tumbling(regions, width)
    means = by_track(bins, runs, tracks, "mean", bin_width).join(F.broadcast(usual), "chrom", "left").join(bins.select("region_id", "source_id"), "region_id")
    ratio = [F.col(t) / F.col(f"usual_{i}") for i, t in enumerate(tracks)]
    hit = ratio[0] < low
    for r in ratio[1:]:
        hit = hit & (F.abs(r - 1) < near)
    return means.groupBy("source_id").agg(F.count("*").alias("bins"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits")).withColumn("is_candidate", F.col("hits") > 0.8 * F.col("bins"))
