"""The pre-aggregated sum index: sums of fixed bins, used for whole bins inside a region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.model import INDEX_BIN, TILE
from tracklake.operators.intervals import div, overlaps
from tracklake.operators.stats import REGION


def build(runs: DataFrame, width: int = INDEX_BIN, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """``(keys, bin, begin, end, sum)``; runs are cut at bin borders, and sums are partial before the shuffle."""
    cut = runs.withColumn("bin", F.explode(F.sequence(div("begin", width), div(F.col("end") - 1, width))))
    to = F.least("end", (F.col("bin") + 1) * width)
    w = to - F.greatest("begin", F.col("bin") * width)
    sums = cut.groupBy(*keys, "bin").agg(F.sum((F.col("value") * w).cast("double")).alias("sum"), F.max(to).alias("end"))
    return sums.select(*keys, "bin", (F.col("bin") * width).alias("begin"), "end", "sum")


def query(regions: DataFrame, runs: DataFrame, index: DataFrame, width: int = INDEX_BIN, bin_width: int = TILE) -> DataFrame:
    """Sum and mean of each region: whole bins from the index, the two ragged edges from runs.

    A region inside one bin is read from runs alone. The mean divides by the length on the chromosome.
    """
    low, high = F.ceil(F.col("begin") / width).cast("long") * width, div("end", width) * width
    r = regions.withColumn("_c", low).withColumn("_f", high)
    whole = r.where("_c < _f").select("region_id", "chrom", F.explode(F.sequence(div("_c", width), div(F.col("_f") - 1, width))).alias("bin"))
    inner = whole.join(index.select("chrom", "bin", "sum", (F.col("end") - F.col("begin")).alias("w")), ["chrom", "bin"]).select("region_id", "sum", "w")
    edge = F.when(F.col("_c") <= F.col("_f"), F.array(F.struct(F.col("begin").alias("b"), F.col("_c").alias("e")), F.struct(F.col("_f").alias("b"), F.col("end").alias("e")))).otherwise(F.array(F.struct(F.col("begin").alias("b"), F.col("end").alias("e"))))
    edges = r.select("region_id", "chrom", F.explode(edge).alias("x")).select("region_id", "chrom", F.col("x.b").alias("begin"), F.col("x.e").alias("end")).where("`begin` < `end`")
    outer = overlaps(edges, runs, bin_width).select("region_id", (F.col("value") * F.col("w")).cast("double").alias("sum"), "w")
    total = inner.unionByName(outer).groupBy("region_id").agg(F.sum("sum").alias("sum"), F.sum("w").alias("w"))
    return regions.join(total, "region_id", "left").select(*REGION, F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce(F.col("sum") / F.col("w"), F.lit(0.0)).alias("mean"))
