"""Fixed-point values and encodings: denominators, scaling, dictionary widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.model import I32_MAX

TOLERANCE = 1e-10


def decimals_needed(value: str) -> Column:
    """The smallest power of ten that makes a value whole, within a tolerance, at most 10**10; 1 for values near zero."""
    v = F.col(value)
    out = F.lit(1e10)
    for k in range(9, -1, -1):
        scaled = v * F.lit(10.0**k)
        out = F.when(F.abs(F.round(scaled) - scaled) <= TOLERANCE, F.lit(10.0**k)).otherwise(out)
    return F.when(F.abs(v) < TOLERANCE, F.lit(1.0)).otherwise(out)


def denominator_of(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: the largest need of all values, divided by ten while the largest value would overflow."""
    need = values.agg(F.max(decimals_needed(value)).alias("need"), F.max(F.abs(F.col(value))).alias("top"))
    out = F.lit(1.0)
    for k in range(0, 11):
        fits = (F.col("top") * F.lit(10.0**k) <= I32_MAX) & (F.col("need") >= F.lit(10.0**k))
        out = F.when(fits, F.lit(10.0**k)).otherwise(out)
    return need.select(out.alias("denominator"))


def to_stored(value: Column, denominator: float | None) -> Column:
    """Rounded after scaling; truncated towards zero where no denominator is set."""
    if denominator is None or denominator == 1.0:
        return value.cast("int")
    return F.round(value * F.lit(float(denominator))).cast("int")


def cost_curve(runs: DataFrame, keys: list[str], tile: int, bits: int = 16) -> DataFrame:
    """Per code width ``d``: maximal runs of values of at least ``2**d``, and bits for 80-bit run records plus ``d`` bits a position."""
    from tracklake.operators.intervals import islands

    each = runs.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(bits)))).where(F.col("value") >= F.pow(F.lit(2.0), F.col("d")))
    n = islands(each, ["d", *keys], tile).groupBy("d").agg(F.count("*").cast("long").alias("n_runs"))
    total = runs.agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("positions"))
    widths = runs.sparkSession.range(0, bits + 1).select(F.col("id").cast("int").alias("d"))
    return widths.join(n, "d", "left").join(F.broadcast(total)).select("d", F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), (F.coalesce("n_runs", F.lit(0)) * 80 + F.col("d") * F.col("positions")).cast("long").alias("bits"))


def best_width(curve: DataFrame) -> DataFrame:
    """The cheapest width, the smaller one on ties."""
    return curve.agg(F.min(F.struct("bits", "d")).alias("s")).select("s.d", "s.bits")
