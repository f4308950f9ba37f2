"""Tables of the data model.

A *track* is a table of disjoint half-open runs ``(track, chrom, begin, end,
value)`` that cover ``[0, size)`` of every chromosome of its *genome*
``(chrom, size, chrom_id)``. Values are stored as integers; a *denominator*
turns them into reals. *Regions* are ``(region_id, chrom, begin, end)``, and
*reads* ``(chrom, begin, end, mapq, flag)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions per tile: what a window function or a bin of a join holds together.
TILE = 1 << 20
#: Bins of the pre-aggregated sum index.
INDEX_BIN = 65_536
I32_MAX, I32_MIN = 2**31 - 1, -(2**31)
DEFAULT_TRACK = "<default>"

GENOME = "chrom string, size long, chrom_id int"
RUNS = "track string, chrom string, begin long, end long, value int"
REGIONS = "region_id long, chrom string, begin long, end long"
READS = "chrom string, begin long, end long, mapq int, flag int"


@dataclass(frozen=True)
class Track:
    """Runs of one or more tracks with their genome, denominator and, if built, their sum index."""

    runs: DataFrame
    genome: DataFrame
    denominator: float = 1.0
    index: DataFrame | None = None
    tile: int = TILE

    def with_runs(self, runs: DataFrame) -> Track:
        return replace(self, runs=runs, index=None)

    def named(self, track: str) -> Track:
        """The track of that name alone."""
        only = lambda df: None if df is None else df.where(F.col("track") == track)
        return replace(self, runs=only(self.runs), index=only(self.index))

    @property
    def scaled(self) -> DataFrame:
        """Runs with real values."""
        return self.runs.withColumn("value", F.col("value") / F.lit(float(self.denominator)))


def faults(track: Track) -> DataFrame:
    """Rows that break the model: ``(track, chrom, begin, end, fault)``; none for a sound track."""
    from tracklake.operators.intervals import shifted

    runs = track.runs.join(F.broadcast(track.genome.select("chrom", "size")), "chrom", "left")
    seen = shifted(runs, ["track", "chrom"], "begin", ["end"], track.tile).withColumn("before", F.col("near.end"))
    fault = (
        F.when(F.col("size").isNull(), "chromosome is not in the genome")
        .when(F.col("begin") >= F.col("end"), "empty or reversed")
        .when((F.col("begin") < 0) | (F.col("end") > F.col("size")), "out of bounds")
        .when(F.col("begin") < F.col("before"), "overlaps its predecessor")
    )
    return seen.withColumn("fault", fault).where("fault IS NOT NULL").select("track", "chrom", "begin", "end", "fault")
