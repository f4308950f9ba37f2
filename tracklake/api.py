"""What users call: open, build, view, summarise, merge and export tracks."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import numeric
from tracklake.functions.hist import Histogram
from tracklake.functions.regions import parse_regions
from tracklake.model import DEFAULT_TRACK, INDEX_BIN, Track
from tracklake.operators import index as sums
from tracklake.operators import intervals, resample, stats


def genome_faults(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Chromosomes with their sizes that one side alone has; empty for equal genomes."""
    f, e = found.select("chrom", "size"), expected.select("chrom", "size")
    return f.join(e, ["chrom", "size"], "left_anti").withColumn("fault", F.lit("missing")).unionByName(e.join(f, ["chrom", "size"], "left_anti").withColumn("fault", F.lit("unexpected")))


def merged(tracks: dict[str, DataFrame]) -> DataFrame:
    """Runs of several sources under the names given; a dict can't hold a name twice."""
    out = None
    for tag, runs in tracks.items():
        part = runs.select(F.lit(tag).alias("track"), "chrom", "begin", "end", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to merge")
    return out


def split_spec(spec: str) -> tuple[str, str | None]:
    """``path[:track]``; of a URL the track follows ``#``."""
    if "://" in spec:
        path, _, track = spec.partition("#")
    else:
        path, _, track = spec.partition(":")
    return path, track or None


def is_remote(spec: str) -> bool:
    return re.match(r"[a-z0-9+.-]+://", spec) is not None and not spec.startswith("file://")


class TrackFile:
    """A stored track, or several of one genome."""

    def __init__(self, track: Track, path: str | None = None):
        self.track, self.path = track, path

    # catalogue
    @property
    def chroms(self) -> list[tuple[str, int]]:
        """A genome has few rows; they are gathered."""
        return [(r["chrom"], r["size"]) for r in self.track.genome.orderBy("chrom_id").collect()]

    @property
    def chrom_names(self) -> list[str]:
        return [c for c, _ in self.chroms]

    @property
    def denominator(self) -> float:
        return self.track.denominator

    def list_tracks(self, pattern: str | None = None) -> list[str]:
        """Names of all tracks, or of those whose last path component matches."""
        names = sorted(r[0] for r in self.track.runs.select("track").distinct().collect())
        return names if pattern is None else [n for n in names if re.search(pattern, n.rpartition("/")[2])]

    def specifier(self, name: str) -> str:
        return f"{self.path}{'#' if is_remote(self.path or '') else ':'}{name}"

    def open_track(self, name: str) -> TrackFile:
        if name not in self.list_tracks():
            raise KeyError(name)
        return TrackFile(self.track.named(name), self.path)

    def open_all(self) -> list[TrackFile]:
        return [self.open_track(n) for n in self.list_tracks()]

    # regions
    def regions(self, spec=None) -> DataFrame:
        """A table of regions: given as one, as text, as tuples, or all of the genome."""
        if isinstance(spec, DataFrame):
            return spec
        spark = self.track.genome.sparkSession
        if spec is None:
            return self.track.genome.select(F.col("chrom_id").cast("long").alias("region_id"), "chrom", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))
        return spark.createDataFrame(parse_regions(spec, dict(self.chroms)), "region_id long, chrom string, begin long, end long")

    # views
    def view(self, spec=None, keep_zero: bool = True) -> DataFrame:
        """Runs inside the regions, equal neighbours merged, values scaled, in the genome's order."""
        t = self.track
        names = self.list_tracks()
        wide = intervals.aligned(t.runs, names, t.tile)
        cut = intervals.clipped(self.regions(spec), wide, t.tile)
        out = intervals.merge_runs(cut, ["region_id", "chrom"], names, t.tile)
        if not keep_zero:
            out = out.where(F.exists(F.array(*names), lambda x: x != 0))
        if t.denominator != 1.0:
            out = out.withColumns({n: F.col(n) / F.lit(t.denominator) for n in names})
        order = out.join(F.broadcast(t.genome.select("chrom", "chrom_id")), "chrom")
        return order.orderBy("chrom_id", "begin", "end", "region_id").select("chrom", "begin", "end", *names)

    def values(self, spec=None) -> DataFrame:
        """``(region_id, track, chrom, pos, value)``, one row per position."""
        cut = intervals.clipped(self.regions(spec), self.track.scaled if self.denominator != 1.0 else self.track.runs, self.track.tile)
        return cut.select("region_id", "track", "chrom", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"), "value")

    def cursor(self, spec=None, start: int = 0):
        """Positions and values in order, one at a time, from ``start`` on."""
        for r in self.values(spec).where(F.col("pos") >= start).orderBy("region_id", "pos").toLocalIterator():
            yield r["chrom"], r["pos"], r["value"]

    def to_numpy(self, spec):
        """A dense array per region, as big as the region: the caller bounds what the driver holds."""
        import numpy as np

        rows = self.regions(spec).orderBy("region_id").collect()
        got = intervals.clipped(self.regions(spec), self.track.runs, self.track.tile).select("region_id", "begin", "end", "value").toPandas()
        out = []
        for r in rows:
            a = np.zeros(r["end"] - r["begin"], dtype=np.int32)
            for b, e, v in got[got.region_id == r["region_id"]][["begin", "end", "value"]].itertuples(index=False):
                a[b - r["begin"] : e - r["begin"]] = v
            out.append(a if self.denominator == 1.0 else a / self.denominator)
        return out[0] if len(out) == 1 and isinstance(spec, str) else out

    def matrix(self, spec):
        """Arrays of all tracks over each region, one row a track in the order of their names."""
        import numpy as np

        parts = [t.to_numpy(spec) for t in self.open_all()]
        return np.stack(parts) if isinstance(parts[0], np.ndarray) else [np.stack(rows) for rows in zip(*parts)]

    def partitions(self, limit: int) -> DataFrame:
        """Regions of at most ``limit`` positions (rounded down to a multiple of eight), none across chromosomes, that cover the genome."""
        step = max(8, limit // 8 * 8)
        parts = self.track.genome.where("size > 0").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
        end = F.least(F.col("begin") + step, "size")
        return parts.select((F.col("chrom_id").cast("long") * (1 << 40) + F.col("begin")).alias("region_id"), "chrom", "begin", end.alias("end"))

    def __getitem__(self, key):
        return self.to_numpy(key)

    # statistics
    def mean(self, spec=None, use_index: bool = True) -> DataFrame:
        """Means per region; from the index where there is one, which reads whole bins' sums instead of their runs."""
        t, r = self.track, self.regions(spec)
        if use_index and t.index is not None:
            return sums.query(r, t.runs, t.index, INDEX_BIN, t.tile).drop("sum").withColumn("mean", F.col("mean") / t.denominator)
        return stats.region_mean(r, t.runs, t.tile).withColumn("mean", F.col("mean") / t.denominator)

    def sum(self, spec=None, use_index: bool = True) -> DataFrame:
        t, r = self.track, self.regions(spec)
        if use_index and t.index is not None:
            return sums.query(r, t.runs, t.index, INDEX_BIN, t.tile).drop("mean").withColumn("sum", F.col("sum") / t.denominator)
        return stats.region_sum(r, t.runs, t.tile).withColumn("sum", F.col("sum") / t.denominator)

    def count(self, spec=None) -> DataFrame:
        return stats.region_count(self.regions(spec))

    def min_max(self, spec=None) -> DataFrame:
        return stats.region_min_max(self.regions(spec), self.track.runs, self.track.tile)

    def coverage(self, thresholds: list[int], spec=None) -> DataFrame:
        return stats.coverage_above(self.regions(spec), self.track.runs, sorted(thresholds), self.track.tile)

    def percentile(self, p: float, spec=None, mode: str = "exact") -> DataFrame:
        return stats.region_percentile(self.regions(spec), self.track.runs, p / 100, mode, bin_width=self.track.tile)

    def median(self, spec=None, mode: str = "exact") -> DataFrame:
        return self.percentile(50, spec, mode)

    def by_track(self, spec=None, kind: str = "mean") -> DataFrame:
        names = self.list_tracks()
        out = stats.by_track(self.regions(spec), self.track.runs, names, kind, self.track.tile)
        return out.withColumns({n: F.col(n) / self.denominator for n in names})

    def histogram(self, spec=None, low: int = 0, high: int = 1000) -> Histogram:
        """All regions together; a histogram has at most ``high - low + 2`` rows, which are gathered."""
        runs = intervals.clipped(self.regions(spec), self.track.runs, self.track.tile) if spec is not None else self.track.runs
        rows = {r["bucket"]: r["n"] for r in stats.histogram(runs, low, high).collect()}
        below, above = rows.pop("below"), rows.pop("above")
        return Histogram({int(k): n for k, n in rows.items() if n}, below, above)

    def aggregate(self, spec, *aggs) -> DataFrame:
        """Any Spark aggregates of ``value`` and ``w`` (positions) per region."""
        return stats.per_region(self.regions(spec), self.track.runs, *aggs, bin_width=self.track.tile)

    def apply(self, spec, make, schema: str) -> DataFrame:
        """A user's own aggregate: ``make(frame)`` gets a region's runs as pandas ``(region_id, chrom, begin, end, track, value)``, clipped and in order, and returns a frame of ``schema``."""
        cut = intervals.clipped(self.regions(spec), self.track.runs, self.track.tile)
        return cut.groupBy("region_id").applyInPandas(lambda rows: make(rows.sort_values(["track", "begin"], ignore_index=True)), schema)

    def scan(self, make, schema: str, spec=None) -> DataFrame:
        """A user's own scan: ``make(batches)`` gets a task's runs as Arrow batches, in no order across tasks, and yields batches of ``schema``."""
        runs = self.track.runs if spec is None else intervals.clipped(self.regions(spec), self.track.runs, self.track.tile)
        return runs.select("track", "chrom", "begin", "end", "value").mapInArrow(make, schema)

    def matrix_resample(self, width: int, spec=None) -> DataFrame:
        """Bins' means with a column for each track."""
        names = self.list_tracks()
        bins = resample.tumbling(self.regions(spec), width)
        means = stats.by_track(bins, self.track.runs, names, "mean", self.track.tile)
        return bins.select("region_id", "source_id", "bin").join(means, "region_id").select("source_id", "bin", "chrom", "begin", "end", *names)

    def from_position(self, chrom: str, pos: int) -> DataFrame:
        """Runs of a chromosome from a position on, the first one clipped to it: what a cursor reads after a seek."""
        cut = self.track.runs.where((F.col("chrom") == chrom) & (F.col("end") > pos))
        return cut.withColumn("begin", F.greatest("begin", F.lit(pos).cast("long"))).orderBy("track", "begin")

    def resample(self, width: int, spec=None, kind: str = "mean", for_index: bool = False) -> DataFrame:
        return resample.resampled(self.regions(spec), self.track.runs, resample.adjusted(width) if for_index else width, kind, self.track.tile)

    def islands(self, above: int, longer: int) -> DataFrame:
        out = intervals.islands(self.track.runs.where(F.col("value") > above), ["track", "chrom"], self.track.tile)
        return out.where(F.col("end") - F.col("begin") > longer).withColumn("mean", F.col("total") / (F.col("end") - F.col("begin")) / self.denominator).drop("total")

    # storage
    def with_index(self) -> TrackFile:
        return TrackFile(replace(self.track, index=sums.build(self.track.runs)), self.path)

    def save(self, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
        """Parquet below ``path``: runs by track and chromosome in order of position, so that row groups prune by position."""
        t = self.track
        t.runs.repartitionByRange("track", "chrom", "begin").sortWithinPartitions("track", "chrom", "begin").write.mode(mode).option("compression", compression).partitionBy("track").parquet(f"{path}/runs")
        t.genome.withColumn("denominator", F.lit(float(t.denominator))).coalesce(1).write.mode(mode).parquet(f"{path}/genome")
        if t.index is not None:
            t.index.write.mode(mode).parquet(f"{path}/index")


def open_tracks(spark: SparkSession, spec: str) -> TrackFile:
    """``path[:track]`` of a saved track; any file system that Spark reads."""
    path, name = split_spec(spec)
    genome = spark.read.parquet(f"{path}/genome")
    runs = spark.read.schema("chrom string, begin long, end long, value int, track string").parquet(f"{path}/runs")
    d = genome.select("denominator").first()
    try:
        index = spark.read.parquet(f"{path}/index")
    except Exception as e:  # no index was saved
        if "PATH_NOT_FOUND" not in str(e):
            raise
        index = None
    out = TrackFile(Track(runs, genome.drop("denominator"), d[0] if d else 1.0, index), path)
    return out.open_track(name) if name else out


class TrackBuilder:
    """Collects a genome and values, then makes a track."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sizes, self.denominator, self.parts, self.name, self.keep, self.indexed = spark, [], 1.0, [], DEFAULT_TRACK, None, False

    def add_chroms(self, chroms: list[tuple[str, int]]) -> TrackBuilder:
        self.sizes += chroms
        return self

    def like(self, other: TrackFile, chroms: list[str] | None = None) -> TrackBuilder:
        """The genome of another track, or some chromosomes of it."""
        return self.add_chroms([(c, n) for c, n in other.chroms if chroms is None or c in chroms])

    def set_filter(self, pattern: str) -> TrackBuilder:
        self.keep = pattern
        return self

    def set_denominator(self, denominator: float) -> TrackBuilder:
        self.denominator = denominator
        return self

    def named(self, name: str) -> TrackBuilder:
        self.name = name
        return self

    def generate_index(self) -> TrackBuilder:
        self.indexed = True
        return self

    def write_bits(self, chrom: str, pos: int, data) -> TrackBuilder:
        """An array of truth values, stored as 0 and 1."""
        import numpy as np

        return self.write_np_array(chrom, pos, np.asarray(data).astype(bool).astype(np.int32))

    def write_intervals(self, runs: DataFrame) -> TrackBuilder:
        self.parts.append(runs.select("chrom", F.col("begin").cast("long"), F.col("end").cast("long"), F.col("value").cast("double").alias("value")))
        return self

    def write_np_array(self, chrom: str, pos: int, data) -> TrackBuilder:
        """A one-dimensional array from ``pos`` on; equal neighbours become one run before Spark sees them."""
        import numpy as np

        a = np.asarray(data)
        if a.ndim != 1:
            raise ValueError("arrays have one dimension")
        cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else np.zeros(0, int)
        rows = [(chrom, int(pos + b), int(pos + e), float(a[b])) for b, e in zip(cut[:-1], cut[1:])]
        return self.write_intervals(self.spark.createDataFrame(rows, "chrom string, begin long, end long, value double"))

    def build(self) -> TrackFile:
        sizes = [(c, n) for c, n in self.sizes if self.keep is None or re.search(self.keep, c)]
        genome = self.spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(sizes)], "chrom string, size long, chrom_id int")
        runs = self.spark.createDataFrame([], "chrom string, begin long, end long, value double")
        for p in self.parts:
            runs = runs.unionByName(p)
        runs = runs.join(F.broadcast(genome.select("chrom")), "chrom", "left_semi").withColumn("value", numeric.to_stored(F.col("value"), self.denominator))
        full = intervals.merge_runs(intervals.fill_gaps(runs, genome), ["chrom"], ["value"])
        made = TrackFile(Track(full.select(F.lit(self.name).alias("track"), "chrom", "begin", "end", "value"), genome, self.denominator))
        return made.with_index() if self.indexed else made
