"""Interval algebra on runs: neighbours, run-length merging, gap filling, pile-up, overlap joins, alignment.

Genomes have few chromosomes, so nothing here sorts a whole chromosome in one
task. Intervals are cut at the borders of tiles of positions, so each tile is a
unit of its own; afterwards only the runs that touch a border, two per tile, meet in
a window over their chromosome and are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.model import TILE


def div(a, width: int) -> Column:
    """Integer division that rounds down; positions are never negative here."""
    return F.floor((F.col(a) if isinstance(a, str) else a) / F.lit(width)).cast("long")


def shifted(df: DataFrame, keys: list[str], pos: str, cols: list[str], tile: int = TILE, ahead: bool = False) -> DataFrame:
    """Adds ``near``: a struct of ``cols`` of the row before (or ``ahead``) within ``keys`` in the order of ``pos``."""
    fn = F.lead if ahead else F.lag
    df = df.withColumn("_tile", div(pos, tile))
    local = df.withColumn("_near", fn(F.struct(*cols)).over(Window.partitionBy(*keys, "_tile").orderBy(pos)))
    pick = F.min_by if ahead else F.max_by
    edge = df.groupBy(*keys, "_tile").agg(pick(F.struct(*cols), F.col(pos)).alias("_edge"))
    edge = edge.withColumn("_edge", fn("_edge").over(Window.partitionBy(*keys).orderBy("_tile")))
    return local.join(edge, [*keys, "_tile"]).withColumn("near", F.coalesce("_near", "_edge")).drop("_near", "_edge", "_tile")


def cut_at_tiles(df: DataFrame, tile: int) -> DataFrame:
    """Intervals cut at tile borders, with ``_tile``."""
    df = df.withColumn("_tile", F.explode(F.sequence(div("begin", tile), div(F.col("end") - 1, tile))))
    return df.withColumn("begin", F.greatest("begin", F.col("_tile") * tile)).withColumn("end", F.least("end", (F.col("_tile") + 1) * tile))


def tiles_of(genome: DataFrame, tile: int) -> DataFrame:
    """``(chrom, _tile, _lo, _hi)`` for all tiles; a human genome has three thousand of a million positions."""
    t = genome.where("size > 0").select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("size") - 1, tile))).alias("_tile"))
    return t.select("chrom", "_tile", (F.col("_tile") * tile).alias("_lo"), F.least((F.col("_tile") + 1) * tile, "size").alias("_hi"))


def keyed_tiles(df: DataFrame, genome: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """The genome's tiles for every value that the keys beside ``chrom`` take."""
    tiles = tiles_of(genome, tile)
    other = [k for k in keys if k != "chrom"]
    return df.select(*other).distinct().join(tiles) if other else tiles


def _merged(df: DataFrame, by: list[str], keys: list[str], values: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("begin")
    same = F.struct(*values).eqNullSafe(F.lag(F.struct(*values)).over(w)) & (F.lag("end").over(w) == F.col("begin"))
    marked = df.withColumn("_new", F.when(same, 0).otherwise(1))
    return marked.withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), *[F.first(v).alias(v) for v in values]).drop("_run")


def stitched(df: DataFrame, keys: list[str], values: list[str], tile: int) -> DataFrame:
    """Runs that were cut at tile borders, merged across them."""
    df = df.select(*keys, "begin", "end", *values)
    edge = (F.col("begin") % tile == 0) | (F.col("end") % tile == 0)
    return df.where(~edge).unionByName(_merged(df.where(edge), keys, keys, values))


def merge_runs(runs: DataFrame, keys: list[str], values: list[str], tile: int = TILE) -> DataFrame:
    """Adjacent runs with equal ``values`` become one (nulls equal nulls)."""
    pieces = cut_at_tiles(runs.select(*keys, "begin", "end", *values), tile)
    return stitched(_merged(pieces, [*keys, "_tile"], keys, values), keys, values, tile)


def islands(runs: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Maximal stretches of touching runs, whatever their values, with their weighted sum."""

    def joined(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("begin")
        marked = df.withColumn("_new", F.when(F.lag("end").over(w) == F.col("begin"), 0).otherwise(1))
        return marked.withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("total").alias("total"))

    pieces = cut_at_tiles(runs, tile).withColumn("total", F.col("value") * (F.col("end") - F.col("begin")))
    local = joined(pieces, [*keys, "_tile"]).select(*keys, "begin", "end", "total")
    edge = (F.col("begin") % tile == 0) | (F.col("end") % tile == 0)
    return local.where(~edge).unionByName(joined(local.where(edge), keys).select(*keys, "begin", "end", "total"))


def fill_gaps(runs: DataFrame, genome: DataFrame, default: int = 0, keys: tuple[str, ...] = ("chrom",), tile: int = TILE) -> DataFrame:
    """Runs that cover every chromosome, equal neighbours merged: stretches without any get ``default``.

    ``keys`` may name a track beside the chromosome; each track then covers the
    genome. Every tile has an empty run at its start, so one window per tile finds all gaps.
    """
    keys = list(keys)
    pieces = cut_at_tiles(runs.select(*keys, F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "value"), tile)
    tiles = keyed_tiles(runs, genome, keys, tile)
    starts = tiles.select(*keys, F.col("_lo").alias("begin"), F.col("_lo").alias("end"), F.lit(default).alias("value"), "_tile", "_hi")
    w = Window.partitionBy(*keys, "_tile").orderBy("begin", "end")
    every = pieces.withColumn("_hi", F.lit(None).cast("long")).unionByName(starts)
    after = every.withColumn("_next", F.lead("begin").over(w)).withColumn("_top", F.max("_hi").over(Window.partitionBy(*keys, "_tile"))).where("_top IS NOT NULL")
    gap = F.struct(F.col("end").alias("begin"), F.coalesce("_next", "_top").alias("end"), F.lit(default).alias("value"))
    both = after.select(*keys, "_tile", F.explode(F.array(F.struct("begin", "end", "value"), gap)).alias("r")).select(*keys, "_tile", "r.*").where("`begin` < `end`")
    return stitched(_merged(both, [*keys, "_tile"], keys, ["value"]), keys, ["value"], tile)


def pileup(reads: DataFrame, genome: DataFrame, keys: tuple[str, ...] = ("chrom",), tile: int = TILE) -> DataFrame:
    """Depth runs of half-open reads over the whole genome; neighbours always differ.

    An event sweep per tile: +1 and -1 are summed per position before they are
    shuffled, and every tile has events of 0 at its borders, so it needs no other
    tile and is covered even without reads. Reads are clipped to their chromosomes.
    The genome is broadcast, for a join by chromosome would bring all reads of one to one task.
    """
    keys = list(keys)
    inside = reads.join(F.broadcast(genome.select("chrom", "size")), "chrom").select(*keys, F.greatest("begin", F.lit(0)).cast("long").alias("begin"), F.least("end", "size").cast("long").alias("end")).where("`begin` < `end`")
    pieces = cut_at_tiles(inside, tile)
    event = lambda pos, d, edge: F.struct(F.col(pos).alias("pos"), F.lit(d).alias("d"), F.lit(edge).alias("edge"))
    events = pieces.select(*keys, "_tile", F.explode(F.array(event("begin", 1, False), event("end", -1, False))).alias("e"))
    borders = keyed_tiles(reads, genome, keys, tile).select(*keys, "_tile", F.explode(F.array(event("_lo", 0, True), event("_hi", 0, True))).alias("e"))
    steps = events.unionByName(borders).groupBy(*keys, "_tile", "e.pos").agg(F.sum("e.d").alias("d"), F.max("e.edge").alias("edge")).where("d <> 0 OR edge")
    w = Window.partitionBy(*keys, "_tile").orderBy("pos")
    runs = steps.select(*keys, F.col("pos").alias("begin"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w).cast("int").alias("value")).where("`end` IS NOT NULL")
    return stitched(runs, keys, ["value"], tile)


def overlaps(regions: DataFrame, runs: DataFrame, bin_width: int = TILE, how: str = "inner") -> DataFrame:
    """Regions with the runs that they overlap, as ``(region columns, track columns, w)`` with the width of each overlap.

    Both sides are dealt to position bins, so this is an equi-join that scales with the
    number of bins, not chromosomes; a pair that shares several bins counts in the
    first of them alone. ``how="left"`` keeps regions without any run (``w`` null).
    """
    extra = [c for c in runs.columns if c not in ("chrom", "begin", "end")]
    span = lambda b, e: F.explode(F.sequence(div(b, bin_width), div(F.col(e) - 1, bin_width)))
    r = regions.where("`begin` < `end`").withColumn("_bin", span("begin", "end"))
    t = runs.select("chrom", F.col("begin").alias("_b"), F.col("end").alias("_e"), *extra).where("_b < _e").withColumn("_bin", span("_b", "_e"))
    hit = r.join(t, ["chrom", "_bin"]).where("_b < `end` AND _e > `begin`").where(F.col("_bin") == div(F.greatest("begin", "_b"), bin_width))
    hit = hit.withColumn("w", F.least("end", "_e") - F.greatest("begin", "_b")).drop("_bin")
    if how == "inner":
        return hit
    return regions.join(hit.select("region_id", "_b", "_e", "w", *extra), "region_id", "left")


def clipped(regions: DataFrame, runs: DataFrame, bin_width: int = TILE) -> DataFrame:
    """Runs cut to the regions that they overlap."""
    hit = overlaps(regions, runs, bin_width)
    return hit.withColumn("begin", F.greatest("begin", "_b")).withColumn("end", F.least("end", "_e")).drop("_b", "_e", "w")


def aligned(runs: DataFrame, tracks: list[str], tile: int = TILE) -> DataFrame:
    """One row per stretch on which no track changes, with a column per track; stretches with equal values are merged.

    Tracks cover their genome, so each has a run at every tile's start, and at any
    boundary the others go on with the value that they had.
    """
    pieces = cut_at_tiles(runs.select("track", "chrom", "begin", "end", "value"), tile)
    at = pieces.groupBy("chrom", "_tile", "begin").agg(F.max("end").alias("_end"), *[F.max(F.when(F.col("track") == t, F.col("value"))).alias(t) for t in tracks])
    w = Window.partitionBy("chrom", "_tile").orderBy("begin")
    wide = at.select("chrom", "_tile", "begin", F.coalesce(F.lead("begin").over(w), F.col("_end")).alias("end"), *[F.last(t, ignorenulls=True).over(w).alias(t) for t in tracks])
    return stitched(_merged(wide, ["chrom", "_tile"], ["chrom"], tracks), ["chrom"], tracks, tile)


def coalesced(primary: DataFrame, secondary: DataFrame, tile: int = TILE) -> DataFrame:
    """Runs of ``primary`` with those of ``secondary`` laid over them; a stretch that ``secondary`` lacks keeps its value.

    ``primary`` covers its genome; both have ``(chrom, begin, end, value)``.
    """
    both = primary.select(F.lit("p").alias("track"), "chrom", "begin", "end", "value").unionByName(secondary.select(F.lit("s").alias("track"), "chrom", "begin", "end", "value"))
    pieces = cut_at_tiles(both, tile)
    ends = pieces.where("track = 's'").select("track", "chrom", F.col("end").alias("begin"), F.col("end"), F.lit(None).cast("int").alias("value"), "_tile", F.lit(True).alias("stop"))
    at = pieces.withColumn("stop", F.lit(False)).unionByName(ends).where("`begin` < (_tile + 1) * %d" % tile)
    own = lambda t: F.max(F.when((F.col("track") == t) & ~F.col("stop"), F.col("value")))
    step = at.groupBy("chrom", "_tile", "begin").agg(F.max(F.when(F.col("track") == "p", F.col("end"))).alias("_end"), own("p").alias("p"), own("s").alias("s"), F.max(F.when(F.col("track") == "s", 1)).alias("turn"))
    w = Window.partitionBy("chrom", "_tile").orderBy("begin")
    base = F.last("p", ignorenulls=True).over(w)
    over = F.last(F.when(F.col("turn") == 1, F.struct("s")), ignorenulls=True).over(w)
    wide = step.select("chrom", "_tile", "begin", F.coalesce(F.lead("begin").over(w), F.last("_end", ignorenulls=True).over(w)).alias("end"), F.coalesce(over["s"], base).alias("value"))
    return stitched(_merged(wide, ["chrom", "_tile"], ["chrom"], ["value"]), ["chrom"], ["value"], tile)


def last_before(points: DataFrame, runs: DataFrame, tile: int = TILE) -> DataFrame:
    """As-of join: each point ``(chrom, pos)`` with the last run that begins at or before it (null without one).

    Runs and points share windows of a tile; what a tile's first points need comes from
    the last run of the tiles before, of which there is one a tile.
    """
    p = points.select("chrom", "pos", F.lit(1).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("begin", "end")), F.lit(None).cast("int").alias("value"))
    r = runs.select("chrom", F.col("begin").alias("pos"), F.lit(0).alias("kind"), "begin", "end", "value")
    every = r.unionByName(p).withColumn("_tile", div("pos", tile))
    run = F.when(F.col("kind") == 0, F.struct("begin", "end", "value"))
    own = F.last(run, ignorenulls=True).over(Window.partitionBy("chrom", "_tile").orderBy("pos", "kind"))
    edge = every.groupBy("chrom", "_tile").agg(F.max(run).alias("last"))
    edge = edge.withColumn("before", F.last("last", ignorenulls=True).over(Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1))).select("chrom", "_tile", "before")
    out = every.withColumn("own", own).where("kind = 1").join(edge, ["chrom", "_tile"]).withColumn("run", F.coalesce("own", "before"))
    return out.select("chrom", "pos", "run.begin", "run.end", "run.value")
