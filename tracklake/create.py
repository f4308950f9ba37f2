"""Tracks made from files: alignments piled up, real values scaled, containers read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.api import TrackFile, merged, split_spec
from tracklake.functions import numeric
from tracklake.functions.alignment import passing
from tracklake.model import DEFAULT_TRACK, Track
from tracklake.operators.intervals import fill_gaps, merge_runs, pileup
from tracklake.sources import alignment, bigwig, container, text
from tracklake.sources.files import qualified, sized


def scaled(runs: DataFrame, genome: DataFrame, denominator: float, name: str = DEFAULT_TRACK) -> TrackFile:
    """Real values as stored integers over the whole genome; gaps are 0."""
    kept = runs.join(F.broadcast(genome.select("chrom")), "chrom", "left_semi").withColumn("value", numeric.to_stored(F.col("value"), denominator))
    full = merge_runs(fill_gaps(kept, genome), ["chrom"], ["value"])
    return TrackFile(Track(full.select(F.lit(name).alias("track"), "chrom", "begin", "end", "value"), genome, denominator))


def create(spark: SparkSession, path: str, genome: str | None = None, mapq: int = 60, flags: str | None = None, chroms: str | None = None, denominator: float | str | None = None) -> TrackFile:
    """A track from an alignment, BigWig or BedGraph file, told apart by the name's suffix.

    ``chroms`` is a pattern of names that stay. ``denominator`` may be ``"auto"``: the least power of
    ten that makes all values whole. BedGraph needs the path of a ``genome`` table.
    """
    kind = text.kind_of(path)
    if kind == "bedgraph" and genome is None:
        raise ValueError("text has no chromosome sizes: name a genome file")
    at = qualified(spark, path)
    source = {"alignment": alignment, "bigwig": bigwig}.get(kind)
    sizes = text.genome(spark, genome) if genome is not None else source.genome_of(spark, at)
    if chroms is not None:
        sizes = sizes.where(F.col("chrom").rlike(chroms))
    if kind == "alignment":
        runs = pileup(passing(alignment.alignments(spark, at), mapq, flags, chroms), sizes)
        return TrackFile(Track(runs.select(F.lit(DEFAULT_TRACK).alias("track"), "chrom", "begin", "end", "value"), sizes))
    runs = bigwig.bigwig(spark, at) if kind == "bigwig" else text.bedgraph(spark, at)
    if denominator == "auto":
        denominator = numeric.denominator_of(runs).first()[0]
    return scaled(runs, sizes, float(denominator or 1.0))


def from_container(spark: SparkSession, spec: str) -> TrackFile:
    """``path[:track]`` of a binary container, all of whose tracks have one genome and one denominator."""
    path, name = split_spec(spec)
    path = qualified(spark, path)
    runs = merge_runs(container.container(spark, path, name), ["track", "chrom"], ["value"])
    return TrackFile(Track(runs, container.genome_of(spark, path, name), container.denominator_of(path, name)), path)


def merge_files(tracks: dict[str, TrackFile]) -> TrackFile:
    """Several single tracks of one genome under the names given; unlike genomes or denominators raise."""
    from tracklake.api import genome_faults

    first = next(iter(tracks.values()), None)
    if first is None:
        raise ValueError("nothing to merge")
    for name, t in tracks.items():
        if t.denominator != first.denominator or not genome_faults(t.track.genome, first.track.genome).isEmpty():
            raise ValueError(f"{name} has another genome or denominator")
    return TrackFile(Track(merged({n: t.track.runs for n, t in tracks.items()}), first.track.genome, first.denominator))


def sparse_pays(spark: SparkSession, path: str, genome: DataFrame) -> bool:
    """Whether a file is so small for its genome that runs alone should be stored: a storage hint by size."""
    size = sum(n for _, n in sized(qualified(spark, path)))
    positions = genome.agg(F.sum("size")).first()[0] or 0
    return size < (positions // 8 if text.kind_of(path) == "bigwig" else positions)


def dictionary(spark: SparkSession, values: str | None = None, path: str | None = None, sparse: bool = False) -> dict:
    """``{"low", "high"}`` of a range ``a-b`` (of a power of two of values), or ``{"values"}`` of a file; 0 to 64 by default."""
    if sparse:
        return {"low": 0, "high": 1}
    if path is not None:
        return {"values": [r[0] for r in text.dictionary(spark, path).collect()]}
    low, high = (int(x) for x in (values or "0-64").split("-"))
    if high <= low or (high - low) & (high - low - 1):
        raise ValueError(f"{values!r} doesn't hold a power of two of values")
    return {"low": low, "high": high}


def dictionary_json(d: dict) -> str:
    return json.dumps(d, indent=2)
