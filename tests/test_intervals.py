"""Interval operators against position-by-position computation, with tiles so small that borders matter."""

import random
import re

import numpy as np
import pytest

from tracklake.model import GENOME, REGIONS, RUNS, Track, faults
from tracklake.operators import index, intervals, stats

SIZES = {"x": 97, "y": 64, "z": 30}


@pytest.fixture(scope="module")
def genome(spark):
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(SIZES.items())], GENOME)


def dense(rows):
    out = {c: np.full(n, -99) for c, n in SIZES.items()}
    for c, b, e, v in rows:
        assert (out[c][b:e] == -99).all(), "runs overlap"
        out[c][b:e] = v
    return out


def signal(seed):
    rng = random.Random(seed)
    rows = []
    for c, n in SIZES.items():
        at = 0
        while at < n:
            to = min(n, at + rng.choice([1, 2, 5, 16, 33]))
            rows.append((c, at, to, rng.choice([0, 0, 1, 2, 7, -3])))
            at = to
    return rows


def runs_of(spark, rows):
    return spark.createDataFrame(rows, "chrom string, begin long, end long, value int")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("chrom", "begin", "end", "value").collect())


@pytest.mark.parametrize("tile", [8, 1000])
def test_pileup_is_depth_everywhere(spark, genome, tile):
    rng = random.Random(1)
    reads = [(c, b, b + rng.choice([0, 1, 3, 20, 60]), 60, 0) for c in ("x", "y", "gone") for b in rng.choices(range(-5, 90), k=25)]
    got = rows_of(intervals.pileup(spark.createDataFrame(reads, "chrom string, begin long, end long, mapq int, flag int"), genome, tile=tile))
    want = {c: np.zeros(n, int) for c, n in SIZES.items()}
    for c, b, e, _, _ in reads:
        if c in want:
            want[c][max(b, 0) : max(e, 0)] += 1
    have = dense(got)
    assert all((have[c] == want[c]).all() for c in SIZES)
    assert all(not (p[0] == q[0] and p[2] == q[1] and p[3] == q[3]) for p, q in zip(got, got[1:]))


def test_pileup_of_no_reads_is_zero(spark, genome):
    got = rows_of(intervals.pileup(spark.createDataFrame([], "chrom string, begin long, end long"), genome, tile=16))
    assert got == [("x", 0, 97, 0), ("y", 0, 64, 0), ("z", 0, 30, 0)]


def by_chromosome(df):
    """Joins whose rows are dealt out and sorted by chromosome alone."""
    return re.findall(r"SortMergeJoin \[chrom#\d+\]", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("keys", [("chrom",), ("track", "chrom")])
def test_pileup_deals_no_reads_by_chromosome(spark, genome, keys):
    """A chromosome's reads would all be sorted in one task; positions alone are shuffled."""
    reads = spark.range(500_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS track", "if(id >= 0, 'x', 'y') AS chrom", "id % 90 AS begin", "id % 90 + 5 AS end")
    got = intervals.pileup(reads, genome, keys, tile=16)
    assert not by_chromosome(got)
    assert got.where("chrom = 'x'").selectExpr("sum(value * (end - begin))").first()[0] == 2_500_000


def test_tracks_meet_their_genome_without_a_shuffle(spark, genome):
    from tracklake.api import TrackFile
    from tracklake.create import scaled

    runs = spark.range(1_000_000).selectExpr("if(id >= 0, 'x', 'y') AS chrom", "id AS begin", "id + 1 AS end", "1.0D AS value")
    track = Track(runs.selectExpr("'t' AS track", "chrom", "begin", "end", "cast(value AS int) AS value"), genome)
    assert not by_chromosome(scaled(runs, genome, 1.0).track.runs)
    assert not by_chromosome(faults(track))
    assert not by_chromosome(TrackFile(track).view("x"))


@pytest.mark.parametrize("tile", [8, 1000])
def test_merging_chopped_runs(spark, tile):
    rows = signal(2)
    chopped = [(c, p, p + 1, v) for c, b, e, v in rows for p in range(b, e)]
    got = rows_of(intervals.merge_runs(runs_of(spark, chopped), ["chrom"], ["value"], tile))
    assert all((dense(got)[c] == dense(rows)[c]).all() for c in SIZES)
    assert all(not (p[0] == q[0] and p[2] == q[1] and p[3] == q[3]) for p, q in zip(got, got[1:]))


@pytest.mark.parametrize("tile", [8, 1000])
def test_gaps_are_filled(spark, genome, tile):
    rows = [r for r in signal(3) if r[3] > 0 and r[0] != "z"]
    got = dense(rows_of(intervals.fill_gaps(runs_of(spark, rows), genome, 0, tile=tile)))
    want = {c: np.zeros(n, int) for c, n in SIZES.items()}
    for c, b, e, v in rows:
        want[c][b:e] = v
    assert all((got[c] == want[c]).all() for c in SIZES)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    rows = signal(4)
    regions = [(i, rng.choice([*SIZES, "gone"]), b, b + rng.choice([1, 4, 30, 200])) for i, b in enumerate(rng.choices(range(100), k=60))]
    r = spark.createDataFrame(regions, REGIONS)
    got = sorted((x["region_id"], x["_b"], x["w"]) for x in intervals.overlaps(r, runs_of(spark, rows), 8).collect())
    assert got == sorted((i, b, min(e, re) - max(b, rb)) for i, c, rb, re in regions for k, b, e, _ in rows if c == k and b < re and e > rb)
    assert intervals.overlaps(r, runs_of(spark, rows), 8, "left").select("region_id").distinct().count() == 60


@pytest.mark.parametrize("tile", [8, 1000])
def test_alignment_of_tracks(spark, tile):
    a, b = signal(5), signal(6)
    both = spark.createDataFrame([("a", *r) for r in a] + [("b", *r) for r in b], RUNS)
    got = intervals.aligned(both, ["a", "b"], tile).collect()
    da, db = dense(a), dense(b)
    assert sum(r["end"] - r["begin"] for r in got) == sum(SIZES.values())
    for r in got:
        assert (da[r["chrom"]][r["begin"] : r["end"]] == r["a"]).all() and (db[r["chrom"]][r["begin"] : r["end"]] == r["b"]).all()


@pytest.mark.parametrize("tile", [8, 1000])
def test_islands(spark, tile):
    rows = [r for r in signal(7) if r[3] > 0]
    got = sorted(tuple(r) for r in intervals.islands(runs_of(spark, rows), ["chrom"], tile).select("chrom", "begin", "end", "total").collect())
    want = []
    for c, b, e, v in sorted(rows):
        if want and want[-1][0] == c and want[-1][2] == b:
            want[-1] = (c, want[-1][1], e, want[-1][3] + v * (e - b))
        else:
            want.append((c, b, e, v * (e - b)))
    assert got == want


def test_index_agrees_with_runs_even_inside_one_bin(spark):
    runs = runs_of(spark, signal(8))
    rng = random.Random(8)
    regions = spark.createDataFrame([(i, rng.choice([*SIZES, "gone"]), b, b + rng.choice([1, 3, 16, 50, 120])) for i, b in enumerate(rng.choices(range(96), k=80))], REGIONS)
    got = {r["region_id"]: (r["sum"], r["mean"]) for r in index.query(regions, runs, index.build(runs, 16), 16, 8).collect()}
    sums = {r["region_id"]: r["sum"] for r in stats.region_sum(regions, runs, 8).collect()}
    means = {r["region_id"]: r["mean"] for r in stats.region_mean(regions, runs, 8).collect()}
    assert {k: v[0] for k, v in got.items()} == sums
    assert all(abs(got[k][1] - means[k]) < 1e-12 for k in means)


def test_faults(spark, genome):
    bad = [("t", "x", 0, 10, 1), ("t", "x", 5, 20, 1), ("t", "y", 60, 70, 1), ("t", "q", 0, 1, 1), ("t", "z", 4, 4, 0)]
    found = {r["fault"] for r in faults(Track(spark.createDataFrame(bad, RUNS), genome, tile=8)).collect()}
    assert found == {"overlaps its predecessor", "out of bounds", "chromosome is not in the genome", "empty or reversed"}
    assert faults(Track(spark.createDataFrame([("t", *r) for r in signal(9)], RUNS), genome, tile=8)).isEmpty()
