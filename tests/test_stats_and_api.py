"""Statistics on small known tracks, the API and text formats."""

import numpy as np
import pytest

from tracklake import api
from tracklake.functions import alignment, numeric
from tracklake.functions.hist import Histogram
from tracklake.functions.regions import parse_region, parse_regions
from tracklake.model import REGIONS
from tracklake.operators import resample, stats
from tracklake.sources import text

TEN = [0, 0, 0, 1, 2, 2, 1, 2, 1, 0]


@pytest.fixture(scope="module")
def ten(spark):
    return api.TrackBuilder(spark).add_chroms([("chr", 10)]).write_np_array("chr", 0, np.array(TEN)).build()


def one(df, col):
    return [r[col] for r in df.orderBy("region_id").collect()]


def test_means_and_coverage(ten):
    spec = [("chr", 0, 2), ("chr", 0, 8), ("chr", 0, 10), ("chr", 1, 6)]
    assert one(ten.mean(spec), "mean") == [0.0, 1.0, 0.9, 1.0]
    cov = ten.coverage([2, 1], spec)
    assert one(cov, "cov_1") == [0.0, 0.625, 0.6, 0.6]
    assert one(cov, "cov_2") == [0.0, 0.375, 0.3, 0.4]


def test_percentiles_of_a_mostly_zero_track(spark):
    track = api.TrackBuilder(spark).add_chroms([("1", 20_000)]).write_intervals(spark.createDataFrame([("1", 9_000, 9_160, 62.0)], "chrom string, begin long, end long, value double")).build()
    assert one(track.median(), "percentile") == [0]
    assert one(track.median(mode="compat"), "percentile") == [1]
    assert one(track.percentile(99.9), "percentile") == [62]


def test_views_and_arrays(ten):
    rows = [tuple(r) for r in ten.view("chr:2-6").collect()]
    assert rows == [("chr", 2, 3, 0), ("chr", 3, 4, 1), ("chr", 4, 6, 2)]
    assert ten["chr:2-6"].tolist() == TEN[2:6]
    assert [v for _, _, v in ten.cursor(start=5)] == TEN[5:]
    assert ten.view(keep_zero=False).count() == 5


def test_scaling_and_denominators(spark):
    rows = spark.createDataFrame([("c", 1, 3, 0.25), ("c", 5, 6, 10.8)], "chrom string, begin long, end long, value double")
    t = api.TrackBuilder(spark).add_chroms([("c", 8), ("d", 3)]).set_denominator(100).write_intervals(rows).build()
    assert t["c"].tolist() == [0, 0.25, 0.25, 0, 0, 10.8, 0, 0]
    assert t["d"].tolist() == [0, 0, 0]
    assert one(t.sum(), "sum") == [11.3, 0.0]
    need = lambda *v: numeric.denominator_of(spark.createDataFrame([(x,) for x in v], "value double")).first()[0]
    assert need(10.0, 20.0) == 1 and need(0.2, 10.8) == 10 and need(0.5, 3e9) == 1
    assert need(0.2, 10.8, 33262.09, 8284.95) == 10_000  # the binary fraction overshoots the tolerance


def test_save_and_open(spark, ten, tmp_path):
    path = str(tmp_path / "t")
    ten.with_index().save(path)
    again = api.open_tracks(spark, path)
    assert again["chr"].tolist() == TEN and again.track.index is not None
    assert one(again.mean([("chr", 0, 8)]), "mean") == one(again.mean([("chr", 0, 8)], use_index=False), "mean") == [1.0]
    assert again.list_tracks() == ["<default>"] and again.chroms == [("chr", 10)]
    with pytest.raises(KeyError):
        again.open_track("none")


def test_merging_tracks_and_genomes(spark, ten):
    both = api.merged({"a": ten.track.runs, "b": ten.track.runs})
    file = api.TrackFile(type(ten.track)(both, ten.track.genome))
    assert file.list_tracks() == ["a", "b"] and file.list_tracks("^b") == ["b"]
    assert [tuple(r)[4:] for r in file.by_track([("chr", 0, 8)]).collect()] == [(1.0, 1.0)]
    assert api.genome_faults(ten.track.genome, ten.track.genome).isEmpty()


def test_histogram(ten):
    h = ten.histogram()
    assert (h.total_count(), h.value_count(2), h.median(), h.percentile_below(1)) == (10, 3, 1, 70.0)
    assert h.mean() == 0.9 and abs(h.std() - np.std(TEN)) < 1e-12
    assert Histogram({}, 0, 3).percentile(50) == 0


def test_histogram_counts_positions_outside(spark, ten):
    rows = {r["bucket"]: r["n"] for r in stats.histogram(ten.track.runs, 1, 2).collect()}
    assert rows == {"1": 3, "below": 4, "above": 3}


def test_resampling(spark, ten):
    r = spark.createDataFrame([(0, "chr", 0, 10)], REGIONS)
    got = [(x["begin"], x["end"], x["mean"]) for x in resample.resampled(r, ten.track.runs, 4).orderBy("bin").collect()]
    assert got == [(0, 4, 0.25), (4, 8, 1.75), (8, 10, 0.5)]
    assert resample.adjusted(1) == 65_536 and resample.adjusted(200_000) == 196_608


def test_empty_array_and_wrong_shape(spark):
    b = api.TrackBuilder(spark).add_chroms([("c", 3)])
    assert b.write_np_array("c", 0, np.array([])).build()["c"].tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        b.write_np_array("c", 0, np.zeros((2, 2)))


def test_region_notations():
    sizes = {"chr": 100}
    for spec, want in [("chr", (0, 100)), ("chr:5-9", (5, 9)), ("chr:5-", (5, 100)), ("chr:-9", (0, 9)), (("chr", 7), (0, 7)), (("chr", 3, 500), (3, 100))]:
        assert parse_region(spec, sizes) == ("chr", *want)
    assert parse_region("other:1-2", sizes) is None
    assert parse_regions([("no", 1), "chr"], sizes) == [(1, "chr", 0, 100)]
    for bad in ("chr:x-y", "chr:5", ""):
        with pytest.raises(ValueError):
            parse_region(bad, sizes)


def test_text_sources(spark, tmp_path):
    (tmp_path / "g").write_text("a\t100\nbroken\nb\t50\n")
    (tmp_path / "bed").write_text("# note\na\t1\t5\textra\nbad line\nb\t0\t9\n")
    (tmp_path / "bg").write_text("a\t1\t5\t0.5\na\t7\t2\ntrack x\n")
    assert [tuple(r) for r in text.genome(spark, str(tmp_path / "g")).collect()] == [("a", 100, 0), ("b", 50, 1)]
    assert [tuple(r)[1:] for r in text.bed(spark, str(tmp_path / "bed")).orderBy("region_id").collect()] == [("a", 1, 5), ("b", 0, 9)]
    assert [tuple(r) for r in text.bedgraph(spark, str(tmp_path / "bg")).collect()] == [("a", 1, 5, 0.5), ("a", 7, 8, 2.0)]
    with pytest.raises(Exception, match="not a region"):
        text.bed(spark, str(tmp_path / "bed"), strict=True).collect()
    df = spark.createDataFrame([(0.0,), (0.0005,), (0.625,)], "v double")
    assert [r[0] for r in df.select(text.exponent_text("v")).collect()] == ["0.000e0", "5.000e-4", "0.625"]


def test_flags_and_cigars(spark):
    df = spark.createDataFrame([("r", 0, 5, 60, 99), ("r", 0, 5, 60, 16), ("r", 0, 5, 10, 99)], "chrom string, begin long, end long, mapq int, flag int")
    assert [alignment.passing(df, 60, f).count() for f in (None, "99", "+1,-16", "~1")] == [2, 1, 1, 1]
    with pytest.raises(ValueError):
        alignment.flag_filter("x")
    c = spark.createDataFrame([("3M1I2D2M1S",), ("",)], "cigar string")
    assert [r[0] for r in c.select(alignment.reference_length("cigar")).collect()] == [7, 0]
