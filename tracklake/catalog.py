"""Queries of the track operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake import serve
from tracklake.api import TrackFile
from tracklake.functions import alignment as reads
from tracklake.functions import numeric, regions, tables
from tracklake.model import Track
from tracklake.operators import index, intervals, resample, stats
from tracklake.plans import signals as s
from tracklake.sources import alignment, files, text

T, BIN = s.TILE, s.TILE
ISLAND, ISLAND_LEN = 60, 20
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(*ctes: str, body: str | None):
    """Registers a query with its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLE_SQL[f.__name__] = _sql(*ctes, body=body) if ctes else body
        return f

    return add


R = ["region_id", "chrom", "begin", "end"]
RUN_COLS = 'chrom, b AS "begin", e AS "end"'
REGION_COLS = 'region_id, chrom, rb AS "begin", re AS "end"'
OV = (s.BASE_SQL, s.REGIONS_SQL, s.OVERLAPS_SQL)


def _region(sql: str) -> str:
    return f"SELECT {REGION_COLS}, {sql} FROM ov GROUP BY region_id, chrom, rb, re"


# --- creation -----------------------------------------------------------------


@query(s.BASE_SQL, body=f"SELECT {RUN_COLS}, v AS value FROM runs")
def pileup_depth(spark, sf):
    return s.runs(spark, sf)


@query(s.READS_SQL, s.GENOME_SQL, s.pileup_sql(where="mapq >= 20 AND (flag & 256) = 256 AND (flag & 16) = 0"), body=f"SELECT {RUN_COLS}, v AS value FROM runs")
def pileup_filtered_mapq_flag(spark, sf):
    return intervals.pileup(reads.passing(s.reads(spark, sf), 20, "+256,~16"), s.genome(spark), tile=T)


@query(s.READS_SQL, s.GENOME_SQL, "g2 AS (SELECT * FROM genome WHERE regexp_matches(chrom, '^[AN]$'))", s.pileup_sql(where="mapq >= 60 OR chrom IN ('A', 'N') AND mapq >= 30").replace("SELECT * FROM genome", "SELECT * FROM g2"), body=f"SELECT {RUN_COLS}, v AS value FROM runs WHERE chrom <> 'R'")
def pileup_chrom_filter(spark, sf):
    g = s.genome(spark).where(F.col("chrom").rlike("^[AN]$"))
    return intervals.pileup(reads.passing(s.reads(spark, sf), 30, None, "^[AN]$"), g, tile=T)


@query(
    s.HOURLY_SQL,
    f"ty AS (SELECT DISTINCT event_type AS chrom FROM events)",
    f"al AS (SELECT chrom, unnest(range({s.HOURS})) AS h FROM ty)",
    "fu AS (SELECT al.chrom, h AS b, h + 1 AS e, CAST(coalesce(v, 0) AS INTEGER) AS v FROM al LEFT JOIN hr ON al.chrom = hr.chrom AND h = b)",
    s.merged_sql("fu", "chrom", "v"),
    body=f"SELECT {RUN_COLS}, v AS value FROM merged",
)
def bedgraph_fill_gaps(spark, sf):
    full = intervals.fill_gaps(s.hourly(spark, sf), s.hourly_genome(spark, sf), tile=64)
    return intervals.merge_runs(full, ["chrom"], ["value"], 64)


@query(s.HOURLY_SQL, body='SELECT chrom, b AS "begin", CAST(v AS INTEGER) AS stored, CAST(v AS INTEGER) / 100.0::DOUBLE AS value, CAST(trunc(v / 100.0::DOUBLE) AS INTEGER) AS truncated FROM hr')
def fixed_point_scale(spark, sf):
    h = s.hourly(spark, sf).withColumn("real", F.col("value") / F.lit(100.0))
    return h.select("chrom", "begin", numeric.to_stored(F.col("real"), 100.0).alias("stored"), F.col("real").alias("value"), numeric.to_stored(F.col("real"), None).alias("truncated"))


def _need_sql() -> str:
    cases = " ".join(f"WHEN abs(round(value * 1e{k}) - value * 1e{k}) <= 1e-10 THEN 1e{k}" for k in range(10))
    return f"n AS (SELECT CASE WHEN abs(value) < 1e-10 THEN 1.0 {cases} ELSE 1e10 END AS need, abs(value) AS a FROM events), m AS (SELECT max(need) AS need, max(a) AS top FROM n)"


@query(_need_sql(), body="SELECT CAST(CASE " + " ".join(f"WHEN top * 1e{k} <= 2147483647 AND need >= 1e{k} THEN 1e{k}" for k in range(10, -1, -1)) + " ELSE 1.0 END AS DOUBLE) AS denominator FROM m")
def denominator_detect(spark, sf):
    return numeric.denominator_of(s.table(spark, sf, "events").select("value"))


_CURVE = """dd AS (SELECT CAST(unnest(range(17)) AS INTEGER) AS d),
hi AS (SELECT d, chrom, b, e FROM runs JOIN dd ON v >= power(2.0, d)),
isl AS (SELECT d, count(*) AS n FROM (SELECT d, CASE WHEN lag(e) OVER (PARTITION BY d, chrom ORDER BY b) = b THEN 0 ELSE 1 END AS n FROM hi) WHERE n = 1 GROUP BY d),
cc AS (SELECT dd.d, CAST(coalesce(n, 0) AS BIGINT) AS n_runs, CAST(coalesce(n, 0) * 80 + dd.d * (SELECT sum(e - b) FROM runs) AS BIGINT) AS bits FROM dd LEFT JOIN isl USING (d))"""


@query(s.BASE_SQL, _CURVE, body="SELECT d, n_runs, bits FROM cc")
def dict_cost_curve(spark, sf):
    return numeric.cost_curve(s.runs(spark, sf), ["chrom"], T)


@query(s.BASE_SQL, _CURVE, body="SELECT d, bits FROM cc ORDER BY bits, d LIMIT 1")
def auto_dict_bits(spark, sf):
    return numeric.best_width(numeric.cost_curve(s.runs(spark, sf), ["chrom"], T))


# --- catalogue and views --------------------------------------------------------


@query(s.GENOME_SQL, body="SELECT chrom, CAST(size AS BIGINT) AS size, CAST(chrom_id AS INTEGER) AS chrom_id FROM genome")
def genome_sizes(spark, sf):
    return s.genome(spark)


@query(body="SELECT DISTINCT 'signals:' || l_linestatus AS track FROM lineitem")
def list_tracks(spark, sf):
    return s.reads(spark, sf).select(F.concat_ws(":", F.lit("signals"), "track").alias("track")).distinct()


@query(s.TRACKS_SQL, body=f"SELECT track, {RUN_COLS}, v AS value FROM mruns WHERE regexp_matches(track, '^F')")
def track_filter_regex(spark, sf):
    return s.track_runs(spark, sf).where(F.col("track").rlike("^F"))


@query(s.TRACKS_SQL, body=f"SELECT track, {RUN_COLS}, v AS value FROM mruns WHERE track = (SELECT min(track) FROM mruns)")
def first_track(spark, sf):
    runs = s.track_runs(spark, sf)
    return runs.join(runs.agg(F.min("track").alias("track")), "track", "left_semi")


_CLIP = "cl AS (SELECT region_id, chrom, greatest(rb, b) AS b, least(re, e) AS e, v FROM ov WHERE w > 0)"


@query(*OV, _CLIP, s.merged_sql("cl", "region_id, chrom", "v"), body=f"SELECT region_id, {RUN_COLS}, v AS value FROM merged")
def view_region_rle(spark, sf):
    cut = intervals.clipped(s.regions(spark), s.runs(spark, sf), BIN)
    return intervals.merge_runs(cut, ["region_id", "chrom"], ["value"], T)


@query(s.BASE_SQL, body=f"SELECT {RUN_COLS}, v AS value FROM runs")
def view_ordered(spark, sf):
    """Views come in the genome's order; rows alone are compared."""
    g = s.genome(spark)
    return s.runs(spark, sf).join(F.broadcast(g), "chrom").orderBy("chrom_id", "begin").select("chrom", "begin", "end", "value")


@query(*OV, "px AS (SELECT region_id, chrom, unnest(range(greatest(rb, b), least(re, e))) AS pos, v FROM ov WHERE w > 0)", body="SELECT region_id, chrom, CAST(pos AS BIGINT) AS pos, v AS value FROM px")
def enumerate_values(spark, sf):
    cut = intervals.clipped(s.regions(spark), s.runs(spark, sf), BIN)
    return cut.select("region_id", "chrom", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"), "value")


@query(s.BASE_SQL, body=f"SELECT {RUN_COLS}, v AS value FROM runs WHERE chrom = 'N' AND b < 900 AND e > 400")
def range_view(spark, sf):
    return s.runs(spark, sf).where("chrom = 'N' AND `begin` < 900 AND `end` > 400")


# --- statistics -------------------------------------------------------------------


@query(*OV, body=_region("CAST(coalesce(sum(v * w), 0) AS BIGINT) AS sum"))
def region_sum(spark, sf):
    return stats.region_sum(s.regions(spark), s.runs(spark, sf), BIN)


@query(*OV, body=_region("CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS mean"))
def region_mean(spark, sf):
    return stats.region_mean(s.regions(spark), s.runs(spark, sf), BIN)


@query(s.REGIONS_SQL, body=f"SELECT {REGION_COLS}, re - rb AS count FROM rg")
def region_count(spark, sf):
    return stats.region_count(s.regions(spark))


@query(*OV, body=_region("coalesce(min(v), 2147483647) AS min_value, coalesce(max(v), -2147483648) AS max_value"))
def region_min_max(spark, sf):
    return stats.region_min_max(s.regions(spark), s.runs(spark, sf), BIN)


@query(*OV, body=_region("CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS mean") + " HAVING sum(w) IS NULL OR sum(w) < re - rb")
def region_mean_no_data_default(spark, sf):
    odd = s.regions(spark, [r for r in s.REGION_ROWS if r[3] > s.SIZE or r[1] not in s.CHROMS])
    return stats.region_mean(odd, s.runs(spark, sf), BIN)


@query(*OV, body=_region("CAST(coalesce(sum(v * w), 0) AS BIGINT) AS sum, count(w) AS n_runs") + " HAVING rb BETWEEN 100 AND 250")
def overlapping_duplicate_regions(spark, sf):
    few = s.regions(spark, [r for r in s.REGION_ROWS if 100 <= r[2] <= 250])
    return stats.per_region(few, s.runs(spark, sf), F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0)).cast("long").alias("sum"), F.count("w").alias("n_runs"), bin_width=BIN)


@query(s.BASE_SQL, "h AS (SELECT v, sum(e - b) AS n FROM runs GROUP BY v)", body="""SELECT CAST(i AS VARCHAR) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(5, 400)) AS i) LEFT JOIN h ON i = v
UNION ALL SELECT 'below', CAST(coalesce(sum(n), 0) AS BIGINT) FROM h WHERE v < 5 UNION ALL SELECT 'above', CAST(coalesce(sum(n), 0) AS BIGINT) FROM h WHERE v >= 400""")
def hist_global(spark, sf):
    return stats.histogram(s.runs(spark, sf), 5, 400)


@query(*OV, body=_region("CAST(coalesce(sum(w) FILTER (v < 5), 0) AS BIGINT) AS below, CAST(coalesce(sum(w) FILTER (v >= 5 AND v < 50), 0) AS BIGINT) AS inside, CAST(coalesce(sum(w) FILTER (v >= 50), 0) AS BIGINT) AS above"))
def hist_region_below_above(spark, sf):
    return stats.region_histogram(s.regions(spark), s.runs(spark, sf), 5, 50, BIN)


_CUM = "cv AS (SELECT region_id, chrom, rb, re, v, sum(w) AS n FROM ov GROUP BY ALL), cu AS (SELECT *, sum(n) OVER (PARTITION BY region_id ORDER BY v) AS cum, sum(n) OVER (PARTITION BY region_id) AS total FROM cv)"


def _compat(p: float, high: int) -> str:
    return f"SELECT {REGION_COLS}, CAST(CASE WHEN coalesce(max(cum) FILTER (v < 0), 0) >= coalesce(max(round(total * {p})), 0) THEN 0 ELSE coalesce(min(v + 1) FILTER (v >= 0 AND v < {high} AND cum >= round(total * {p})), {high}) END AS INTEGER) AS percentile FROM cu GROUP BY region_id, chrom, rb, re"


@query(*OV, _CUM, body=_compat(0.5, 1000))
def percentile_compat_p50(spark, sf):
    return stats.region_percentile(s.regions(spark), s.runs(spark, sf), 0.5, "compat", 1000, BIN)


@query(*OV, _CUM, body=_compat(0.95, 30))
def percentile_compat_p95(spark, sf):
    return stats.region_percentile(s.regions(spark), s.runs(spark, sf), 0.95, "compat", 30, BIN)


@query(*OV, _CUM, body=f"SELECT {REGION_COLS}, min(v) FILTER (cum >= ceil(total * 0.5)) AS percentile FROM cu GROUP BY region_id, chrom, rb, re")
def percentile_exact_p50(spark, sf):
    return stats.region_percentile(s.regions(spark), s.runs(spark, sf), 0.5, bin_width=BIN)


@query(*OV, body=_region(", ".join(f"CAST(coalesce(sum(w) FILTER (v >= {t}), 0) AS DOUBLE) / (re - rb) AS cov_{t}" for t in (1, 20, 50))))
def perc_cov_thresholds(spark, sf):
    return stats.coverage_above(s.regions(spark), s.runs(spark, sf), [1, 20, 50], BIN)


@query(s.BASE_SQL, "m AS (SELECT chrom, sum(CAST(e - b AS DOUBLE)) AS n, sum(CASE WHEN v >= 0 AND v < 1000 THEN CAST(v AS DOUBLE) * (e - b) END) AS s1, sum(CASE WHEN v >= 0 AND v < 1000 THEN CAST(v AS DOUBLE) * v * (e - b) END) AS s2 FROM runs GROUP BY chrom)", body="SELECT chrom, round(s1 / n, 6) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)), 6) AS std FROM m")
def hist_mean_std(spark, sf):
    return stats.moments(s.runs(spark, sf), ("chrom",)).select("chrom", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(s.BASE_SQL, body="SELECT chrom, 100.0::DOUBLE * CAST(coalesce(sum(e - b) FILTER (v <= 40), 0) AS DOUBLE) / CAST(sum(e - b) AS DOUBLE) AS percent FROM runs GROUP BY chrom")
def percentile_below(spark, sf):
    return stats.share_below(s.runs(spark, sf), 40, ("chrom",))


@query(s.BASE_SQL, body="SELECT CAST(sum(v * (e - b)) AS DOUBLE) / CAST(sum(e - b) AS DOUBLE) AS coverage, CAST(sum(e - b) AS BIGINT) AS positions FROM runs")
def coverage_total(spark, sf):
    return stats.total_coverage(s.runs(spark, sf))


# --- several tracks ---------------------------------------------------------------

_ALIGN = "cuts AS (SELECT DISTINCT chrom, unnest([b, e]) AS b FROM mruns), pc AS (SELECT chrom, b, lead(b) OVER (PARTITION BY chrom ORDER BY b) AS e FROM cuts), wi AS (SELECT pc.chrom, pc.b, pc.e, max(v) FILTER (track = 'F') AS f, max(v) FILTER (track = 'O') AS o FROM pc JOIN mruns m ON m.chrom = pc.chrom AND m.b <= pc.b AND m.e >= pc.e GROUP BY ALL)"
ALIGN = (s.TRACKS_SQL, _ALIGN, s.merged_sql("wi", "chrom", "f, o"))


@query(*ALIGN, body=f'SELECT {RUN_COLS}, f AS "F", o AS "O" FROM merged')
def multitrack_align(spark, sf):
    return intervals.aligned(s.track_runs(spark, sf), ["F", "O"], T)


@query(s.TRACKS_SQL, _ALIGN, s.merged_sql("wi", "chrom", "f, o"), body=f'SELECT {RUN_COLS}, f AS "F", o AS "O" FROM merged WHERE f <> 0 OR o <> 0')
def view_drop_zero(spark, sf):
    return intervals.aligned(s.track_runs(spark, sf), ["F", "O"], T).where(F.exists(F.array("F", "O"), lambda x: x != 0))


@query(*ALIGN, body="SELECT chrom, CAST(sum(e - b) AS BIGINT) AS positions FROM merged WHERE f > 10 AND o > 10 GROUP BY chrom")
def all_tracks_above(spark, sf):
    both = intervals.aligned(s.track_runs(spark, sf), ["F", "O"], T).where(F.forall(F.array("F", "O"), lambda x: x > 10))
    return both.groupBy("chrom").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("positions"))


MOV = (s.TRACKS_SQL, s.REGIONS_SQL, "ov AS (SELECT rg.*, track, v, CASE WHEN b IS NOT NULL THEN least(re, e) - greatest(rb, b) END AS w FROM rg LEFT JOIN mruns ON rg.chrom = mruns.chrom AND b < re AND e > rb)")


@query(*MOV, body=_region("CAST(coalesce(sum(v * w) FILTER (track = 'F') / sum(w) FILTER (track = 'F'), 0) AS DOUBLE) AS \"F\", CAST(coalesce(sum(v * w) FILTER (track = 'O') / sum(w) FILTER (track = 'O'), 0) AS DOUBLE) AS \"O\""))
def multitrack_mean_pivot(spark, sf):
    return stats.by_track(s.regions(spark), s.track_runs(spark, sf), ["F", "O"], "mean", BIN)


@query(s.BASE_SQL, s.pileup_sql("mruns", "track, chrom"), body="SELECT tag, count(*) AS n, CAST(sum(v * (e - b)) AS BIGINT) AS total FROM (SELECT 'all' AS tag, b, e, v FROM runs UNION ALL SELECT 'open' AS tag, b, e, v FROM mruns WHERE track = 'O') GROUP BY tag")
def merge_tracks(spark, sf):
    from tracklake.api import merged

    both = merged({"all": s.runs(spark, sf), "open": s.track_runs(spark, sf).where("track = 'O'")})
    return both.groupBy(F.col("track").alias("tag")).agg(F.count("*").alias("n"), F.sum(F.col("value") * (F.col("end") - F.col("begin"))).cast("long").alias("total"))


@query(s.TRACKS_SQL, body="SELECT chrom, CAST(size AS BIGINT) AS size, 'missing' AS fault FROM (SELECT chrom, size FROM genome WHERE chrom <> 'N') EXCEPT SELECT chrom, CAST(size AS BIGINT), 'missing' FROM genome UNION ALL SELECT chrom, CAST(size AS BIGINT), 'unexpected' FROM genome WHERE chrom = 'N'")
def genome_consistency(spark, sf):
    from tracklake.api import genome_faults

    g = s.genome(spark)
    return genome_faults(g.where("chrom <> 'N'"), g)


# --- down-sampling and islands -------------------------------------------------------


def _binned(width: str, source: str = "wh") -> str:
    return f"bn AS (SELECT region_id AS source_id, chrom, CAST(unnest(range(CAST(ceil((re - rb) / {width}::DOUBLE) AS BIGINT))) AS BIGINT) AS bin, rb AS r0, re AS r1 FROM {source}), rg AS (SELECT source_id, bin, chrom, CAST(r0 + bin * {width} AS BIGINT) AS rb, CAST(least(r0 + (bin + 1) * {width}, r1) AS BIGINT) AS re, source_id * 100000 + bin AS region_id FROM bn)"


BINS = (s.BASE_SQL, s.WHOLE_SQL)


@query(*BINS, _binned("70"), s.OVERLAPS_SQL, body='SELECT source_id, bin, chrom, rb AS "begin", re AS "end", CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS mean FROM ov GROUP BY ALL')
def resample_mean(spark, sf):
    return resample.resampled(s.regions(spark, s.WHOLE_ROWS), s.runs(spark, sf), 70, "mean", BIN)


@query(*BINS, _binned("70"), s.OVERLAPS_SQL, "cv AS (SELECT source_id, bin, chrom, rb, re, v, sum(w) AS n FROM ov GROUP BY ALL), cu AS (SELECT *, sum(n) OVER (PARTITION BY source_id, bin ORDER BY v) AS cum, sum(n) OVER (PARTITION BY source_id, bin) AS total FROM cv)", body='SELECT source_id, bin, chrom, rb AS "begin", re AS "end", min(v) FILTER (cum >= ceil(total * 0.5)) AS median FROM cu GROUP BY ALL')
def resample_median(spark, sf):
    return resample.resampled(s.regions(spark, s.WHOLE_ROWS), s.runs(spark, sf), 70, "median", BIN)


@query(*BINS, f"bn AS (SELECT region_id AS source_id, chrom, CAST(unnest(range(256)) AS BIGINT) AS bin, rb AS r0, (re - rb + 1) // 256 AS k, (re - rb + 1) % 256 AS m FROM wh), rg AS (SELECT source_id, bin, chrom, r0 + bin * k + least(bin, m) AS rb, r0 + (bin + 1) * k + least(bin + 1, m) AS re FROM bn)", s.OVERLAPS_SQL, body="SELECT source_id, bin, CAST((rb + re) // 2 AS BIGINT) AS x, CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS y FROM ov WHERE rb < re GROUP BY source_id, bin, rb, re")
def plot_bins_256(spark, sf):
    return resample.plot_bins(s.regions(spark, s.WHOLE_ROWS), s.runs(spark, sf), 256, BIN)


@query(*BINS, _binned("3"), s.OVERLAPS_SQL, body='SELECT source_id, bin, rb AS "begin", re AS "end", CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS mean FROM ov GROUP BY ALL')
def server_bins_1000(spark, sf):
    return resample.server_bins(s.regions(spark, s.WHOLE_ROWS), s.runs(spark, sf), 1000, BIN)


_ISL = f"hi AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY chrom ORDER BY b) = b THEN 0 ELSE 1 END AS n FROM runs WHERE v > {ISLAND}), gi AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY b) AS g FROM hi), si AS (SELECT chrom, min(b) AS b, max(e) AS e, sum(v * (e - b)) AS total FROM gi GROUP BY chrom, g)"


@query(s.BASE_SQL, _ISL, body=f"SELECT {RUN_COLS} FROM si WHERE e - b > {ISLAND_LEN}")
def islands_high(spark, sf):
    return intervals.islands(s.runs(spark, sf).where(F.col("value") > ISLAND), ["chrom"], T).where(F.col("end") - F.col("begin") > ISLAND_LEN).select("chrom", "begin", "end")


@query(s.BASE_SQL, _ISL, body=f"SELECT {RUN_COLS}, CAST(total AS DOUBLE) / (e - b) AS mean FROM si WHERE e - b > {ISLAND_LEN}")
def islands_high_mean(spark, sf):
    out = intervals.islands(s.runs(spark, sf).where(F.col("value") > ISLAND), ["chrom"], T)
    return out.where(F.col("end") - F.col("begin") > ISLAND_LEN).select("chrom", "begin", "end", (F.col("total") / (F.col("end") - F.col("begin"))).alias("mean"))


@query(
    s.TRACKS_SQL,
    s.REGIONS_SQL.replace("rg AS", "wh AS"),
    _binned("50").replace("FROM wh", "FROM (SELECT * FROM wh WHERE re <= 3000 AND chrom <> 'Z')"),
    "us AS (SELECT chrom, sum(v * (e - b)) FILTER (track = 'F') / sum(e - b) FILTER (track = 'F') AS uf, sum(v * (e - b)) FILTER (track = 'O') / sum(e - b) FILTER (track = 'O') AS uo FROM mruns GROUP BY chrom)",
    "ov AS (SELECT rg.*, track, v, CASE WHEN b IS NOT NULL THEN least(re, e) - greatest(rb, b) END AS w FROM rg LEFT JOIN mruns ON rg.chrom = mruns.chrom AND b < re AND e > rb)",
    "mm AS (SELECT source_id, bin, chrom, coalesce(sum(v * w) FILTER (track = 'F') / sum(w) FILTER (track = 'F'), 0) AS f, coalesce(sum(v * w) FILTER (track = 'O') / sum(w) FILTER (track = 'O'), 0) AS o FROM ov GROUP BY ALL)",
    body="SELECT source_id, count(*) AS bins, CAST(sum(CASE WHEN f / uf < 0.9 AND abs(o / uo - 1) < 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits, sum(CASE WHEN f / uf < 0.9 AND abs(o / uo - 1) < 0.6 THEN 1 ELSE 0 END) > 0.8 * count(*) AS is_candidate FROM mm LEFT JOIN us USING (chrom) GROUP BY source_id",
)
def denovo_windows(spark, sf):
    whole = s.regions(spark, [r for r in s.REGION_ROWS if r[3] <= s.SIZE and r[1] in s.CHROMS])
    return resample.deletion_windows(whole, s.track_runs(spark, sf), "F", ["O"], 50, 0.6, 0.9, BIN)


# --- index -----------------------------------------------------------------------------


@query(s.BASE_SQL, "cx AS (SELECT chrom, b, e, v, unnest(range(b // 128, (e - 1) // 128 + 1)) AS bin FROM runs)", body=f'SELECT chrom, CAST(bin AS BIGINT) AS bin, CAST(bin * 128 AS BIGINT) AS "begin", CAST(least((bin + 1) * 128, {s.SIZE}) AS BIGINT) AS "end", CAST(sum(v * (least(e, (bin + 1) * 128) - greatest(b, bin * 128))) AS DOUBLE) AS sum FROM cx GROUP BY chrom, bin')
def sum_index_build(spark, sf):
    return index.build(s.runs(spark, sf), 128)


@query(*OV, body=_region("CAST(coalesce(sum(v * w), 0) AS DOUBLE) AS sum, CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS mean"))
def sum_index_query(spark, sf):
    runs = s.runs(spark, sf)
    return index.query(s.regions(spark), runs, index.build(runs, 128), 128, BIN)


@query(s.BASE_SQL, "cx AS (SELECT chrom, b, e, v, unnest(range(b // 65536, (e - 1) // 65536 + 1)) AS bin FROM runs)", body=f"SELECT chrom, CAST(bin * 65536 AS BIGINT) AS \"begin\", CAST(least((bin + 1) * 65536, {s.SIZE}) AS BIGINT) AS \"end\", printf('Sum(%.5f)', CAST(sum(v * (least(e, (bin + 1) * 65536) - greatest(b, bin * 65536))) AS DOUBLE)) AS sum FROM cx GROUP BY chrom, bin")
def index_listing(spark, sf):
    return serve.index_lines(_file(spark, sf).with_index())


# --- text sources and sinks, cursors, other shapes -----------------------------------------


def _file(spark, sf) -> TrackFile:
    return TrackFile(Track(s.runs(spark, sf).select(F.lit("depth").alias("track"), "chrom", "begin", "end", "value"), s.genome(spark), tile=T))


def _lines(spark, sf, rows, purpose) -> str:
    """Lines of text written to the shared folder."""
    path = files.scratch(spark, purpose)
    rows.write.text(path)
    return path


_EV = "ev AS (SELECT event_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS h, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def _events(spark, sf):
    hour = F.expr("datediff(to_date(ts), '2024-01-01') * 24 + hour(ts)").cast("long")
    return s.table(spark, sf, "events").select("event_id", "event_type", hour.alias("h"), F.round(F.col("value") * 100).cast("long").alias("v"))


@query(_EV, body="SELECT event_type AS chrom, CAST(h AS BIGINT) AS \"begin\", CAST(CASE WHEN event_id % 2 = 0 THEN h + 3 ELSE h + 1 END AS BIGINT) AS \"end\", CAST(v AS DOUBLE) / 100 AS value FROM ev WHERE event_id % 5 <> 0")
def bedgraph_source(spark, sf):
    """Intervals of four columns, points of three, and lines that are neither."""
    e = _events(spark, sf)
    value = (F.col("v") / F.lit(100.0)).cast("string")
    line = F.when(F.col("event_id") % 5 == 0, F.concat_ws("\t", "event_type", F.lit("x"), "h", value)).when(F.col("event_id") % 2 == 0, F.concat_ws("\t", "event_type", "h", F.col("h") + 3, value)).otherwise(F.concat_ws("\t", "event_type", "h", value))
    return text.bedgraph(spark, _lines(spark, sf, e.select(line.alias("value")), "bedgraph"))


@query(body="SELECT n_name AS chrom, CAST(1000 + n_nationkey AS BIGINT) AS size FROM nation WHERE n_nationkey % 7 <> 0 AND n_name NOT LIKE '% %'")
def genome_source(spark, sf):
    n = s.table(spark, sf, "nation").where("NOT n_name LIKE '% %'")
    line = F.concat_ws("\t", "n_name", F.when(F.col("n_nationkey") % 7 == 0, F.lit("unknown")).otherwise((F.col("n_nationkey") + 1000).cast("string")))
    return text.genome(spark, _lines(spark, sf, n.select(line.alias("value")), "genome")).select("chrom", "size")


_BED = "SELECT l_returnflag AS chrom, CAST(l_linenumber * 10 AS BIGINT) AS \"begin\", CAST(l_linenumber * 10 + l_suppkey AS BIGINT) AS \"end\" FROM lineitem WHERE l_linenumber < 6"


def _bed(spark, sf, bad: bool):
    x = s.table(spark, sf, "lineitem").where("l_linenumber < 6 OR l_linenumber = 6 AND l_partkey % 2 = 0")
    line = F.concat_ws("\t", "l_returnflag", F.col("l_linenumber") * 10, F.col("l_linenumber") * 10 + F.col("l_suppkey"), F.lit("further"))
    return x.select(F.when(F.col("l_linenumber") < 6, line).otherwise(F.lit("# note" if not bad else "no region")).alias("value"))


@query(body=_BED)
def bed_source(spark, sf):
    return text.bed(spark, _lines(spark, sf, _bed(spark, sf, True), "bed")).drop("region_id")


@query(body=_BED)
def bed_source_strict(spark, sf):
    return text.bed(spark, _lines(spark, sf, _bed(spark, sf, False), "bed"), strict=True).drop("region_id")


@query(body="SELECT DISTINCT p_size AS value FROM part")
def dictionary_source(spark, sf):
    rows = s.table(spark, sf, "part").select(F.col("p_size").cast("string").alias("value")).distinct().unionByName(spark.createDataFrame([("none",)], "value string"))
    return text.dictionary(spark, _lines(spark, sf, rows, "dictionary"))


@query(s.BASE_SQL, body=f"SELECT {RUN_COLS}, CAST(v AS DOUBLE) AS value FROM runs")
def bedgraph_sink(spark, sf):
    """Written as text with a header, and read back."""
    path = files.scratch(spark, "bedgraph")
    text.write_bedgraph(s.runs(spark, sf), path, header=True)
    return text.bedgraph(spark, path)


_ALN = "al AS (SELECT l_orderkey, l_linenumber, l_returnflag AS chrom, l_suppkey AS b, CAST(l_quantity AS INTEGER) AS q, CAST(16 * (l_linenumber % 2) AS INTEGER) AS f, l_partkey % 40 + 1 AS m, l_linenumber AS d FROM lineitem)"


@query(_ALN, body="SELECT chrom, CAST(b AS BIGINT) AS \"begin\", CAST(b + 2 * m + d AS BIGINT) AS \"end\", q AS mapq, f AS flag FROM al")
def alignment_text_source(spark, sf):
    x = s.table(spark, sf, "lineitem")
    m, one = F.col("l_partkey") % 40 + 1, lambda v: F.lit(v).cast("string")
    cigar = F.concat(one("2S"), m.cast("string"), one("M1I"), F.col("l_linenumber").cast("string"), one("D"), m.cast("string"), one("M"))
    line = F.concat_ws("\t", F.concat(one("r"), "l_orderkey"), 16 * (F.col("l_linenumber") % 2), "l_returnflag", F.col("l_suppkey") + 1, F.col("l_quantity").cast("int"), cigar, one("*"), one("0"), one("0"), one("*"), one("*"))
    rows = x.select(line.alias("value")).unionByName(spark.createDataFrame([("@HD\tVN:1.6",)], "value string"))
    return alignment.sam(spark, _lines(spark, sf, rows, "alignments")).select("chrom", "begin", "end", "mapq", "flag")


@query(s.BASE_SQL, body=f"SELECT 'depth' AS track, chrom, CAST(greatest(b, 777) AS BIGINT) AS \"begin\", e AS \"end\", v AS value FROM runs WHERE chrom = 'R' AND e > 777")
def seek_from_position(spark, sf):
    return _file(spark, sf).from_position("R", 777)


@query(s.GENOME_SQL, body="SELECT chrom, CAST(b AS BIGINT) AS \"begin\", CAST(least(b + 696, size) AS BIGINT) AS \"end\" FROM (SELECT chrom, size, unnest(range(0, size, 696)) AS b FROM genome)")
def scan_partitions(spark, sf):
    return _file(spark, sf).partitions(700).drop("region_id")


@query(s.BASE_SQL, body="SELECT chrom, CAST(unnest(range(b, e)) AS BIGINT) AS pos, v AS value FROM runs WHERE v > 60")
def positions_by_table_function(spark, sf):
    tables.register(spark)
    s.runs(spark, sf).where("value > 60").createOrReplaceTempView("runs_above_60")
    return spark.sql("SELECT r.chrom, p.pos, p.value FROM runs_above_60 r, LATERAL positions(r.begin, r.end, r.value) p")


@query(s.BASE_SQL, "pt AS (SELECT chrom, CAST(unnest(range(-3, 3000, 37)) AS BIGINT) AS pos FROM genome)", "hi AS (SELECT * FROM runs WHERE v > 40)", body='SELECT chrom, pos, CAST(h.b AS BIGINT) AS "begin", CAST(h.e AS BIGINT) AS "end", h.v AS value FROM pt ASOF LEFT JOIN hi h USING (chrom) WHERE false UNION ALL SELECT pt.chrom, pt.pos, m.b, m.e, m.v FROM pt LEFT JOIN LATERAL (SELECT b, e, v FROM hi WHERE hi.chrom = pt.chrom AND hi.b <= pt.pos ORDER BY b DESC LIMIT 1) m ON true')
def as_of_run(spark, sf):
    points = s.genome(spark).select("chrom", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(2999).cast("long"), F.lit(37).cast("long"))).alias("pos"))
    return intervals.last_before(points, s.runs(spark, sf).where("value > 40"), T)


_OVER = "sec AS (SELECT chrom, b, e, v + 1000 AS v FROM runs WHERE v > 40), co AS (SELECT r.chrom, r.b, r.e, CASE WHEN r.v > 40 THEN r.v + 1000 ELSE 0 END AS v FROM runs r)"


@query(s.BASE_SQL, _OVER, s.merged_sql("co", "chrom", "v"), body=f"SELECT {RUN_COLS}, v AS value FROM merged")
def secondary_coalesce(spark, sf):
    """A table of zeros with runs laid over it."""
    zeros = s.genome(spark).select("chrom", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"), F.lit(0).alias("value"))
    over = s.runs(spark, sf).where("value > 40").withColumn("value", F.col("value") + 1000)
    return intervals.coalesced(zeros, over, T)


@query(body="SELECT chrom FROM (VALUES ('chr1'), ('chr22'), ('chrX'), ('chr'), ('1'), ('chr1_alt'), ('xchr3')) AS t(chrom) WHERE regexp_full_match(chrom, 'chr[0-9]+')")
def numbered_chromosomes(spark, sf):
    return regions.numbered(spark.createDataFrame([(c,) for c in ("chr1", "chr22", "chrX", "chr", "1", "chr1_alt", "xchr3")], "chrom string"))


@query(*BINS, _binned("65536"), s.OVERLAPS_SQL, body='SELECT source_id, bin, chrom, rb AS "begin", re AS "end", CAST(coalesce(sum(v * w) / sum(w), 0) AS DOUBLE) AS mean FROM ov GROUP BY ALL')
def resample_for_index(spark, sf):
    return _file(spark, sf).resample(70, s.regions(spark, s.WHOLE_ROWS), for_index=True)


@query(s.TRACKS_SQL, s.WHOLE_SQL, _binned("70"), "ov AS (SELECT rg.*, track, v, CASE WHEN b IS NOT NULL THEN least(re, e) - greatest(rb, b) END AS w FROM rg LEFT JOIN mruns ON rg.chrom = mruns.chrom AND b < re AND e > rb)", body="SELECT source_id, bin, chrom, rb AS \"begin\", re AS \"end\", CAST(coalesce(sum(v * w) FILTER (track = 'F') / sum(w) FILTER (track = 'F'), 0) AS DOUBLE) AS \"F\", CAST(coalesce(sum(v * w) FILTER (track = 'O') / sum(w) FILTER (track = 'O'), 0) AS DOUBLE) AS \"O\" FROM ov GROUP BY ALL")
def matrix_resample(spark, sf):
    return TrackFile(Track(s.track_runs(spark, sf), s.genome(spark), tile=T)).matrix_resample(70, s.regions(spark, s.WHOLE_ROWS))


@query(*OV, "cl AS (SELECT region_id, greatest(rb, b) AS b, v, w FROM ov WHERE w > 0)", body="SELECT region_id, CAST(sum(w) FILTER (v > 10) AS BIGINT) AS above, count(*) AS runs FROM cl GROUP BY region_id HAVING sum(w) FILTER (v > 10) > 0")
def user_aggregate(spark, sf):
    """A user's own aggregate over the rows of each region."""

    def above(rows):
        import pandas as pd

        n = int((rows["end"] - rows["begin"])[rows["value"] > 10].sum())
        return pd.DataFrame({"region_id": rows["region_id"][:1] if n else [], "above": [n] if n else [], "runs": [len(rows)] if n else []})

    return _file(spark, sf).apply(s.regions(spark), above, "region_id long, above long, runs long")


@query(s.BASE_SQL, body="SELECT chrom, CAST(sum(e - b) AS BIGINT) AS positions FROM runs WHERE v % 2 = 1 GROUP BY chrom")
def user_scan(spark, sf):
    """A user's own scan over each task's runs, finished by a partial aggregate."""

    def odd(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            x = b.filter(pc.equal(pc.bit_wise_and(b["value"], 1), 1))
            yield pa.RecordBatch.from_arrays([x["chrom"], pc.subtract(x["end"], x["begin"])], names=["chrom", "positions"])

    return _file(spark, sf).scan(odd, "chrom string, positions long").groupBy("chrom").agg(F.sum("positions").alias("positions"))


@query(body="SELECT event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_property(spark, sf):
    return s.table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


# --- functions ---------------------------------------------------------------------------

_CIGARS = ["10M", "5M2I3D1N", "3S10=2X4H", "", "100M50N100M", "7P3M"]
_LENGTHS = [sum(int(n) for n, o in __import__("re").findall(r"(\d+)([A-Z=])", c) if o in reads.ON_REFERENCE) for c in _CIGARS]


@query(body="SELECT cigar, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS INTEGER))), 0) AS INTEGER) AS ref_length FROM (VALUES " + ", ".join(f"('{c}')" for c in _CIGARS) + ") AS t(cigar)")
def cigar_ref_length(spark, sf):
    return spark.createDataFrame([(c,) for c in _CIGARS], "cigar string").select("cigar", reads.reference_length("cigar").alias("ref_length"))


@query(body="SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_tumbling_bins(spark, sf):
    from tracklake.streaming import bins

    return bins.drained(spark, f"{sf}/events.parquet", "6 hours")
