"""Signals made from the driver's tables, and the same as SQL.

``reads``: line items joined to orders; chromosome = return flag, the days from
1995-01-01 between order and shipping, mapping quality = quantity, flag bits from
line status and number, track = line status. ``events``: chromosome = event type, hour
of January 2024, summed values in hundredths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.model import GENOME, REGIONS
from tracklake.operators.intervals import pileup

SIZE, HOURS, TILE = 3000, 800, 512
CHROMS = ["A", "N", "R"]
#: Overlapping, repeated, short, clipped and unknown regions.
REGION_ROWS = [(c * 40 + i, chrom, i * 75, i * 75 + 50 + (i % 5) * 40) for c, chrom in enumerate(CHROMS) for i in range(40)]
REGION_ROWS += [(120 + c, chrom, 150, 200) for c, chrom in enumerate(CHROMS)] + [(123 + c, chrom, 150, 200) for c, chrom in enumerate(CHROMS)]
REGION_ROWS += [(126 + c, chrom, 2950, 3200) for c, chrom in enumerate(CHROMS)] + [(129, "Z", 10, 60), (130, "A", 7, 8), (131, "R", 5000, 5100)]

WHOLE_ROWS = [(c, chrom, 0, SIZE) for c, chrom in enumerate(CHROMS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark) -> DataFrame:
    return spark.createDataFrame([(c, SIZE, i) for i, c in enumerate(CHROMS)], GENOME)


def regions(spark, rows=None) -> DataFrame:
    return spark.createDataFrame(REGION_ROWS if rows is None else rows, REGIONS)


def reads(spark, sf_dir) -> DataFrame:
    day = lambda c: F.datediff(F.to_date(c), F.lit("1995-01-01")).cast("long")
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_shipdate")
    j = item.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.select(F.col("l_returnflag").alias("chrom"), F.col("l_linestatus").alias("track"), day("o_orderdate").alias("o"), day("l_shipdate").alias("s"), F.col("l_quantity").cast("int").alias("mapq"), (F.when(F.col("l_linestatus") == "F", 16).otherwise(0) + (F.col("l_linenumber") % 4) * 256).cast("int").alias("flag"))
    return j.select("track", "chrom", F.least("o", "s").alias("begin"), (F.greatest("o", "s") + 1).alias("end"), "mapq", "flag")


def runs(spark, sf_dir) -> DataFrame:
    """Depth of all reads: ``(chrom, begin, end, value)``."""
    return pileup(reads(spark, sf_dir), genome(spark), tile=TILE)


def track_runs(spark, sf_dir) -> DataFrame:
    """Depth per track, each covering the genome."""
    return pileup(reads(spark, sf_dir), genome(spark), ("track", "chrom"), tile=TILE)


def hourly(spark, sf_dir) -> DataFrame:
    """Summed event values in hundredths, an hour per run, hours without events left out."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    hour = F.expr("datediff(to_date(ts), '2024-01-01') * 24 + hour(ts)").cast("long")
    s = e.groupBy(F.col("event_type").alias("chrom"), hour.alias("begin")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"))
    return s.select("chrom", "begin", (F.col("begin") + 1).alias("end"), F.col("value").cast("int").alias("value"))


def hourly_genome(spark, sf_dir) -> DataFrame:
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct()
    return types.select("chrom", F.lit(HOURS).cast("long").alias("size"), F.lit(0).alias("chrom_id"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


READS_SQL = """rd AS (SELECT track, chrom, least(o, s) AS b, greatest(o, s) + 1 AS e, mapq, flag FROM (
  SELECT l_linestatus AS track, l_returnflag AS chrom, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS o, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS s,
    CAST(l_quantity AS INTEGER) AS mapq, CAST(CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + (l_linenumber % 4) * 256 AS INTEGER) AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
GENOME_SQL = f"genome AS (SELECT * FROM (VALUES {_values([(c, SIZE, i) for i, c in enumerate(CHROMS)])}) AS g(chrom, size, chrom_id))"
_LONGS = "CAST(region_id AS BIGINT) AS region_id, chrom, CAST(rb AS BIGINT) AS rb, CAST(re AS BIGINT) AS re"
REGIONS_SQL = f"rg AS (SELECT {_LONGS} FROM (VALUES {_values(REGION_ROWS)}) AS r(region_id, chrom, rb, re))"
WHOLE_SQL = f"wh AS (SELECT {_LONGS} FROM (VALUES {_values(WHOLE_ROWS)}) AS r(region_id, chrom, rb, re))"


def pileup_sql(out: str = "runs", keys: str = "chrom", source: str = "rd", where: str = "true") -> str:
    every = "genome" if keys == "chrom" else f"(SELECT DISTINCT track FROM {source}) CROSS JOIN genome"
    return f"""{out}_st AS (SELECT {keys}, pos, sum(d) AS d FROM (SELECT {keys}, b AS pos, 1 AS d FROM {source} WHERE {where} UNION ALL SELECT {keys}, e, -1 FROM {source} WHERE {where}) GROUP BY {keys}, pos HAVING sum(d) <> 0),
{out}_cu AS (SELECT {keys}, pos AS b, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS e, sum(d) OVER (PARTITION BY {keys} ORDER BY pos) AS v FROM {out}_st),
{out}_ex AS (SELECT {keys}, size, lo, hi FROM (SELECT * FROM {every}) LEFT JOIN (SELECT {keys}, min(pos) AS lo, max(pos) AS hi FROM {out}_st GROUP BY {keys}) USING ({keys})),
{out} AS (SELECT {keys}, CAST(b AS BIGINT) AS b, CAST(e AS BIGINT) AS e, CAST(v AS INTEGER) AS v FROM (
  SELECT {keys}, b, e, v FROM {out}_cu WHERE e IS NOT NULL UNION ALL SELECT {keys}, 0, coalesce(lo, size), 0 FROM {out}_ex WHERE coalesce(lo, size) > 0
  UNION ALL SELECT {keys}, hi, size, 0 FROM {out}_ex WHERE hi < size))"""


#: Every region with each run that it overlaps, and the overlap's width.
OVERLAPS_SQL = "ov AS (SELECT rg.*, b, e, v, CASE WHEN b IS NOT NULL THEN least(re, e) - greatest(rb, b) END AS w FROM rg LEFT JOIN runs ON rg.chrom = runs.chrom AND b < re AND e > rb)"
BASE_SQL = ",\n".join((READS_SQL, GENOME_SQL, pileup_sql()))
TRACKS_SQL = ",\n".join((READS_SQL, GENOME_SQL, pileup_sql("mruns", "track, chrom")))
HOURLY_SQL = "hr AS (SELECT event_type AS chrom, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS b, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2)"


def merged_sql(source: str, keys: str, values: str, out: str = "merged") -> str:
    """Run-length merging of ``source(keys, b, e, values)``."""
    same = " AND ".join(f"{v} IS NOT DISTINCT FROM lag({v}) OVER p" for v in values.split(", "))
    firsts = ", ".join(f"any_value({v}) AS {v}" for v in values.split(", "))
    return f"""{out}_n AS (SELECT *, CASE WHEN lag(e) OVER p = b AND {same} THEN 0 ELSE 1 END AS n FROM {source} WINDOW p AS (PARTITION BY {keys} ORDER BY b)),
{out}_g AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY b) AS g FROM {out}_n),
{out} AS (SELECT {keys}, CAST(min(b) AS BIGINT) AS b, CAST(max(e) AS BIGINT) AS e, {firsts} FROM {out}_g GROUP BY {keys}, g)"""
