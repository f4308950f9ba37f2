"""Text sources and sinks: genome sizes, BED, BedGraph, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"))
    return lines.select("line", F.split("line", r"\s+").alias("f"))


def _long(i: int):
    return F.get(F.col("f"), F.lit(i)).try_cast("long")


def genome(spark: SparkSession, path: str) -> DataFrame:
    """Two columns; lines that don't parse are skipped. ``chrom_id`` follows the file's order."""
    rows = _fields(spark, path).select(F.get("f", F.lit(0)).alias("chrom"), _long(1).alias("size"), F.monotonically_increasing_id().alias("_at")).where("size IS NOT NULL")
    found = rows.orderBy("_at").collect()  # a genome has few rows
    return spark.createDataFrame([(r["chrom"], r["size"], i) for i, r in enumerate(found)], "chrom string, size long, chrom_id int")


def bed(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Regions in file order; further columns are ignored. Comments are skipped, and so are bad lines unless ``strict``."""
    rows = _fields(spark, path).where("line <> '' AND NOT line LIKE '#%'").select(F.monotonically_increasing_id().alias("region_id"), F.get("f", F.lit(0)).alias("chrom"), _long(1).alias("begin"), _long(2).alias("end"), "line")
    bad = F.col("begin").isNull() | F.col("end").isNull()
    if strict:
        return rows.withColumn("begin", F.when(bad, F.raise_error(F.concat(F.lit("not a region: "), F.col("line"))).cast("long")).otherwise(F.col("begin"))).drop("line")
    return rows.where(~bad).drop("line")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Four columns are an interval, three a single position; other lines are skipped."""
    f = _fields(spark, path)
    value = lambda i: F.get(F.col("f"), F.lit(i)).try_cast("double")
    point = F.size("f") == 3
    rows = f.select(F.get("f", F.lit(0)).alias("chrom"), _long(1).alias("begin"), F.when(point, _long(1) + 1).otherwise(_long(2)).alias("end"), F.when(point, value(2)).otherwise(value(3)).alias("value"))
    return rows.dropna()


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One integer per line."""
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("value")).where("value IS NOT NULL")


def write_bedgraph(runs: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    """Tab-separated text, ordered by chromosome and position."""
    names = {"chrom": "#Chr", "begin": "Start", "end": "End"}
    out = runs.orderBy("chrom", "begin")
    out.select(*[F.col(c).alias(names.get(c, c)) for c in runs.columns]).write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def kind_of(path: str) -> str:
    """Input type by file name."""
    end = path.lower().rsplit(".", 1)[-1]
    kinds = {"sam": "alignment", "bam": "alignment", "cram": "alignment", "bw": "bigwig", "bigwig": "bigwig", "txt": "bedgraph", "bedgraph": "bedgraph"}
    if end not in kinds:
        raise ValueError(f"unknown input type: {path}")
    return kinds[end]


def exponent_text(value: str, below: float = 0.001):
    """Three decimals, or an exponent form for magnitudes under ``below``."""
    v = F.col(value)
    e = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v)))).cast("int")
    return F.when(F.abs(v) < below, F.concat(F.format_string("%.3f", v / F.pow(F.lit(10.0), e)), F.lit("e"), e.cast("string"))).otherwise(F.format_string("%.3f", v))
