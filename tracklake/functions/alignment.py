"""Alignments: flag filters, CIGAR strings, base codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that move along the reference.
ON_REFERENCE = "MDN=X"


def flag_filter(spec: str | None) -> Column:
    """``n`` asks for exactly these flags, ``+n`` for all of these bits, ``-n`` or ``~n`` for none; comma separated."""
    ok = F.lit(True)
    for part in (spec or "").split(","):
        part = part.strip()
        if not part:
            continue
        if not re.fullmatch(r"[+~-]?(0x[0-9a-fA-F]+|\d+)", part):
            raise ValueError(f"not a flag: {part!r}")
        bits, flag = int(part.lstrip("+-~"), 0), F.col("flag")
        ok = ok & (flag.bitwiseAND(bits) == bits if part[0] == "+" else flag.bitwiseAND(bits) == 0 if part[0] in "-~" else flag == bits)
    return ok


def passing(reads: DataFrame, min_mapq: int = 60, flags: str | None = None, chrom: str | None = None) -> DataFrame:
    out = reads.where((F.col("mapq") >= min_mapq) & flag_filter(flags))
    return out if chrom is None else out.where(F.col("chrom").rlike(chrom))


def cigar_ops(cigar: str | Column) -> Column:
    """``array<struct<op, len>>``."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("len")))


def reference_length(cigar: str | Column) -> Column:
    """Reference positions that an alignment spans, deletions and skips included."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda acc, x: acc + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0))


def base_of(code: Column) -> Column:
    """The base of a 4-bit code; N for any other."""
    return F.when(code == 1, "A").when(code == 2, "C").when(code == 4, "G").when(code == 8, "T").otherwise("N")


def base_map(cigar: Column, sequence: Column, begin: Column) -> Column:
    """``array<struct<op, ref_pos, base>>``, one per read or reference position an operation consumes."""
    start = F.struct(begin.cast("long").alias("ref"), F.lit(1).alias("read"), F.expr("cast(array() as array<struct<op:string,ref_pos:bigint,base:string>>)").alias("out"))

    def step(acc, x):
        on_ref, on_read = x["op"].isin(*ON_REFERENCE), x["op"].isin("M", "I", "S", "=", "X")
        n = F.when(on_ref | on_read, x["len"]).otherwise(0)
        each = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda k: F.struct(x["op"].alias("op"), F.when(on_ref, acc["ref"] + k).alias("ref_pos"), F.when(on_read, F.substring(sequence, acc["read"] + k, F.lit(1))).alias("base")))
        return F.struct((acc["ref"] + F.when(on_ref, n).otherwise(0)).alias("ref"), (acc["read"] + F.when(on_read, n).otherwise(0)).cast("int").alias("read"), F.concat(acc["out"], each).alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda acc: acc["out"])
