"""Region notations: text and tuples, 0-based and half-open."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = re.compile(r"^(?P<chrom>[^:]+)(?::(?P<begin>\d+)?(?:-(?P<end>\d+)?)?)?$")


def parse_region(spec, sizes: dict[str, int]) -> tuple[str, int, int] | None:
    """``"chr"``, ``"chr:b-e"``, ``"chr:b-"``, ``"chr:-e"``, or tuples ``(chr,)``, ``(chr, e)``, ``(chr, b, e)``.

    Clamped to the chromosome; None for an unknown chromosome; malformed ones raise.
    """
    if isinstance(spec, str):
        m = TEXT.match(spec)
        if not m or (":" in spec and "-" not in spec):
            raise ValueError(f"not a region: {spec!r}")
        chrom, begin, end = m["chrom"], m["begin"], m["end"]
    else:
        chrom, *rest = spec
        begin, end = (None, None) if not rest else (None, rest[0]) if len(rest) == 1 else rest
    if chrom not in sizes:
        return None
    size = sizes[chrom]
    begin, end = int(begin or 0), size if end is None else int(end)
    return chrom, min(max(begin, 0), size), min(max(end, 0), size)


def parse_regions(specs, sizes: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """Rows with ids in the order given; unknown chromosomes are left out."""
    if isinstance(specs, (str, tuple)):
        specs = [specs]
    return [(i, *r) for i, x in enumerate(specs) if (r := parse_region(x, sizes)) is not None]


def numbered(df: DataFrame, column: str = "chrom") -> DataFrame:
    """Rows of chromosomes named ``chr`` and a number."""
    return df.where(F.col(column).rlike("^chr[0-9]+$"))
