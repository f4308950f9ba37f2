"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Positions:
    """A row for each position of a run. In DataFrame code ``explode(sequence(begin, end - 1))`` does the same inside the JVM."""

    def eval(self, begin: int, end: int, value: int):
        if begin is not None and end is not None:
            for pos in range(begin, end):
                yield pos, value


def register(spark: SparkSession) -> None:
    """``SELECT .. FROM runs, LATERAL positions(begin, end, value)``."""
    spark.udtf.register("positions", udtf(Positions, returnType="pos long, value int"))
