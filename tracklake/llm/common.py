"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only where that setting is absent (tests, notebooks) a folder in the
    warehouse is used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that only tables written since were made from."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(ddl: str) -> pa.Schema:
    """Made on the driver, as workers have no session to parse with."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def slices(batch: pa.RecordBatch, rows: int = 1024):
    """Parts of a batch, so that a task holds few texts as Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which the worker, which lives on between tasks, gives freed memory back."""

    def tidied(batches):
        yield from run(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def sized(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Parts of a batch of about ``most`` bytes of a column."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches; ``make`` runs once in each task and returns what turns a batch into columns."""
    arrow = arrow_schema(schema)

    def run(batches):
        step = make()
        for whole in batches:
            for b in slices(whole):
                out = step(b)
                for cols in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` alone, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
