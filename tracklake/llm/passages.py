"""What the two operators on repeated passages share: from documents to the texts that need comparing, and back.

Each document is cut into spans (see ``repeats``). Anchors that occur once are
dropped: their windows cannot repeat. Equal spans of an anchor are one *kind*;
one span of each kind is fetched with its text. An operator then marks, by its
own structure over these texts, which windows of each kind occur twice or more,
and the marks go back to all spans of that kind.

Joins carry hashes and places, not texts; texts are shuffled to fetch spans and
to write the result. Tables that are joined are written first, so that Spark can
split a partition of a very common anchor. Intermediate tables go to the shared
folder and are deleted once all that was made from them is written.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, discard, saved, slices, tidy
from tracklake.llm.repeats import BYTES, spans, word_hashes, words_of

CHUNK = 1 << 20


def with_uid(docs: DataFrame) -> DataFrame:
    """``(uid, doc_id, text)``; ids serve if they are unique, else rows are numbered in a saved copy."""
    n, ids = docs.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("doc_id")).first()
    if n == ids:
        return docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    return saved(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "numbered")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Symbols:
    """Documents of a chunk, laid end to end, as hashed symbols: bytes or words."""

    def __init__(self, texts: list[bytes], words: bool):
        self.words = words
        if words:
            self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
            self.starts, self.ends = words_of(self.data)
            self.x = word_hashes(self.data, self.starts, self.ends)
            bounds = np.cumsum([len(t) + 1 for t in texts])
            self.sizes = np.bincount(np.searchsorted(bounds, self.starts, side="right"), minlength=len(texts))
        else:
            self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            self.x = BYTES[self.data]
            self.sizes = np.array([len(t) for t in texts])
        self.base = np.cumsum(self.sizes) - self.sizes

    def content(self, doc: int, start: int, end: int) -> bytes:
        """Symbols ``start`` to ``end`` of a document; words are joined by one space."""
        a, b = self.base[doc] + start, self.base[doc] + end
        if not self.words:
            return self.data[a:b].tobytes()
        raw = self.data[self.starts[a] : self.ends[b - 1]].tobytes()
        return b" ".join(raw.split())


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """A batch in pieces of about ``CHUNK`` bytes of text, each with its texts as bytes."""
    for part in slices(batch):
        texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                yield texts[at : i + 1], part.slice(at, i + 1 - at)
                at, size = i + 1, 0


def chunks(batch: pa.RecordBatch, *cols: str) -> Iterator[tuple[list[bytes], list[list]]]:
    """A batch's texts as bytes, with other columns as lists, in such pieces."""
    for texts, part in pieces(batch):
        yield texts, [part.column(c).to_pylist() for c in cols]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def rows_of(batch: pa.RecordBatch, *cols: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in cols))


def repeated(docs: DataFrame, window: int, k: int, words: bool, mark: Callable[[DataFrame], DataFrame], most_kinds: int | None = None) -> DataFrame:
    """``(uid, runs)``: flat first and last starts, in no order, of windows that occur more than once.

    ``docs`` has ``uid`` (unique) and ``text``. ``mark`` gets ``(h, s, twice, many, owned, content)``, a
    row for each kind ``s`` of anchor ``h``: the text of one span, how many windows start in it, whether
    there are several such spans and whether the anchor has more than ``most_kinds`` kinds. It returns
    ``(h, s, runs)``, the runs of windows of a kind that occur twice or more.
    """
    spark = docs.sparkSession
    docs = docs.select("uid", "text")
    ddl = "h long, s long, uid long, lo int, hi int"
    schema = arrow_schema(ddl)

    def cut(batches):
        for b in batches:
            for texts, part in pieces(b):
                sym = Symbols(texts, words)
                h, s, doc, lo, hi = spans(sym.x, sym.sizes, window, k)
                if len(h):
                    yield pa.RecordBatch.from_arrays([signed(h), signed(s), part.column("uid").take(pa.array(doc)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=schema)

    found = saved(docs.mapInArrow(tidy(cut), ddl), "found")
    anchors = saved(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    shared = saved(found.join(anchors, "h"), "spans")
    discard(found, anchors)
    release(spark)

    kinds = saved(shared.groupBy("h", "s").agg(F.min(F.struct("uid", "lo", "hi")).alias("one"), (F.count("*") > 1).alias("twice")), "kinds")
    flagged, spent = kinds.withColumn("many", F.lit(False)), [kinds]
    if most_kinds:
        many = saved(kinds.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most_kinds).select("h", F.lit(True).alias("many")), "many")
        flagged, spent = kinds.join(many, "h", "left"), [kinds, many]
    contents = saved(fetched(docs, flagged, window, words), "contents")
    discard(*spent)
    release(spark)

    marks = mark(contents)
    discard(contents)
    release(spark)
    return shared.join(marks, ["h", "s"]).select("uid", F.transform("runs", lambda x: x + F.col("lo")).alias("runs")).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def fetched(docs: DataFrame, kinds: DataFrame, window: int, words: bool) -> DataFrame:
    """One span of each kind with its symbols."""
    span = F.struct("h", "s", "one.lo", "one.hi", "twice", F.coalesce("many", F.lit(False)).alias("many"))
    wanted = kinds.groupBy("one.uid").agg(F.collect_list(span).alias("spans"))
    ddl = "h long, s long, twice boolean, many boolean, owned int, content binary"
    schema = arrow_schema(ddl)

    def take(batches):
        for b in batches:
            for texts, part in pieces(b):
                sym = Symbols(texts, words)
                lists, flat = part.column("spans"), part.column("spans").flatten()
                doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                h, s, lo, hi, twice, many = flat.flatten()
                lo, hi = lo.to_numpy(), hi.to_numpy()
                got = [sym.content(d, a, e) for d, a, e in zip(doc.tolist(), lo.tolist(), (hi + window).tolist())]
                yield pa.RecordBatch.from_arrays([h, s, twice, many, pa.array((hi - lo + 1).astype(np.int32)), pa.array(got, pa.binary())], schema=schema)

    return docs.join(wanted, "uid").select("text", "spans").mapInArrow(tidy(take), ddl)


def runs_of(mark: np.ndarray, first: int = 0) -> list[int]:
    """First and last places of the runs of true marks, flat; the first mark is at ``first``."""
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return (first + np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).ravel()).tolist()


def covered(runs: list[int] | None, window: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols the windows of ``runs`` cover."""
    mark = np.zeros(n + 1, dtype=np.int64)
    if runs is not None and len(runs):
        r = np.array(runs).reshape(-1, 2)
        np.add.at(mark, r[:, 0], 1)
        np.add.at(mark, np.minimum(r[:, 1] + window, n), -1)
    return np.cumsum(mark[:-1]) > 0


def finished(docs: DataFrame, runs: DataFrame, finish: Callable, out_schema: str) -> DataFrame:
    """Apply ``finish(text bytes, runs)`` to every document; its tuple follows ``doc_id``."""
    schema = arrow_schema(out_schema)

    def run(batches):
        for b in (x for whole in batches for x in slices(whole)):
            rows = [(i, *finish((t or "").encode(), r)) for i, t, r in rows_of(b, "doc_id", "text", "runs")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.join(runs, "uid", "left").select("doc_id", "text", "runs").mapInArrow(tidy(run), out_schema)
