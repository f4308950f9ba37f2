"""Operators' decisions applied to a table of documents, all of whose columns stay.

Rows whose ids are null or repeat are handled one by one: they are numbered in a
saved copy. ``n_chars`` is renewed where a text changes and the column is there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import language_id, line_dedup, minhash, suffix_trees
from tracklake.llm.common import saved, slices, tidy
from tracklake.llm.passages import covered

UID = "_row_uid"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``_row_uid``."""
    n, ids = docs.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("doc_id")).first()
    if n == ids:
        return docs.withColumn(UID, F.col("doc_id").cast("long"))
    return saved(docs.withColumn(UID, F.monotonically_increasing_id()), "numbered")


def rewritten(docs: DataFrame, runs: DataFrame, edit: Callable[[bytes, list], bytes]) -> DataFrame:
    """Texts of rows with ``runs`` replaced by ``edit(text, runs)``; rows left without a word go if they had one."""
    columns = docs.columns
    rows = docs.join(runs.withColumnRenamed("uid", UID), UID, "left")
    text_at = columns.index("text")

    def run(batches):
        for b in (x for whole in batches for x in slices(whole)):
            texts, lists = b.column("text").to_pylist(), b.column("runs").to_pylist()
            new = [t if not r else edit(t.encode(), r).decode() for t, r in zip(texts, lists)]
            keep = pa.array([not r or bool(t.strip()) for t, r in zip(new, lists)])
            arrays = [b.column(c) for c in columns]
            arrays[text_at] = pa.array(new, pa.string())
            if "n_chars" in columns:
                at = columns.index("n_chars")
                sizes = [len(t) if r else n for t, r, n in zip(new, lists, b.column("n_chars").to_pylist())]
                arrays[at] = pa.array(sizes, pa.int64()).cast(b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(keep)

    return rows.mapInArrow(tidy(run), docs.schema).drop(UID)


def least_score(margin: float, n_langs: int) -> float:
    """The score a document needs: ``margin`` of the way from an even split over the languages to certainty."""
    even = 1 / max(1, n_langs)
    return even + margin * (1 - even) - 1e-6


def with_language(docs: DataFrame, margin: float) -> DataFrame:
    """Rows whose text has a recognised language. One pass: the text is judged where it is read.

    Texts that are null or have no letter go; where nothing is labelled, all go; repeated rows are judged one by one.
    """
    langs, net = language_id.fit(docs)
    least = least_score(margin, len(langs))

    def run(batches):
        read = net.reader() if net else None
        for b in (x for whole in batches for x in slices(whole)):
            texts = b.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if read and t and any(c.isalpha() for c in t)]
            keep = np.zeros(len(texts), dtype=bool)
            if some:
                keep[some] = language_id.probabilities(read, [texts[i].encode() for i in some], len(langs)).max(1) >= least
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def without_repeated_lines(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    docs = numbered(docs)
    runs = line_dedup.later_copies(docs.select(F.col(UID).alias("uid"), "text"), min_lines)
    return rewritten(docs, runs, lambda t, r: b"\n".join(line_dedup.without(t, r, min_lines)[0]))


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows whose uid is the least of their component; texts without words are all kept."""
    docs = numbered(docs)
    found = minhash.labelled(docs.select(F.col(UID).alias("uid"), "text"), shingle, percent, bands=24, rows=4)
    least = found.where("uid = label").select(F.col("uid").alias(UID))  # a label is its component's least uid
    return docs.join(least, UID, "left_semi").select(*[c for c in docs.columns if c != UID])


def without_repeated_passages(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """What is left between removed passages stays as it was written; stretches meet at line ends."""
    docs = numbered(docs)
    runs = suffix_trees.repeated_windows(docs.select(F.col(UID).alias("uid"), "text"), window, k)
    return rewritten(docs, runs, lambda t, r: stretches(t, r, window))


def stretches(text: bytes, runs, window: int) -> bytes:
    """The text's stretches of words that ``runs`` don't cover, joined by line ends."""
    from tracklake.llm.repeats import words_of

    starts, ends = words_of(np.frombuffer(text, dtype=np.uint8))
    kept = ~covered(runs, window, len(starts))
    edge = np.diff(np.concatenate(([0], kept.astype(np.int8), [0])))
    return b"\n".join(text[starts[a] : ends[b - 1]] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
