"""Removal of repeated word passages, with prefix-partitioned suffix trees.

Every word covered by ``window`` consecutive words whose sequence also starts
anywhere else, in any document, is removed.

Suffixes are indexed at anchors only (see ``repeats``): every window holds one,
at the same place in equal windows, so a suffix in fourteen is enough. They are split
into groups by a prefix: its ``k`` words at first. Prefixes are counted, and one
with more than ``most_kinds`` different suffixes is lengthened: the window's anchor
may stand anywhere in it, so its places are parted into blocks of a quarter as many,
a suffix of each block starts as many words before the anchor as all windows of
the block have there, and its prefix is what they all hold (8, 29, 35 words). At 35 words the prefix is the
window and its group one node, so leaves are only counted. Groups fit in memory
however often a prefix occurs, and no group is left out.

Each group's subtree is held as its leaves in order and the depths of the inner
nodes where neighbours part (the tree's array form). A repeat reaches to both sides of where
its suffix starts, so a second subtree has the same leaves by the reversed words before
them. An inner node of the first, ``d`` words deep, and one of the second, ``window -
d`` deep, that have two leaves in common are a repeat; runs of such windows are the maximal ones.

Defined cases: a null text has no words; texts with fewer words than ``window``
lose nothing; of equal texts with at least so many all words go; copies in one text
count, overlapping ones too; a text of any length is handled whole; ids may be null
or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, discard, saved, texts, tidy
from tracklake.llm.passages import Symbols, covered, finished, repeated, rows_of, runs_of, signed, with_uid
from tracklake.llm.repeats import Hashes, U, mix

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Different suffixes of one group; the text of one is a few hundred bytes.
MOST_KINDS = 512
#: Bytes of text whose groups a task handles together.
SHARD = 1 << 20
#: ``c``: word of ``content`` where the suffix starts; ``n`` windows start in it, the first at ``first`` of its span.
LEAVES = "g long, h long, s long, twice boolean, first int, c int, n int, content binary"
WINDOWS = "g long, h long, s long, place int, copies int"
RUNS = "h long, s long, runs array<int>"


class Subtree:
    """Leaves in the order of their strings, and how deep the inner node is where each parts from the one before."""

    def __init__(self, group: np.ndarray, strings: np.ndarray):
        depth = strings.shape[1]
        self.order = np.lexsort((*(strings[:, i] for i in range(depth - 1, -1, -1)), group))
        a = strings[self.order]
        same = np.logical_and.accumulate(a[1:] == a[:-1], axis=1).sum(1)
        g = group[self.order]
        self.parts = np.concatenate(([-1], np.where(g[1:] == g[:-1], same, -1)))

    def below(self, depth: int) -> np.ndarray:
        """For each leaf the node that it hangs below at ``depth``, numbered from left to right."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.parts < depth)
        return out


def repeats_of(group, c, n, twice, contents: list[bytes], window: int) -> list[np.ndarray]:
    """For each leaf the marks of its ``n`` windows: whether they hang below a node of two or more leaves.

    ``twice`` leaves stand for several equal ones.
    """
    sym = Symbols(contents, True)
    reach = int(c.max()) if len(c) else 0
    at, end = sym.base + c, sym.base + sym.sizes
    rights = Subtree(group, sym.x[np.minimum(at[:, None] + np.arange(window), end[:, None] - 1)])
    lefts = Subtree(group, sym.x[np.maximum(at[:, None] - 1 - np.arange(reach), sym.base[:, None])])
    begin = np.cumsum(n) - n
    mark = np.zeros(int(n.sum()), dtype=bool)
    for back in range(reach + 1):  # windows that start so many words before their suffix
        own = np.flatnonzero((c >= back) & (c - back < n))
        _, node = np.unique(rights.below(window - back)[own] * (len(c) + 1) + lefts.below(back)[own], return_inverse=True)
        deep = own[np.bincount(node, 1 + twice[own])[node] > 1]
        mark[begin[deep] + c[deep] - back] = True
    return np.split(mark, begin[1:])


def anchors_of(h: np.ndarray, sym: Symbols, k: int) -> np.ndarray:
    """The word of each content where its anchor starts: the first ``k`` words with that hash."""
    grams = mix(Hashes(sym.x).grams(k))
    hit = np.flatnonzero(grams == np.repeat(h, sym.sizes)[: len(grams)])
    doc, first = np.unique(np.searchsorted(sym.base + sym.sizes, hit, side="right"), return_index=True)
    if len(doc) != len(h):
        raise ValueError("a span lost its anchor")
    return hit[first] - sym.base


def anchored(contents: DataFrame, k: int) -> DataFrame:
    """Leaves by the prefix of ``k`` words at the anchor."""
    schema = arrow_schema(LEAVES)

    def run(batches):
        for b in batches:
            if b.num_rows:
                h, owned = b.column("h"), b.column("owned")
                c = anchors_of(h.to_numpy().view(np.uint64), Symbols(b.column("content").to_pylist(), True), k)
                zero = np.zeros(b.num_rows, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([h, h, b.column("s"), b.column("twice"), pa.array(zero), pa.array(c.astype(np.int32)), owned, b.column("content")], schema=schema)

    return contents.mapInArrow(tidy(run), LEAVES)


def lengthened(leaves: DataFrame, window: int, block: int) -> DataFrame:
    """Leaves whose suffixes start ``block`` places apart before the anchor, by prefixes of ``window - block + 1`` words."""
    schema = arrow_schema(LEAVES)

    def run(batches):
        for b in batches:
            out = []
            for h, s, twice, c, n, content in rows_of(b, "h", "s", "twice", "c", "n", "content"):
                words = content.split()
                x = Hashes(Symbols([content], True).x)
                for back in range(0, c + 1, block):  # windows that start ``back`` to ``back + block - 1`` words before the anchor
                    lo, hi = max(c - back - block + 1, 0), min(c - back, n - 1)
                    if lo <= hi:
                        start = c - back
                        g = mix(x.of(np.array([start]), np.array([start + window - block + 1])) + mix(np.array([h], dtype=np.int64).view(np.uint64) + U(back)))
                        out.append((int(g.view(np.int64)[0]), h, s, twice, lo, start - lo, hi - lo + 1, b" ".join(words[lo : hi + window])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types)], schema=schema)

    return leaves.mapInArrow(tidy(run), LEAVES)


def grown(leaves: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """The subtree of every group; groups are handled together up to ``shard_bytes``."""
    schema = arrow_schema(RUNS)

    def run(batches):
        rows, size = [], 0

        def shard():
            g, h, s, twice, first, c, n, content = zip(*rows)
            _, group = np.unique(np.array(g, dtype=np.int64), return_inverse=True)
            marks = repeats_of(group, np.array(c), np.array(n), np.array(twice, dtype=np.int64), list(content), window)
            out = [(a, b, runs_of(m, f)) for a, b, f, m in zip(h, s, first, marks) if m.any()]
            return [pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types)], schema=schema)] if out else []

        for b in batches:
            for row in rows_of(b, *(f.split()[0] for f in LEAVES.split(", "))):
                if size >= shard_bytes and row[0] != rows[-1][0]:
                    yield from shard()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield from shard()

    return leaves.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), RUNS)


def counted(leaves: DataFrame, window: int) -> DataFrame:
    """Runs of windows whose whole sequence is a prefix of two or more suffixes: counted before they are shuffled."""
    schema = arrow_schema(WINDOWS)

    def run(batches):
        for b in batches:
            for h, s, twice, first, n, content in rows_of(b, "h", "s", "twice", "first", "n", "content"):
                x = Hashes(Symbols([content], True).x).grams(window)[:n]
                g = mix(x + np.array([h], dtype=np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([signed(g), pa.array(np.full(n, h)), pa.array(np.full(n, s)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(np.full(n, 1 + twice, dtype=np.int32))], schema=schema)

    found = saved(leaves.mapInArrow(tidy(run), WINDOWS), "windows")
    more = saved(found.groupBy("g").agg(F.sum("copies").alias("n")).where("n > 1").select("g"), "nodes")
    out = saved(found.join(more, "g").groupBy("h", "s").agg(F.flatten(F.collect_list(F.array("place", "place"))).alias("runs")), "counted")
    discard(found, more)
    return out


def marked(window: int, k: int, most_kinds: int, shard_bytes: int):
    """See ``passages.repeated``: prefixes are lengthened until each group fits."""

    def mark(contents: DataFrame) -> DataFrame:
        alone = saved(grown(anchored(contents.where("NOT many"), k), window, shard_bytes), "runs")
        leaves = contents.where("many")
        if leaves.isEmpty():
            return alone
        leaves = saved(lengthened(anchored(leaves, k), window, -(-(window - k + 1) // 4)), "leaves")
        many = saved(leaves.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most_kinds).select("g", F.lit(True).alias("many")), "many")
        split = saved(leaves.join(many, "g", "left"), "split")
        discard(leaves, many)
        runs = alone.unionByName(grown(split.where("many IS NULL"), window, shard_bytes)).unionByName(counted(split.where("many"), window))
        out = saved(runs.groupBy("h", "s").agg(F.flatten(F.collect_list("runs")).alias("runs")), "marks")
        discard(alone, split)
        return out

    return mark


def repeated_windows(docs: DataFrame, window: int = 35, k: int = 8, most_kinds: int | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """``(uid, runs)`` of ``docs(uid, text)``: flat first and last starts of repeated windows, counted in words."""
    most_kinds = most_kinds or MOST_KINDS
    return repeated(docs, window, k, True, marked(window, k, most_kinds, shard_bytes), most_kinds)


def finish(window: int):
    def one(text: bytes, runs):
        words = text.split()
        kept = words if not runs else [w for w, g in zip(words, covered(runs, window, len(words)).tolist()) if not g]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return one


def passage_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8) -> DataFrame:
    """Counts and the digest of the words that are left of every document."""
    docs = with_uid(texts(docs, id_col, text_col))
    return finished(docs, repeated_windows(docs, window, k), finish(window), SCHEMA)
