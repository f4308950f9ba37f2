"""Line dedup, with a suffix array over line ids by distributed prefix doubling.

Each document is the sequence of its lines that hold a word, compared without the white
space around them. A place's rank at depth ``2**k`` orders it by its next
``2**k`` lines; ranks at the next depth come from sorting pairs of ranks
``2**k`` apart, by range partitions. A place whose lines occur once so far can't begin a
repeated run and leaves the array, so it shrinks as it is refined. At depth
``min_lines`` the places of equal rank are the intervals of common prefixes of
at least ``min_lines`` lines: overlapping runs of them are the maximal repeated
runs. Of each, the first copy (by id, then line) stays, and the lines of later
ones are deleted.

Defined cases: a null text has no lines; lines without a word are never compared
and stay; a document with fewer than ``min_lines`` lines loses nothing; copies
within a document count, overlapping ones too; where ids are null or repeat,
rows are numbered and their order decides; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, saved, texts, tidy
from tracklake.llm.passages import finished, release, with_uid

SCHEMA = "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string"


def solid_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and which of them hold a word."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def line_ids(docs: DataFrame) -> DataFrame:
    """``(uid, i, a, b)``: 128-bit ids of the lines with words, numbered within their document."""
    schema = arrow_schema("uid long, i int, a long, b long")

    def run(batches):
        for batch in batches:
            uids, nums, ids = [], [], []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                lines, solid = solid_lines((text or "").encode())
                uids += [uid] * len(solid)
                nums += range(len(solid))
                ids += [xxhash.xxh3_128_digest(lines[i].strip()) for i in solid]
            both = np.frombuffer(b"".join(ids), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(nums, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    return docs.mapInArrow(tidy(run), "uid long, i int, a long, b long")


def ranked(places: DataFrame) -> DataFrame:
    """Places whose ``(a, b)`` occurs again, with a rank in the pairs' order.

    Pairs are counted before they are shuffled, sorted by range partitions and
    numbered in order; numbers leave gaps but keep the order.
    """
    pairs = places.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    names = saved(pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank")), "ranks")
    return saved(places.join(names, ["a", "b"]).select("uid", "i", "rank"), "places")


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """``(uid, i, rank)`` of places whose next ``depth`` lines occur at another place too."""
    places, have = ranked(line_ids(docs)), 1
    while have < depth:
        step = min(have, depth - have)
        beyond = places.select("uid", (F.col("i") - step).alias("i"), F.col("rank").alias("b"))
        places = ranked(places.join(beyond, ["uid", "i"]).select("uid", "i", F.col("rank").alias("a"), "b"))
        have += step
        release(docs.sparkSession)
    return places


def later_copies(docs: DataFrame, min_lines: int) -> DataFrame:
    """``(uid, runs)``: flat first and last starts of runs that occurred before."""
    ranks = suffix_ranks(docs, min_lines)
    first = saved(ranks.groupBy("rank").agg(F.min(F.struct("uid", "i")).alias("first")), "firsts")  # so the join below can be split where a run is very common
    later = ranks.join(first, "rank").where("first.uid <> uid OR first.i <> i")
    return later.groupBy("uid").agg(F.flatten(F.collect_list(F.array("i", "i"))).alias("runs"))


def without(text: bytes, runs, min_lines: int) -> tuple[list[bytes], int, int, int]:
    """Lines left, and how many lines with words there were, went, and in how many runs."""
    from tracklake.llm.passages import covered

    lines, solid = solid_lines(text)
    if not runs:
        return lines, len(solid), 0, 0
    gone = covered(runs, min_lines, len(solid))
    drop = {i for i, g in zip(solid, gone.tolist()) if g}
    n_runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
    return [x for i, x in enumerate(lines) if i not in drop], len(solid), len(drop), n_runs


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """Counts and the digest of what is left of every document."""
    docs = with_uid(texts(docs, id_col, text_col))

    def one(text, runs):
        left, n, gone, n_runs = without(text, runs, min_lines)
        return n, gone, n_runs, hashlib.sha256(b"\n".join(left)).hexdigest()

    return finished(docs, later_copies(docs, min_lines), one, SCHEMA)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
m AS (SELECT doc_id, k, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM l),
w AS (SELECT doc_id, k, t, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, lead(t) OVER (PARTITION BY doc_id ORDER BY k) AS t2, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS k2 FROM m WHERE t <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, i) AS copy FROM w WHERE t2 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([k, k2]) AS k FROM f WHERE copy > 1),
a AS (SELECT m.doc_id, m.k, m.line, m.t <> '' AS solid, g.k IS NOT NULL AS gone FROM m LEFT JOIN g ON m.doc_id = g.doc_id AND m.k = g.k),
r AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, gone, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM a WHERE solid) WHERE gone AND NOT before GROUP BY doc_id)
SELECT a.doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(max(r.n_runs), 0) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM a LEFT JOIN r USING (doc_id) GROUP BY a.doc_id
"""
