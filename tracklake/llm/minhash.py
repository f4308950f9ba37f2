"""Near-duplicates by circulant MinHash, with exact verification.

A text's set is its distinct ``shingle``-word shingles, as 64-bit hashes. One
permutation scatters a set; a second, circularly shifted by one more step
for each coordinate, gives all coordinates of its signature. ``rows`` coordinates make a
band; documents that share a band are candidates. With 24 bands of 4, a pair of
likeness 0.8 is missed three times in a million.

Documents of equal sets become one *class* first. Candidates are then compared
with full sets, without ever listing a bucket's pairs: each bucket's members are
compared with its pivot, connected components are taken, and buckets that
still hold several components choose another pivot. The members of buckets that are
then still apart are compared across components where they can be alike at all (every pair that gets this far is within reach of the likeness asked for):
with shingles in an order from rare to common, alike sets share one so early
in both that what follows suffices for the needed overlap (prefix and positional
filters, which lose no link). A link is left out only where its ends are known
to be connected.

Defined cases: null and empty texts have the empty set and are linked with nothing;
repeated rows are classes of several; where ids are null or repeat, rows are
numbered first and a component's id is its least id that is not null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, discard, saved, texts, tidy
from tracklake.llm.components import connected_components
from tracklake.llm.passages import Symbols, chunks, release, signed, with_uid
from tracklake.llm.repeats import Hashes, U, mix

#: Members compared with one copy of their pivot.
TOGETHER = 64
#: Rounds of pivots before the rest is compared across components.
PIVOT_ROUNDS = 3


def shingle_sets(data: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and how many each has."""
    sym = Symbols([t.lower() for t in data], True)  # bytes.lower() changes A to Z alone
    n = len(data)
    owner = np.repeat(np.arange(n), sym.sizes)
    ends = np.repeat(np.cumsum(sym.sizes), sym.sizes)
    hashes = Hashes(sym.x)
    at = np.arange(len(sym.x))
    full = np.flatnonzero(at + shingle <= ends)
    short = np.flatnonzero((sym.sizes < shingle) & (sym.sizes > 0))
    own = np.concatenate((owner[full], short))
    h = np.concatenate((mix(hashes.of(full, full + shingle)), mix(hashes.of(sym.base[short], sym.base[short] + sym.sizes[short]) + sym.sizes[short].astype(np.uint64))))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(own[new], minlength=n)


def permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit values, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(h: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts with a set, coordinates) of circulant MinHash."""
    scattered = (mix(h ^ U(0x5DEECE66D)) >> U(32)).astype(np.uint32)
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), coordinates), dtype=np.uint32)
    for c in range(coordinates):
        out[:, c] = np.minimum.reduceat(permuted(scattered + np.uint32(c)), starts)
    return out


def sketched(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(uid, n, d1, d2, bands)``: set sizes, set digests and band keys."""
    ddl = "uid long, n int, d1 long, d2 long, bands array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for data, (uids,) in chunks(b, "uid"):
                h, sizes = shingle_sets(data, shingle)
                some = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[some]
                d1, d2 = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
                keys = np.zeros((len(data), bands), np.uint64)
                if len(some):
                    d1[some], d2[some] = np.add.reduceat(mix(h), starts), np.add.reduceat(mix(h ^ U(0xABCDEF)), starts)
                    sig = signatures(h, sizes, bands * rows).astype(np.uint64).reshape(len(some), bands, rows)
                    k = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(some), bands)).copy()
                    for r in range(rows):
                        k = mix(k * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                    keys[some] = k
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * bands), signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sizes.astype(np.int32)), signed(d1), signed(d2), lists], schema=schema)

    return docs.mapInArrow(tidy(run), ddl)


def confirmed(pairs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(p, x)`` whose full sets are alike enough.

    A pivot's members are dealt to groups of about ``TOGETHER``, each with a copy of the pivot's text.
    """
    many = saved(pairs.groupBy("p").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups")), "pivots")
    pairs = pairs.join(many, "p").select("p", F.pmod(F.xxhash64("x"), F.col("groups")).cast("int").alias("g"), "x")
    pivots = many.select(F.col("p").alias("uid"), "p", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("kind"))
    rows = pivots.unionByName(pairs.select(F.col("x").alias("uid"), "p", "g", F.lit(1).alias("kind"))).join(sets, "uid")
    schema = arrow_schema("p long, x long")

    def run(batches):
        pivot, own = None, None
        for b in batches:
            found = []
            for data, (ids, ps, gs, kinds) in chunks(b, "uid", "p", "g", "kind"):
                h, sizes = shingle_sets(data, shingle)
                for uid, p, g, kind, s in zip(ids, ps, gs, kinds, np.split(h, np.cumsum(sizes)[:-1])):
                    if not kind:
                        pivot, own = (p, g), s
                        continue
                    if pivot != (p, g):
                        raise ValueError("a group lost its pivot")
                    common = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if 100 * common >= percent * (len(own) + len(s) - common):
                        found.append((p, uid))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows.repartition("p", "g").sortWithinPartitions("p", "g", "kind").select("uid", "p", "g", "kind", "text").mapInArrow(tidy(run), "p long, x long")


def early_pairs(left: DataFrame, text: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``(p, x)`` of different labels among the documents of ``left`` that can be alike.

    Two sets with ``100 * common >= percent * union`` have ``(100 + percent) * common
    >= percent * (n + m)``. In any order of shingles, the first common one, at places
    i and j, leaves at most ``min(n - i, m - j)`` others. The order here puts shingles of one
    document first, so documents with enough text of their own have no pair at all,
    however common the rest of it is.
    """
    docs = left.select("uid", "label", "n").distinct().join(text, "uid")
    ddl = "uid long, label long, n int, token long"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for data, (ids, labels, ns) in chunks(b, "uid", "label", "n"):
                h, sizes = shingle_sets(data, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(c, dtype=t), sizes)) for c, t in ((ids, np.int64), (labels, np.int64), (ns, np.int32))] + [signed(h)], schema=schema)

    tokens = docs.select("uid", "label", "n", "text").mapInArrow(tidy(run), ddl)
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("uid")
    placed = tokens.join(common, "token").withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")))
    # a partner has at most n * 100 / percent shingles; even with the smallest, the overlap must still be within reach
    early = saved(placed.where(f"100 * (n - place + 1) >= {percent} * n").select("uid", "label", "n", "place", "token"), "early")
    other = early.select("token", F.col("uid").alias("p"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("place").alias("at"))
    near = early.join(other, "token").where("label <> other AND p < uid").where(f"100 * least(n, m) >= {percent} * greatest(n, m) AND {100 + percent} * (least(n - place, m - at) + 1) >= {percent} * (n + m)")
    return near.select("p", F.col("uid").alias("x")).distinct()


def labelled(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``(uid, n, label)`` of every document; a null label where it is alone in its class and component."""
    spark = docs.sparkSession
    sets = saved(sketched(docs, shingle, bands, rows), "sketches")
    classes = saved(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("uid").alias("rep")), "classes")
    one = saved(sets.join(classes, ["n", "d1", "d2"], "left").select("uid", "n", F.coalesce("rep", "uid").alias("rep"), F.when(F.col("uid") == F.col("rep"), F.col("bands")).alias("bands")), "ones")
    discard(sets, classes)
    member = one.where("bands IS NOT NULL").select("uid", "n", F.explode("bands").alias("key"))
    full = saved(member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "full")
    bucket = saved(member.join(full, "key"), "buckets")
    discard(full)
    release(spark)
    text = saved(docs.join(bucket.select("uid").distinct(), "uid").select("uid", "text"), "candidates")
    release(spark)

    links, labels = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        if labels is None:
            left = bucket.withColumn("label", F.col("uid"))
        else:
            left = saved(bucket.join(labels.withColumnRenamed("v", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid")), "labelled")
            apart = saved(left.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "apart")
            left = saved(left.join(apart, "key"), "left")
            if left.isEmpty():
                break
        like = f"100 * least(n, m) >= {percent} * greatest(n, m) AND label <> other"  # sets of too different sizes can't be alike
        if turn < PIVOT_ROUNDS:
            pivot = saved(left.groupBy("key").agg(F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("o"), F.col("uid").alias("p"), F.col("n").alias("m"), F.col("label").alias("other"))).alias("s")).select("key", "s.p", "s.m", "s.other"), "chosen")
            pairs = left.join(pivot, "key").where(like).select("p", F.col("uid").alias("x")).distinct()
        else:
            pairs = early_pairs(left, text, shingle, percent)
        new = saved(confirmed(saved(pairs, "pairs"), text, shingle, percent).select(F.col("p").alias("a"), F.col("x").alias("b")), "links")
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty() or labels is None:
            labels = connected_components(links)
        release(spark)
    out = one if labels is None else one.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    return out.select("uid", "n", (F.coalesce("label", "rep") if labels is not None else F.col("rep")).alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document."""
    docs = with_uid(texts(docs, id_col, text_col))
    found = labelled(docs.select("uid", "text"), shingle, percent, bands, rows)
    if "saved_at" not in vars(docs):  # ids are unique, so a label is its component's least id
        out = found.select(F.col("uid").alias("doc_id"), "n", F.col("label").alias("component_id"))
    else:
        found = saved(found.join(docs.select("uid", "doc_id"), "uid"), "found")
        least = saved(found.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
        out = found.join(least, "label")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
