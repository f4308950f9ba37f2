"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends and at sentence and clause marks;
stretches of over ``LONGEST`` words without any are cut every ``LONGEST`` words. Each
paragraph's digest (with its number among equal ones) goes into one cell of each
of three tables; a cell keeps a count and the XOR of digests and of their checks.
Sketches of two versions subtract cell by cell; peeling cells that hold a single
digest recovers the digests on either side. If peeling stops early, the
sketches are built anew with room for all digests, and doubled after each failure.
The published sketch has 12 cells, however long the text: by itself it carries small differences only.

The likeness of two texts is that of their digest multisets, common over all,
from the number of recovered digests.

Defined cases: a null text is an empty one; two texts without paragraphs are alike
(1.0); equal texts have equal fingerprints; documents of equal id follow each
other in the order of their texts, and a null id comes first; a single document
is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import map_rows, texts, tidy

LONGEST = 24
CUT = re.compile(rb"[.!?,;:\n]+")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
MIX = np.uint64(0xBF58476D1CE4E5B9)
NO_DOC = -(1 << 63)


def paragraphs(text: str) -> list[bytes]:
    out = []
    for p in CUT.split(text.encode()):
        p = p.strip()
        if p:
            if len(p) > 6 * LONGEST and len(w := p.split()) > LONGEST:
                out += [b" ".join(w[i : i + LONGEST]) for i in range(0, len(w), LONGEST)]
            else:
                out.append(p)
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digests, one for each paragraph; equal paragraphs are numbered, so all differ."""
    d = np.array([xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)], dtype=np.uint64)
    d.sort()
    if len(d) > 1 and (same := np.concatenate(([False], d[1:] == d[:-1]))).any():
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))
        d = d + (np.arange(len(d)) - start).astype(np.uint64) * SALTS[0]
    return d


def mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ salt) * MIX
    x = (x ^ (x >> np.uint64(29))) * SALTS[1]
    return x ^ (x >> np.uint64(32))


class Sketch:
    """Three tables of ``2**power`` cells each."""

    def __init__(self, keys: np.ndarray, power: int):
        self.power, size = power, 1 << power
        self.count = np.zeros(3 * size, dtype=np.int64)
        self.keys = np.zeros(3 * size, dtype=np.uint64)
        self.checks = np.zeros(3 * size, dtype=np.uint64)
        self.put(keys, np.ones(len(keys), dtype=np.int64))

    @staticmethod
    def check(mix: np.ndarray) -> np.ndarray:
        return (mix * MIX) >> np.uint64(32)

    def put(self, keys: np.ndarray, sign: np.ndarray, mix: np.ndarray | None = None) -> None:
        """Add ``keys`` with their signs; XOR undoes itself, so taking away is the same."""
        if not len(keys):
            return
        mix = mixed(keys, SALTS[0]) if mix is None else mix
        size, mask = 1 << self.power, np.uint64((1 << self.power) - 1)
        if self.power <= 21:
            cells = np.concatenate((mix & mask, ((mix >> np.uint64(21)) & mask) + np.uint64(size), ((mix >> np.uint64(42)) & mask) + np.uint64(2 * size))).astype(np.int64)
        else:
            cells = np.concatenate([(mixed(mix, s) & mask).astype(np.int64) + k * size for k, s in enumerate(SALTS)])
        np.add.at(self.count, cells, np.concatenate((sign, sign, sign)))
        np.bitwise_xor.at(self.keys, cells, np.concatenate((keys, keys, keys)))
        check = self.check(mix)
        np.bitwise_xor.at(self.checks, cells, np.concatenate((check, check, check)))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.keys[:0], self.power)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests of the left and of the right alone, or None if some can't be told apart."""
        found: list[np.ndarray] = []
        signs: list[np.ndarray] = []
        size, idle, table = 1 << self.power, 0, 0
        while idle < 3:  # a digest is in one cell of each table, so a table's single ones are distinct
            part = slice(table * size, (table + 1) * size)
            count = self.count[part]
            pure = np.flatnonzero((count == 1) | (count == -1))
            if len(pure):
                keys = self.keys[part][pure]
                mix = mixed(keys, SALTS[0])
                ok = self.check(mix) == self.checks[part][pure]
                keys, mix, sign = keys[ok], mix[ok], count[pure[ok]]
            if len(pure) and len(keys):
                found.append(keys)
                signs.append(sign)
                self.put(keys, -sign, mix)
                idle = 0
            else:
                idle += 1
            table = (table + 1) % 3
        if self.count.any() or self.keys.any():
            return None
        k, s = (np.concatenate(found), np.concatenate(signs)) if found else (self.keys[:0], self.count[:0])
        return k[s > 0], k[s < 0]

    def text(self, n: int) -> str:
        return base64.b85encode(n.to_bytes(4, "little") + np.clip(self.count, -(1 << 15), (1 << 15) - 1).astype("<i2").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u4").tobytes()).decode()


def difference(a: np.ndarray, b: np.ndarray, small: Sketch | None = None, power: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Digests in ``a`` alone and in ``b`` alone, by subtracting and peeling, larger after each failure.

    ``small`` is the difference of small sketches, if there is one already. Sketches are linear, so a
    retry sums both sides into one. The first retry has room for all digests of
    both sides, which nearly always does; each later one doubles.
    """
    got = small.peel() if small is not None else None
    while 2 << power < len(a) + len(b):
        power += 1
    while got is None:
        s = Sketch(a, power)
        s.put(b, np.full(len(b), -1, dtype=np.int64))
        got, power = s.peel(), power + 1
        if power > 40:
            raise ValueError("the sketches can't be told apart")
    return got


def likeness(a: np.ndarray, b: np.ndarray, small: Sketch | None = None) -> float:
    if not len(a) and not len(b):
        return 1.0
    d = sum(map(len, difference(a, b, small)))
    return (len(a) + len(b) - d) / (len(a) + len(b) + d)


def fingerprint(keys: np.ndarray, power: int = 2) -> str:
    """The small sketch as text: how many digests, then counts, digests and checks of its cells."""
    return Sketch(keys, power).text(len(keys))


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, bucket_rows: int = 1024) -> tuple[DataFrame, None]:
    """Rows sorted within buckets of neighbouring ids; ``tail`` rows repeat the next bucket's first ones.

    The buckets' bounds are ids of the table, about one for each ``bucket_rows``
    documents and 100,000 at most; beyond that buckets hold more rows, which are
    sorted on disk and streamed. The texts are shuffled once.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"))
    n, low = ids.agg(F.count("*"), F.min("doc_id")).first()
    if not n:
        bounds = [NO_DOC]
    else:
        m = min(100_000, max(1, math.ceil(n / bucket_rows)))
        got = ids.agg(F.percentile_approx("doc_id", [k / m for k in range(1, m)] or [0.5], max(10_000, 10 * m))).first()[0] if m > 1 else []
        bounds = sorted({low, *got})
    firsts = {x: i for i, x in enumerate(bounds)}

    def make():
        def step(b):
            keys = [NO_DOC if x is None else x for x in b.column("doc_id").to_pylist()]
            own = [max(0, bisect_right(bounds, k) - 1) for k in keys]
            more = [i for i, k in enumerate(keys) if k in firsts]
            take = [*range(len(keys)), *more]
            return {"bucket": own + [(firsts[keys[i]] - 1) % len(bounds) for i in more], "tail": [False] * len(keys) + [True] * len(more), "sort_id": [keys[i] for i in take], "doc_id": b.column("doc_id").take(take_array(take)), "text": b.column("text").take(take_array(take))}

        return step

    dealt = map_rows(docs, make, "bucket int, tail boolean, sort_id long, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "sort_id", "text")


def take_array(rows: list[int]):
    import pyarrow as pa

    return pa.array(rows, type=pa.int32())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and its likeness to that and to the next document."""
    rows = with_next(texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        import pyarrow as pa

        held = None  # a document that still waits for its next one
        for b in batches:
            out = []
            for bucket, tail, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))):
                if tail and (held is None or held[0] != bucket):
                    continue
                keys = digests(text)
                small = Sketch(keys, 2)
                if held is not None and held[0] == bucket:
                    _, held_id, own, own_keys, own_small = held
                    new = edited(own, text)
                    new_keys = digests(new)
                    new_small = Sketch(new_keys, 2)
                    out.append((held_id, len(own), hashlib.sha256(new.encode()).hexdigest(), own_small.text(len(own_keys)), new_small.text(len(new_keys)), likeness(own_keys, new_keys, own_small.minus(new_small)), likeness(own_keys, keys, own_small.minus(small))))
                held = None if tail else (bucket, doc_id, text, keys, small)
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c) if c[0] is not None else pa.array(c, type=pa.int64()) for c in cols], names=names)

    return rows.mapInArrow(tidy(run), SCHEMA)
