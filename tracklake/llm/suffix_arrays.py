"""Removal of repeated byte strings, with suffix arrays.

Every byte covered by a string of ``window`` bytes that also starts anywhere
else, in any document, is removed. ``passages`` reduces the corpus to the kinds of
spans whose anchors repeat. These are dealt, in the order of their anchors, to
shards of about ``shard_bytes``, however many belong to one anchor. Each shard's suffixes are sorted
by Larsson-Sadakane refinement and their common prefixes found as Kasai does, in
text order (all contents side by side).

A string that two shards share belongs to an anchor that one shard ends with and
the other begins with. For these anchors each shard lists its distinct strings, sorted by digest.
The lists of an anchor that has several are cut, by binary search, at as
many places as it has lists, and the slices between the same two places are merged
by binary search of each in those before it. So a task gets about a shard's worth of strings,
however common an anchor is.

Defined cases: a null text is an empty one; texts shorter than ``window`` lose
nothing; of equal texts at least as long all bytes go; matches never cross
documents, and overlapping ones and those within a text count; a text of any length is
handled whole; ids may be null or repeat; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, discard, saved, texts, tidy
from tracklake.llm.passages import Symbols, covered, finished, repeated, rows_of, runs_of, with_uid
from tracklake.llm.repeats import Hashes, mix

KEY = 8
#: Bytes of spans that are sorted at once, in about 100 MB of arrays; three ranks of so many places fit into 63 bits.
SHARD = 1 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RUNS = "h long, s long, runs array<int>"


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, each up to its content's end, and the eight-byte keys at each place.

    ``ends`` gives each place its content's end. The first ranks are those of
    eight bytes; each round triples the depth, sorting by the ranks of a place and of the two
    places one and two depths further, and sorts only groups that aren't
    single yet. Suffixes that are equal to their ends stand in order of place.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(KEY, np.uint8))).astype(np.uint64)
    keys = np.zeros(n, dtype=np.uint64)
    room = ends - np.arange(n)
    for j in range(KEY):
        keys |= np.where(j < room, padded[j : j + n], np.uint64(0)) << np.uint64(8 * (KEY - 1 - j))
    sa = np.argsort(keys)
    new = np.concatenate(([True], keys[sa[1:]] != keys[sa[:-1]]))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    bits = int(n + 1).bit_length()
    steps = 2 if 3 * bits < 64 else 1
    h, depth = KEY, int(room.max()) if n else 0
    while h < depth:
        alone = new & np.concatenate((new[1:], [True]))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = sa[open_]
        key = rank[at]
        for j in range(1, steps + 1):
            key = key << bits | np.where(j * h < room[at], rank[np.minimum(at + j * h, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        sa[open_] = at
        new[open_] = fresh
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 1 + steps
    open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    sa[open_] = sa[open_][np.argsort(rank[sa[open_]] * n + sa[open_])]
    return sa, keys


def kasai(sa: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to ``limit``, by place.

    Kasai's rule (a place's common prefix is at least its predecessor's less one)
    is followed in all contents at once, a step in each.
    """
    n = len(sa)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    end_of = np.repeat(ends, ends - starts)
    out = np.zeros(n, dtype=np.int64)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those that go on are a prefix
    starts, sizes = starts[order], (ends - starts)[order]
    length = np.zeros(len(starts), dtype=np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        i = starts[:live] + step
        j = before[i]
        most = np.where(j >= 0, np.minimum(np.minimum(end_of[i] - i, end_of[j] - j), limit), 0)
        size = np.minimum(np.maximum(length[:live] - 1, 0), most)
        go = np.flatnonzero(size < most)
        while len(go):
            a = keys[np.minimum(i[go] + size[go], n - 1)] ^ keys[np.minimum(j[go] + size[go], n - 1)]
            same = np.full(len(go), KEY)
            for b in range(1, KEY + 1):
                same[a >> np.uint64(8 * (KEY - b)) != 0] -= 1
            size[go] = np.minimum(size[go] + same, most[go])
            go = go[(same == KEY) & (size[go] < most[go])]
        length[:live] = size
        out[i] = size
    return out


def repeats_of(contents: list[bytes], owned: np.ndarray, twice: np.ndarray, window: int) -> list[np.ndarray]:
    """For each content which of its first ``owned`` windows are a prefix of two or more of the shard's suffixes.

    ``twice`` contents stand for several equal ones.
    """
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa, keys = suffix_array(data, np.repeat(ends, sizes))
    shared = kasai(sa, keys, starts, ends, window)[sa] >= window
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    weight = np.where(place < np.repeat(owned, sizes), np.repeat(1 + twice, sizes), 0)
    group = np.cumsum(~shared) - 1
    mark = np.empty(len(data), dtype=bool)
    mark[sa] = np.bincount(group, weight[sa])[group] > 1
    return [mark[a : a + o] for a, o in zip(starts, owned)]


def distinct_strings(s: list[int], owned: list[int], contents: list[bytes], window: int):
    """Sorted digests of the different windows of some contents, with kind and place of one of each. Those of several windows are marked already."""
    grams = [mix(Hashes(Symbols([c], False).x).grams(window)[:o]).view(np.int64) for c, o in zip(contents, owned)]
    w, first = np.unique(np.concatenate(grams), return_index=True)
    kind = np.repeat(np.array(s, dtype=np.int64), owned)[first]
    place = np.concatenate([np.arange(o, dtype=np.int32) for o in owned])[first]
    return w, kind, place


def in_shards(contents: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """Runs that repeat within a shard, and the lists of anchors that a shard may share with its neighbours."""
    ddl = f"{RUNS}, shard long, w array<long>, kinds array<long>, place array<int>"  # of a list: sorted digests of its strings, with kind and place of each
    schema = arrow_schema(ddl)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows, size = [], 0

        def shard():
            nonlocal number
            number += 1
            h, s, twice, owned, content = (list(c) for c in zip(*rows))
            marks = repeats_of(content, np.array(owned), np.array(twice, dtype=np.int64), window)
            out = [(a, b, runs_of(m), None, None, None, None) for a, b, m in zip(h, s, marks) if m.any()]
            for edge in {h[0], h[-1]}:  # sorted by anchor, so these alone may go on in other shards
                own = [i for i, a in enumerate(h) if a == edge]
                w, kind, place = distinct_strings([s[i] for i in own], [owned[i] for i in own], [content[i] for i in own], window)
                out.append((edge, None, None, number, w, kind, place))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types)], schema=schema)

        for b in batches:
            for row in rows_of(b, "h", "s", "twice", "owned", "content"):
                rows.append(row)
                size += len(row[-1])
                if size >= shard_bytes:
                    yield shard()
                    rows, size = [], 0
        if rows:
            yield shard()

    order = ["h", "s"]
    return contents.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), ddl)


def merged(lists: DataFrame) -> DataFrame:
    """Runs of the strings that two or more lists of an anchor hold.

    The lists are cut into as many slices as their anchor has lists.
    """
    several = saved(lists.groupBy("h").agg(F.count("*").cast("int").alias("lists")).where("lists > 1"), "several")
    ddl = "h long, part int, shard long, w array<long>, kinds array<long>, place array<int>"
    schema, out_schema = arrow_schema(ddl), arrow_schema(RUNS)

    def columns(b, i):
        return [b.column(c)[i].values.to_numpy() for c in ("w", "kinds", "place")]

    def cut(batches):
        for b in batches:
            for i, (h, shard, n) in enumerate(rows_of(b, "h", "shard", "lists")):
                w, kinds, place = columns(b, i)
                bounds = ((np.arange(1, n, dtype=object) * (1 << 64)) // n - (1 << 63)).astype(np.int64)
                at = np.concatenate(([0], np.searchsorted(w, bounds), [len(w)]))
                rows = [(h, p, shard, w[x:y], kinds[x:y], place[x:y]) for p, (x, y) in enumerate(zip(at[:-1], at[1:])) if x < y]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), schema.types)], schema=schema)

    def merge(batches):
        key, slices = None, []

        def done():
            have, both = slices[0][0], []
            for w, _, _ in slices[1:]:
                to = np.searchsorted(have, w)
                known = have[np.minimum(to, len(have) - 1)] == w
                both.append(w[known])
                have = np.insert(have, to[~known], w[~known])
            both = np.unique(np.concatenate(both)) if both else have[:0]
            if not len(both):
                return
            w, kinds, place = (np.concatenate(c) for c in zip(*slices))
            hit = both[np.minimum(np.searchsorted(both, w), len(both) - 1)] == w
            order = np.lexsort((place[hit], kinds[hit]))
            kinds, place = kinds[hit][order], place[hit][order]
            ids, first = np.unique(kinds, return_index=True)
            runs = pa.ListArray.from_arrays(pa.array(np.append(2 * first, 2 * len(place)).astype(np.int32)), pa.array(np.repeat(place, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key[0])), pa.array(ids), runs], schema=out_schema)

        for b in batches:
            for i, now in enumerate(rows_of(b, "h", "part")):
                if now != key and slices:
                    yield from done()
                    slices = []
                key = now
                slices.append(columns(b, i))
        if slices:
            yield from done()

    parts = lists.join(several, "h").select("h", "shard", "lists", "w", "kinds", "place").mapInArrow(tidy(cut), ddl)
    out = saved(parts.repartition("h", "part").sortWithinPartitions("h", "part", "shard").mapInArrow(tidy(merge), RUNS), "merged")
    discard(several)
    return out


def marked(window: int, shard_bytes: int):
    """See ``passages.repeated``: repeats within shards, then those of several shards."""

    def mark(contents: DataFrame) -> DataFrame:
        found = saved(in_shards(contents, window, shard_bytes), "shards")
        common = merged(found.where("shard IS NOT NULL").select("h", "shard", "w", "kinds", "place"))
        runs = found.where("shard IS NULL").select("h", "s", "runs").unionByName(common)
        out = saved(runs.groupBy("h", "s").agg(F.flatten(F.collect_list("runs")).alias("runs")), "marks")
        discard(found, common)
        return out

    return mark


def finish(window: int):
    def one(text: bytes, runs):
        gone = covered(runs, window, len(text))
        data = np.frombuffer(text, dtype=np.uint8)
        n = int(gone.sum())
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        return len(text), n, spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    return one


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, k: int = 32, shard_bytes: int = SHARD) -> DataFrame:
    """Counts and the digest of what is left of every document."""
    docs = with_uid(texts(docs, id_col, text_col))
    return finished(docs, repeated(docs, window, k, False, marked(window, shard_bytes)), finish(window), SCHEMA)
