"""Lexical retrieval packing.

Documents become token ids, which are written once. Document frequencies, the
number of documents and their mean length are counted over the whole corpus. A
tree of two-means splits, grown on a sample of the documents' projected term
weights, then puts documents of like content side by side, wherever they were
read; in that order they are dealt to shards of about ``shard_tokens`` tokens.
Each shard has a BM25 inverted index
over its documents' ids. Windows are filled greedily: a seed document is placed,
then its best unused neighbours by BM25 that still fit; when none fits, the best
one is cut at the window's end and its rest seeds the next window. A seed
without unused neighbours is followed by the next unused document in order. So
all windows are full; what is left at a shard's end is cut into sequences whose
sizes are powers of two, and nothing is padded.

Neighbours are searched in the seed's shard alone, so a related document that
the tree puts into another shard is not found. Memory is bounded by a shard and
its longest document. All terms of a seed that another document of the shard has count in its scores, and
all documents with a score are ranked, as far down as the window needs. The sample is ``PER_SHARD``
documents a shard, ``MOST_SAMPLED`` (of 512 bytes each on the driver) at most.

Defined cases: a null or empty text is the separator alone; repeated rows are
packed each by itself; ties in score go to the earlier document in shard order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, saved, sized, slices, texts, tidy
from tracklake.llm.repeats import mix

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
GPT2_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as Python's strings know it, at a piece's ends.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LOOSE_END = f"^$|{SPACE}$"
LOOSE = f"{LOOSE_END}|^{SPACE}"
K1, B = 1.2, 0.75
#: Sizes of the projected term weights, and documents sampled for each shard.
DIMS, PER_SHARD = 128, 16
#: Documents sampled at most; with more shards than these make parts of the tree, a part is dealt to several shards.
MOST_SAMPLED = 1 << 16
#: A term of more than one document in so many is a row of the index's matrix.
COMMON = 8


class ByteBpe:
    """Ids of a byte-level BPE file."""

    def __init__(self, spec: str):
        import tiktoken

        from tracklake.llm.bpe_automaton import byte_chars

        j = json.loads(spec)
        back = {c: b for b, c in enumerate(byte_chars())}
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in j["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in j["model"]["vocab"].items() if t not in self.added}
        self.slow = tiktoken.Encoding("ranks", pat_str=GPT2_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.widths = np.zeros(max(ranks.values(), default=-1) + 1, dtype=np.int64)
        self.widths[list(ranks.values())] = [len(t) for t in ranks]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces``, each after a space, in one call, and where each piece's begin."""
        if not len(pieces):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        ids = np.array(self.slow(" " + text), dtype="<u4")
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)))
        at = np.concatenate(([0], np.cumsum(self.widths[ids])))
        begins = np.searchsorted(at, bounds)
        if not np.array_equal(at[begins], bounds):
            raise ValueError("a token spans two pieces")
        return ids, begins

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        parts = self.cut_added.split(text) if self.cut_added and any(t in text for t in self.added) else [text]
        return b"".join(self.added.get(p) or array("I", self.slow(p)).tobytes() for p in parts if p)

    def column(self, texts: pa.Array, end: int, kind: str) -> pa.Array:
        """Ids of every text of a string column, of type ``kind``, with the id ``end`` after them.

        Texts are cut at single spaces; a batch's different pieces are encoded once.
        """
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        sizes = pieces.value_lengths().to_numpy()
        flat = pieces.flatten()
        ends = np.cumsum(sizes)
        starts = ends - sizes
        coded = flat.dictionary_encode()
        loose = pc.match_substring_regex(coded.dictionary, LOOSE)  # has no end of its own, as its spaces join its neighbours'
        ids, begins = self._pieces(pc.if_else(loose, "x", coded.dictionary))
        first = flat.take(pa.array(starts)).dictionary_encode()
        leads = [np.array(self.slow(p), dtype="<u4") for p in first.dictionary.to_pylist()]
        code = coded.indices.to_numpy().astype(np.int64)
        whole = loose.to_numpy(zero_copy_only=False)[code]
        whole[starts] = pc.match_substring_regex(first.dictionary, LOOSE_END).to_numpy(zero_copy_only=False)[first.indices.to_numpy()]
        code[starts] = first.indices.to_numpy().astype(np.int64) + len(coded.dictionary)
        odd = np.logical_or.reduceat(whole, starts) if len(starts) else whole
        for t in self.added:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        data = np.concatenate([ids, *leads]).astype(kind)
        begins = np.concatenate((begins, len(ids) + np.cumsum([len(x) for x in leads], dtype=np.int64))) * data.itemsize
        values = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values.take(pa.array(code))), b"")
        if odd.any():
            rows = joined.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                rows[i] = np.frombuffer(self.ids(texts[i].as_py()), "<u4").astype(kind).tobytes()
            joined = pa.array(rows, pa.binary())
        return pc.binary_join_element_wise(joined, pa.scalar(np.array([end], kind).tobytes(), pa.binary()), pa.scalar(b"", pa.binary()))


@lru_cache(maxsize=4)
def byte_bpe(spec: str) -> ByteBpe:
    return ByteBpe(spec)


def doc_terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, term, count)``, sorted by term, then document."""
    sizes = [len(d) for d in docs]
    keys = np.repeat(np.arange(len(docs), dtype=np.uint64), sizes) | (np.concatenate(docs).astype(np.uint64) << np.uint64(32))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), (keys >> np.uint64(32)).astype(np.int64), tf


class Corpus:
    """Counts over all documents: how many, their tokens, and how many hold each id."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.tokens, self.df = n, tokens, df

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        return cls(len(docs), sum(map(len, docs)), np.bincount(doc_terms(docs)[1]))

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        """Term weights of documents, projected by signed hashing to ``DIMS``, of length one; terms of one document alone don't count."""
        doc, term, tf = doc_terms(docs)
        h = mix(np.arange(len(self.df), dtype=np.uint64))
        value = np.where(self.df > 1, self.idf(), 0) * np.where(h >> np.uint64(63), 1, -1)
        slot = (h % np.uint64(DIMS)).astype(np.int64)
        x = np.bincount(doc * DIMS + slot[term], value[term] * np.log1p(tf), len(docs) * DIMS).reshape(-1, DIMS)
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Tree:
    """Splits of a sample by two means until a part has at most ``least`` rows; parts are numbered from left to right."""

    def __init__(self, sample: np.ndarray, least: int):
        self.across, self.bias, self.down, self.part = [], [], [], []
        todo, parts = [(np.arange(len(sample)), None)], 0
        while todo:
            rows, parent = todo.pop()
            if parent is not None:
                self.down[parent[0]][parent[1]] = len(self.down)
            x = sample[rows]
            across, bias = self.split(x) if len(rows) > least else (None, 0.0)
            right = x @ across > bias if across is not None else np.zeros(0, dtype=bool)
            inner = bool(right.any()) and not right.all()
            node = len(self.down)
            self.across.append(across if inner else np.zeros(DIMS, dtype=np.float32))
            self.bias.append(bias)
            self.down.append([node, node])
            self.part.append(-1 if inner else parts)
            if inner:
                todo += [(rows[right], (node, 1)), (rows[~right], (node, 0))]
            else:
                parts += 1
        self.across, self.bias = np.array(self.across), np.array(self.bias, dtype=np.float32)
        self.down, self.part = np.array(self.down), np.array(self.part)

    @staticmethod
    def split(x: np.ndarray) -> tuple[np.ndarray, float]:
        a = x[np.argmin(x @ x.mean(0))]
        b = x[np.argmin(x @ a)]
        for _ in range(8):
            right = x @ (a - b) > (a @ a - b @ b) / 2
            if right.all() or not right.any():
                break
            a, b = x[right].mean(0), x[~right].mean(0)
        return a - b, float(a @ a - b @ b) / 2

    def parts(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (open_ := np.flatnonzero(self.part[at] < 0)).size:
            node = at[open_]
            right = np.einsum("ij,ij->i", x[open_], self.across[node]) > self.bias[node]
            at[open_] = self.down[node, right.astype(np.int64)]
        return self.part[at]


class Bm25:
    """An inverted index over one shard: postings by term, with the terms' weights in their documents."""

    def __init__(self, docs: list[np.ndarray], query_terms: int | None = None, corpus: Corpus | None = None):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.doc, term, tf = doc_terms(docs)
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        self.starts = np.append(starts, len(term))
        df = np.diff(self.starts)
        slot = np.repeat(np.arange(len(df)), df)
        corpus = corpus or Corpus.of(docs)
        mean = corpus.tokens / max(corpus.n, 1)
        self.weight = (corpus.idf()[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / max(mean, 1)))).astype(np.float64)
        # each document's terms, or its best ones, are its query; those of one document alone find nobody
        shared = np.flatnonzero(df[slot] > 1)
        order = shared[np.lexsort((slot[shared], -self.weight[shared], self.doc[shared]))]
        at = np.searchsorted(self.doc[order], np.arange(n + 1))
        query = [slot[order[a : b if query_terms is None else min(b, a + query_terms)]] for a, b in zip(at[:-1], at[1:])]
        # terms of many documents are kept as rows of a matrix, which add up faster than postings
        common = df > max(1, n // COMMON)
        row = np.cumsum(common) - 1
        self.rows = np.zeros((int(common.sum()), n), dtype=np.float32)
        often = common[slot]
        self.rows[row[slot[often]], self.doc[often]] = self.weight[often]
        self.query = [q[~common[q]] for q in query]
        self.common = [row[q[common[q]]] for q in query]
        left = ~often
        self.starts = np.concatenate(([0], np.cumsum(left)))[self.starts]
        self.doc, self.weight = self.doc[left], self.weight[left]
        self.n = n

    def drop(self, used: np.ndarray) -> None:
        """Forget the postings of used documents."""
        live = ~used[self.doc]
        self.starts = np.concatenate(([0], np.cumsum(live)))[self.starts]
        self.doc, self.weight = self.doc[live], self.weight[live]

    def scores(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Every unused document's score, by all terms of the seed's query."""
        score = self.rows[self.common[seed]].sum(0).astype(np.float64)
        begin = self.starts[self.query[seed]]
        size = self.starts[self.query[seed] + 1] - begin
        total = int(size.sum())
        if total:
            at = np.arange(total) + np.repeat(begin - np.cumsum(size) + size, size)
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        return score

    def neighbours(self, seed: int, used: np.ndarray, k: int) -> np.ndarray:
        """Up to ``k`` unused documents, best first; ties go to the earlier one."""
        score = self.scores(seed, used)
        return ranked(np.flatnonzero(score), score)[:k]


def ranked(docs: np.ndarray, score: np.ndarray) -> np.ndarray:
    return docs[np.lexsort((docs, -score[docs]))]


class Near:
    """All documents with a score, best first, for one window, whose room only shrinks. The first ``look`` are sorted at once, the rest if they are asked for."""

    def __init__(self, score: np.ndarray, sizes: np.ndarray, lengths: list[int], look: int):
        self.score, self.sizes, self.lengths = score, sizes, lengths
        hit = np.flatnonzero(score)
        self.rest = hit[:0]
        if len(hit) > 4 * look:
            s = score[hit]
            best = s >= -np.partition(-s, look)[look]
            hit, self.rest = hit[best], hit[~best]
        self.ahead, self.at, self.best, self.over = ranked(hit, score).tolist(), 0, None, None

    def take(self, room: int) -> int | None:
        """The best that fits, else the best of all, which is then to be cut: the first one passed over, as all come in order, or the best of the rest that never fitted."""
        while True:
            ahead, lengths = self.ahead, self.lengths
            for at in range(self.at, len(ahead)):
                x = ahead[at]
                if lengths[x] <= room:
                    self.at = at + 1
                    return x
                if self.best is None:
                    self.best = x if self.over is None or (-self.score[x], x) < (-self.score[self.over], self.over) else self.over
            self.at = len(ahead)
            if not len(self.rest):
                return self.over if self.best is None else self.best
            fits = self.sizes[self.rest] <= room
            fit, over = self.rest[fits], self.rest[~fits]
            self.ahead, self.at, self.rest = ranked(fit, self.score).tolist(), 0, fit[:0]
            if len(over):
                self.over = int(over[np.argmax(self.score[over])])


def pack(docs: list[np.ndarray], window: int = 1024, query_terms: int | None = None, look: int = 32, corpus: Corpus | None = None):
    """Yields ``(doc, start, length, sequence, offset)``, covering every id once."""
    index = Bm25(docs, query_terms, corpus)
    n = len(docs)
    used = np.zeros(n, dtype=bool)
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    total, nxt, seq, room = int(sizes.sum()), 0, 0, window
    doc, start, placed, cap = None, 0, 0, window
    live, gone = n, 0
    lengths = sizes.tolist()
    none = Near(np.zeros(n), sizes, lengths, look)
    seed, near = None, none

    def around(x: int) -> Near:
        nonlocal live, gone
        if 4 * gone > live:
            index.drop(used)
            live, gone = live - gone, 0
        return Near(index.scores(x, used), sizes, lengths, look)

    if total < window:
        cap = room = 1 << (total.bit_length() - 1) if total else 0
    while placed < total:
        if doc is None:
            doc = near.take(room)
            if doc is None:
                while used[nxt]:
                    nxt += 1
                doc = nxt
            used[doc], start, gone = True, 0, gone + 1
            if seed is None:
                seed = doc
                near = around(seed) if sizes[doc] < room else none
        take = min(room, int(sizes[doc]) - start)
        yield doc, start, take, seq, cap - room
        placed, room, start = placed + take, room - take, start + take
        over = start == sizes[doc]
        if not room:
            seq += 1
            left = total - placed
            cap = room = window if left >= window else 1 << (left.bit_length() - 1) if left else 0
            if over:
                seed = None
                near.score[used] = 0
                near = Near(near.score, sizes, lengths, look)
            else:
                seed = doc
                near = around(doc) if sizes[doc] - start < room else none
        if over:
            doc = None


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, separator: int = 0, shard_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece. ``sequence_id`` is the task's number times 2**32 plus a count within the task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(text)
    model = json.loads(text)
    kind = "<u2" if max([separator, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) < 1 << 16 else "<u4"  # of the ids as written
    coded = saved(token_ids(texts(docs, id_col, text_col), spec, separator, kind), "token_ids", "zstd")
    corpus = frequencies(coded, kind)
    if not corpus.n:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    shards = 1 if corpus.tokens <= shard_tokens else -(-corpus.tokens * 5 // (4 * shard_tokens))  # ranges differ in size; a quarter more of them leaves few rests
    counts = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0

        def shard():
            nonlocal base, keys, ids, held
            rows, top = [], -1
            for d, start, length, seq, offset in pack(ids, window, corpus=counts.value):
                rows.append((keys[d], start, length, zlib.crc32(ids[d][start : start + length].tobytes()), len(ids[d]), base + seq, offset))
                top = seq
            base += top + 1
            keys, ids, held = [], [], 0
            cols = list(zip(*rows))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

        for b in (x for whole in batches for x in slices(whole)):
            keys_, got_ = b.column("doc_id").to_pylist(), listed(b, kind)
            for key, got in zip(keys_, got_):
                keys.append(key)
                ids.append(got)
                held += len(got)
                if held >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()

    order = ["part", F.xxhash64("ids"), "doc_id"]
    alike = grouped(coded, corpus, counts, shards, kind)
    return alike.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(tidy(run), SCHEMA)


def listed(batch, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind).astype("<u4") for x in batch.column("ids").to_pylist()]


def token_ids(source: DataFrame, spec, separator: int, kind: str) -> DataFrame:
    """``(doc_id, ids)``: ids of type ``kind`` with the separator at the end."""
    schema = arrow_schema("doc_id long, ids binary")

    def run(batches):
        bpe = byte_bpe(spec.value)
        for b in (x for whole in batches for x in sized(whole)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), bpe.column(b.column("text"), separator, kind)], schema=schema)

    return source.mapInArrow(tidy(run), "doc_id long, ids binary")


def frequencies(coded: DataFrame, kind: str) -> Corpus:
    """Counted in the tasks; the driver gets one number for each id of the vocabulary."""
    schema = arrow_schema("term long, n long")

    def run(batches):
        df, n, tokens = np.zeros(0, dtype=np.int64), 0, 0
        for b in (x for whole in batches for x in slices(whole)):
            docs = listed(b, kind)
            got = np.bincount(doc_terms(docs)[1], minlength=len(df))
            got[: len(df)] += df
            df, n, tokens = got, n + len(docs), tokens + sum(map(len, docs))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, tokens]))], schema=schema)

    found = {r[0]: r[1] for r in coded.mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=-1) + 1, dtype=np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, tokens, df)


def grouped(coded: DataFrame, corpus: Corpus, counts, shards: int, kind: str) -> DataFrame:
    """``coded`` with the number of the part of the tree that a document belongs to."""
    schema, fields = arrow_schema("doc_id long, ids binary, part long"), "doc_id long, ids binary, part long"
    vector = arrow_schema("x binary")

    def project(batches):
        for b in (x for whole in batches for x in slices(whole)):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in counts.value.vectors(listed(b, kind))], pa.binary())], schema=vector)

    share = min(1.0, min(PER_SHARD * shards, MOST_SAMPLED) / corpus.n)
    chosen = coded.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted(r[0] for r in chosen.select("ids").limit(2 * MOST_SAMPLED).mapInArrow(tidy(project), "x binary").collect()) if shards > 1 else []  # equal rows are drawn together
    sample = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, DIMS)
    tree = coded.sparkSession.sparkContext.broadcast(Tree(sample, PER_SHARD))

    def run(batches):
        for b in (x for whole in batches for x in slices(whole)):
            if b.num_rows:
                part = tree.value.parts(counts.value.vectors(listed(b, kind)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(part, pa.int64())], schema=schema)

    return saved(coded.mapInArrow(tidy(run), fields), "parts", "zstd")
