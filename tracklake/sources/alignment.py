"""Alignments from SAM text and from BAM, as the table ``reads`` with CIGAR, name and sequence.

BAM is a file of gzip blocks of at most 64 KiB. It is split at any bytes: a task
looks for the first block in its range, and in it for a place from which several
records in a row make sense, and owns the records that start in its blocks,
reading on past them to finish the last. With an index beside the file, a region
is read from the chunks that the index names for it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracklake.functions.alignment import reference_length
from tracklake.sources.files import opened, sized

SCHEMA = "chrom string, begin long, end long, mapq int, flag int, cigar string, name string, sequence string"
SPLIT = 8 << 20
BLOCK = b"\x1f\x8b\x08\x04"
#: Codes of the format, in its order.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
ON_REFERENCE = np.array([c in "MDN=X" for c in OPS])
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("next", "<i4"), ("at", "<i4"), ("span", "<i4")])
#: Records that must make sense in a row where a range's first one is looked for.
CHAIN = 4


def block_size(head: bytes) -> tuple[int, int] | None:
    """Size of the whole block that begins with ``head``, and of its header."""
    if len(head) < 18 or head[:4] != BLOCK:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 6 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1, end
        at += 4 + n
    return None


def blocks(f, at: int):
    """``(offset, data)`` of block after block, from the one at ``at`` on."""
    f.seek(at)
    buf = b""
    while True:
        while len(buf) < 1 << 16 and (more := f.read(1 << 20)):
            buf += more
        if not buf:
            return
        size = block_size(buf[:1024])
        if size is None or size[0] > len(buf):
            raise ValueError(f"no block at byte {at}")
        yield at, zlib.decompress(buf[size[1] : size[0] - 8], -15)
        at, buf = at + size[0], buf[size[0] :]


def first_block(f, start: int, stop: int) -> int | None:
    """Where the first block begins that starts in a range of bytes."""
    f.seek(start)
    buf = f.read(3 << 16)
    at = buf.find(BLOCK)
    while 0 <= at < stop - start:
        size = block_size(buf[at : at + 1024])
        if size:
            end = at + size[0]
            rest = buf[end : end + 1024]
            if (not rest and len(buf) < 3 << 16) or block_size(rest):
                try:
                    zlib.decompress(buf[at + size[1] : end - 8], -15)
                    return start + at
                except zlib.error:
                    pass
        at = buf.find(BLOCK, at + 1)
    return None


@dataclass
class Header:
    text: str
    names: list[str]
    sizes: list[int]
    first: tuple[int, int]  # block and byte in it of the first record


def header(path: str) -> Header:
    """The header of a BAM file."""
    with opened(path) as f:
        buf, marks, source = b"", [], blocks(f, 0)

        def need(n: int) -> None:
            nonlocal buf
            while len(buf) < n:
                got = next(source, None)
                if got is None:
                    raise ValueError(f"{path} ends in its header")
                marks.append((len(buf), got[0]))
                buf += got[1]

        need(12)
        if buf[:4] != b"BAM\1":
            raise ValueError(f"{path} is not a BAM file")
        at = 8 + struct.unpack_from("<i", buf, 4)[0]
        need(at + 4)
        text = buf[8:at].rstrip(b"\0").decode()
        count, at = struct.unpack_from("<i", buf, at)[0], at + 4
        names, sizes = [], []
        for _ in range(count):
            need(at + 4)
            n = struct.unpack_from("<i", buf, at)[0]
            need(at + 8 + n)
            names.append(buf[at + 4 : at + 3 + n].decode())
            sizes.append(struct.unpack_from("<i", buf, at + 4 + n)[0])
            at += 8 + n
        held = marks[bisect_right([m[0] for m in marks], at) - 1]
        return Header(text, names, sizes, (held[1], at - held[0]))


def makes_sense(buf: bytes, at: int, sizes: list[int]) -> int:
    """The whole size of the record at a place, 0 where there can be none."""
    size, ref, pos, name, _, _, ops, _, seq = struct.unpack_from("<iiiBBHHHi", buf, at)
    if not (32 <= size < 1 << 28 and -1 <= ref < len(sizes) and -1 <= pos and name and 0 <= seq and 32 + name + 4 * ops + (seq + 1) // 2 + seq <= size):
        return 0
    if ref >= 0 and pos > sizes[ref]:
        return 0
    word = buf[at + 36 : at + 36 + name]
    if len(word) == name and (word[-1] or not all(33 <= c < 127 for c in word[:-1])):
        return 0
    cigar = buf[at + 36 + name : at + 36 + name + 4 * ops]
    return 0 if any(c & 15 > 8 for c in cigar[::4]) else size + 4


def chain(buf: bytes, at: int, sizes: list[int], ended: bool) -> bool | None:
    """Whether records follow one another from a place on; None if more bytes are needed to tell."""
    for _ in range(CHAIN):
        if at == len(buf) and ended:
            return True
        if at + 36 > len(buf):
            return False if ended else None
        step = makes_sense(buf, at, sizes)
        if not step:
            return False
        at += step
    return True if at <= len(buf) else False if ended else None


def records(f, sizes: list[int], begin: tuple[int, int | None], stop: tuple[int, int]):
    """``(bytes, offsets)`` of records that start at or after ``begin`` and before ``stop``, both a block and a byte in it.

    Where the byte of ``begin`` is None it is looked for.
    """
    source = blocks(f, begin[0])
    buf, marks, at, ended = b"", [], begin[1], False

    def place(x: int) -> tuple[int, int]:
        held = marks[bisect_right([m[0] for m in marks], x) - 1]
        return held[1], x - held[0]

    def more() -> None:
        nonlocal buf, ended
        got = next(source, None)
        if got is None:
            ended = True
        elif got[1]:
            marks.append((len(buf), got[0]))
            buf += got[1]

    more()
    look = 0
    while at is None:
        if marks and place(look) >= stop:
            return
        good = chain(buf, look, sizes, ended) if look < len(buf) else None
        if good:
            at = look
        elif good is None and ended:
            return
        elif good is None:
            more()
        else:
            look += 1
    while True:
        offsets, done = [], False
        while not done:
            if at + 4 > len(buf) or at + 4 + struct.unpack_from("<i", buf, at)[0] > len(buf):
                break
            if place(at) >= stop:
                done = True
                break
            offsets.append(at)
            at += 4 + struct.unpack_from("<i", buf, at)[0]
        if offsets:
            yield buf, offsets
        if done:
            return
        if marks and at < len(buf) and place(at) >= stop:
            return
        kept = [m for m in marks if m[0] <= at][-1:] + [m for m in marks if m[0] > at]
        marks[:] = [(a - at, b) for a, b in kept]
        buf, at = buf[at:], 0
        before = len(buf)
        for _ in range(32):
            more()
        if ended and len(buf) == before:
            if buf:
                raise ValueError("the file ends within a record")
            return


def table(buf: bytes, offsets: list[int], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    data = np.frombuffer(buf, dtype=np.uint8)
    at = np.array(offsets)
    fixed = np.ascontiguousarray(data[at[:, None] + np.arange(36)]).view(FIXED)[:, 0]
    cigars, words, bases, spans = [], [], [], []
    for o, name, ops, seq in zip(offsets, fixed["name"].tolist(), fixed["ops"].tolist(), fixed["seq"].tolist()):
        o += 36
        words.append(buf[o : o + name - 1].decode())
        code = np.frombuffer(buf, "<u4", ops, o + name)
        spans.append(int((code >> 4)[ON_REFERENCE[code & 15]].sum()))
        cigars.append("".join(f"{c >> 4}{OPS[c & 15]}" for c in code.tolist()) or "*")
        half = data[o + name + 4 * ops : o + name + 4 * ops + (seq + 1) // 2]
        bases.append("".join(BASES[x >> 4] + BASES[x & 15] for x in half.tolist())[:seq] or "*")
    chrom = [names[r] if r >= 0 else None for r in fixed["ref"].tolist()]
    begin = fixed["pos"].astype(np.int64)
    cols = [chrom, begin, begin + np.array(spans, dtype=np.int64), fixed["mapq"].astype(np.int32), fixed["flag"].astype(np.int32), cigars, words, bases]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def bins_of(begin: int, end: int) -> set[int]:
    """Numbers of the index's bins, from the widest level to the narrowest, that a range touches."""
    out = {0}
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out |= set(range(first + (begin >> shift), first + ((end - 1) >> shift) + 1))
    return out


def indexed_chunks(index: bytes, ref: int, begin: int, end: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Stretches of the file, as pairs of block and byte, that may hold records of a region."""
    if index[:4] != b"BAI\1":
        raise ValueError("not an index of a BAM file")
    at, wanted, found, low = 8, bins_of(begin, end), [], 0
    for r in range(struct.unpack_from("<i", index, 4)[0]):
        n, at = struct.unpack_from("<i", index, at)[0], at + 4
        for _ in range(n):
            number, chunks = struct.unpack_from("<Ii", index, at)
            if r == ref and number in wanted:
                found += [struct.unpack_from("<QQ", index, at + 8 + 16 * k) for k in range(chunks)]
            at += 8 + 16 * chunks
        n, at = struct.unpack_from("<i", index, at)[0], at + 4
        if r == ref and n:
            low = struct.unpack_from("<Q", index, at + 8 * min(begin >> 14, n - 1))[0]
        at += 8 * n
    out: list[list[int]] = []
    for a, b in sorted(x for x in found if x[1] > low):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [((a >> 16, a & 0xFFFF), (b >> 16, b & 0xFFFF)) for a, b in out]


@dataclass
class Part(InputPartition):
    path: str
    names: list[str]
    sizes: list[int]
    begin: tuple[int, int | None]
    stop: tuple[int, int]
    region: tuple[str, int, int] | None = None


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.region, self.split = options["path"], options.get("region"), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path, size in sized(self.path):
            if not path.lower().endswith(".bam") and path != self.path:
                continue
            h = header(path)
            if self.region:
                from tracklake.functions.regions import parse_region

                region = parse_region(self.region, dict(zip(h.names, h.sizes)))
                if region is None:
                    continue
                try:
                    with opened(f"{path}.bai") as f:
                        chunks = indexed_chunks(f.read(), h.names.index(region[0]), region[1], region[2])
                    out += [Part(path, h.names, h.sizes, a, b, region) for a, b in chunks]
                    continue
                except OSError:  # no index: all of the file is read
                    pass
            for start in range(0, size, self.split):
                begin = h.first if start <= h.first[0] < start + self.split else (start, None)
                if start + self.split > h.first[0]:
                    out.append(Part(path, h.names, h.sizes, begin, (start + self.split, 0), region if self.region else None))
        return out or [Part("", [], [], (0, 0), (0, 0))]

    def read(self, part: Part):
        if not part.path:
            return
        schema = ARROW
        with opened(part.path) as f:
            begin = part.begin
            if begin[1] is None:
                at = first_block(f, begin[0], part.stop[0])
                if at is None:
                    return
                begin = (at, None)
            for buf, offsets in records(f, part.sizes, begin, part.stop):
                for i in range(0, len(offsets), 4096):
                    got = table(buf, offsets[i : i + 4096], part.names, schema)
                    if part.region:
                        chrom, b, e = part.region
                        got = got.filter(pa.array([c == chrom and x < e and y > b for c, x, y in zip(got["chrom"].to_pylist(), got["begin"].to_pylist(), got["end"].to_pylist())]))
                    yield got


ARROW = pa.schema([("chrom", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("mapq", pa.int32()), ("flag", pa.int32()), ("cigar", pa.string()), ("name", pa.string()), ("sequence", pa.string())])


class BamSource(DataSource):
    """``spark.read.format("bam")``; options ``path``, ``region`` (``chr:b-e``) and ``split`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def bam(spark: SparkSession, path: str, region: str | None = None, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("split", split)
    return (reader.option("region", region) if region else reader).load(path)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Text lines; those of the header start with ``@``. Positions are counted from 1 there, from 0 here."""
    f = spark.read.text(path).where("NOT value LIKE '@%' AND value <> ''").select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get(F.col("f"), F.lit(i))
    rows = f.select(F.when(at(2) != "*", at(2)).alias("chrom"), (at(3).cast("long") - 1).alias("begin"), at(4).cast("int").alias("mapq"), at(1).cast("int").alias("flag"), at(5).alias("cigar"), at(0).alias("name"), at(9).alias("sequence"))
    return rows.select("chrom", "begin", (F.col("begin") + reference_length("cigar")).alias("end"), "mapq", "flag", "cigar", "name", "sequence")


def genome_of(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes from the header of the first file; a genome has few rows."""
    if path.lower().endswith(".sam"):
        lines = [r[0] for r in spark.read.text(path).where("value LIKE '@SQ%'").collect()]
        rows = [(x["SN"], int(x["LN"])) for x in (dict(p.split(":", 1) for p in line.split("\t")[1:]) for line in lines)]
    else:
        h = header(next(p for p, _ in sized(path) if p.lower().endswith(".bam") or p == path))
        rows = list(zip(h.names, h.sizes))
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(rows)], "chrom string, size long, chrom_id int")


def alignments(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """Reads of a SAM or BAM file or of a directory of BAM files."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "cram":
        raise NotImplementedError("CRAM needs a native decoder: convert it to BAM, or give its reads as a table")
    return sam(spark, path) if kind == "sam" else bam(spark, path, region)
