"""Intervals of real values from BigWig files.

The file's R-tree names its data blocks with the region of each. The driver reads the
tree, keeps the blocks that a region needs, and deals neighbours to tasks of about
``split`` bytes; a task inflates its blocks and reads their sections as arrays.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracklake.sources.files import opened, sized

SCHEMA = "chrom string, begin long, end long, value double"
ARROW = pa.schema([("chrom", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("value", pa.float64())])
SPLIT = 4 << 20
#: Signatures of the format's parts.
FILE, NAMES, TREE = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


class BigWig:
    """What is read of a file to plan a scan of it."""

    def __init__(self, path: str):
        self.path, self.f = path, opened(path)
        head = self.f.read(64)
        self.order = "<" if struct.unpack_from("<I", head)[0] == FILE else ">"
        if self.get("I", head)[0] != FILE:
            raise ValueError(f"{path} is not a BigWig file")
        _, _, _, names, _, tree, _, _, _, _, buffer, _ = self.get("IHHQQQHHQQIQ", head)
        self.inflate, self.tree = buffer > 0, tree
        self.chroms = self._chroms(names)

    def get(self, kinds: str, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.order + kinds, data, at)

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def _chroms(self, offset: int) -> dict[int, tuple[str, int]]:
        signature, _, key, value, _, _ = self.get("IIIIQQ", self._at(offset, 32))
        if signature != NAMES:
            raise ValueError(f"{self.path} has no list of names")
        out, todo = {}, [offset + 32]
        while todo:
            at = todo.pop()
            leaf, _, count = self.get("BBH", self._at(at, 4))
            width = key + (value if leaf else 8)
            data = self._at(at + 4, count * width)
            for i in range(count):
                if leaf:
                    number, size = self.get("II", data, i * width + key)
                    out[number] = (data[i * width : i * width + key].rstrip(b"\0").decode(), size)
                else:
                    todo.append(self.get("Q", data, i * width + key)[0])
        return dict(sorted(out.items()))

    def blocks(self, region: tuple[int, int, int] | None = None) -> list[tuple[int, int]]:
        """``(offset, size)`` of the data blocks, or of those that touch ``(chromosome, begin, end)``, in file order."""
        signature = self.get("I", self._at(self.tree, 4))[0]
        if signature != TREE:
            raise ValueError(f"{self.path} has no tree of blocks")
        out, todo = [], [self.tree + 48]
        while todo:
            at = todo.pop()
            leaf, _, count = self.get("BBH", self._at(at, 4))
            width = 32 if leaf else 24
            data = self._at(at + 4, count * width)
            for i in range(count):
                c0, b, c1, e, *where = self.get("IIIIQQ" if leaf else "IIIIQ", data, i * width)
                if region is None or ((c0, b) < (region[0], region[2]) and (c1, e) > (region[0], region[1])):
                    (out if leaf else todo).append(tuple(where) if leaf else where[0])
        return sorted(out)


def section(data: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome's number, begins, ends and values of a data block."""
    chrom, start, _, step, span, kind, _, count = struct.unpack_from(order + "IIIIIBBH", data)
    if kind == 1:
        x = np.frombuffer(data, np.dtype([("b", order + "u4"), ("e", order + "u4"), ("v", order + "f4")]), count, 24)
        return chrom, x["b"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(np.float64)
    if kind == 2:
        x = np.frombuffer(data, np.dtype([("b", order + "u4"), ("v", order + "f4")]), count, 24)
        return chrom, x["b"].astype(np.int64), x["b"].astype(np.int64) + span, x["v"].astype(np.float64)
    if kind == 3:
        begin = start + np.arange(count, dtype=np.int64) * step
        return chrom, begin, begin + span, np.frombuffer(data, order + "f4", count, 24).astype(np.float64)
    raise ValueError(f"unknown section type {kind}")


@dataclass
class Part(InputPartition):
    path: str
    order: str
    inflate: bool
    names: dict
    blocks: list
    region: tuple | None


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.region, self.split = options["path"], options.get("region"), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path, _ in sized(self.path):
            file = BigWig(path)
            region = None
            if self.region:
                from tracklake.functions.regions import parse_region

                got = parse_region(self.region, dict(file.chroms.values()))
                if got is None:
                    continue
                region = (next(i for i, (c, _) in file.chroms.items() if c == got[0]), got[1], got[2])
            held, size = [], 0
            for block in file.blocks(region):
                held.append(block)
                size += block[1]
                if size >= self.split:
                    out.append(Part(path, file.order, file.inflate, {i: c for i, (c, _) in file.chroms.items()}, held, region))
                    held, size = [], 0
            if held:
                out.append(Part(path, file.order, file.inflate, {i: c for i, (c, _) in file.chroms.items()}, held, region))
        return out or [Part("", "<", False, {}, [], None)]

    def read(self, part: Part):
        if not part.path:
            return
        with opened(part.path) as f:
            for offset, size in part.blocks:
                f.seek(offset)
                data = f.read(size)
                chrom, b, e, v = section(zlib.decompress(data) if part.inflate else data, part.order)
                if part.region:
                    keep = (b < part.region[2]) & (e > part.region[1]) & (chrom == part.region[0])
                    b, e, v = b[keep], e[keep], v[keep]
                yield pa.RecordBatch.from_arrays([pa.array([part.names[chrom]] * len(b), pa.string()), pa.array(b), pa.array(e), pa.array(v)], schema=ARROW)


class BigWigSource(DataSource):
    """``spark.read.format("bigwig")``; options ``path``, ``region`` (``chr:b-e``) and ``split`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options)


def bigwig(spark: SparkSession, path: str, region: str | None = None, split: int = SPLIT) -> DataFrame:
    """Intervals in no order; positions without a value have no row."""
    spark.dataSource.register(BigWigSource)
    reader = spark.read.format("bigwig").option("split", split)
    return (reader.option("region", region) if region else reader).load(path)


def genome_of(spark: SparkSession, path: str) -> DataFrame:
    rows = BigWig(sized(path)[0][0]).chroms.values()
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(rows)], "chrom string, size long, chrom_id int")
