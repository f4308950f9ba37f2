"""Dense tracks of the binary container format: directories of streams and blobs, read by byte ranges.

A track's primary table holds a few bits for every position: an index into its
dictionary, or the last index, which sends the reader to the secondary table of runs.
Tasks take ranges of positions of one chromosome, read their bits as an array, lay
the secondary runs over it and give back runs of equal values.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracklake.sources.files import opened

SCHEMA = "track string, chrom string, begin long, end long, value int"
ARROW = pa.schema([("track", pa.string()), ("chrom", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("value", pa.int32())])
#: Fixed values of the format: where the root directory is, the size of a directory's first frame, names of a track's parts.
ROOT, FIRST_FRAME, FRAME_HEAD = 8, 512, 16
METADATA, PRIMARY, SECONDARY = ".metadata", ".ptab", ".stab"
STREAM, DIRECTORY, BLOB = 0, 1, 2
RECORD = np.dtype([("left", "<u4"), ("more", "<u2"), ("value", "<i4")])
SPLIT = 8_000_000


@dataclass
class Entry:
    kind: int
    offset: int
    size: int


class Container:
    """Directories, streams and blobs of an open file."""

    def __init__(self, f):
        self.f = f

    def at(self, offset: int, size: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(size)

    def frames(self, offset: int, size: int):
        """Payloads of a stream's linked frames."""
        while True:
            data = self.at(offset, size)
            if len(data) < FRAME_HEAD:
                raise ValueError(f"a frame at byte {offset} is cut off")
            step, following = struct.unpack_from("<qQ", data)
            yield data[FRAME_HEAD:]
            if not step:
                return
            offset, size = offset + step, following

    def stream(self, entry: Entry) -> bytes:
        return b"".join(self.frames(entry.offset, entry.size))

    def directory(self, offset: int = ROOT) -> dict[str, Entry]:
        data, at, out = b"".join(self.frames(offset, FIRST_FRAME)), 0, {}
        while at < len(data) and data[at]:
            kind, where, size = struct.unpack_from("<BQQ", data, at + 1)
            end = data.index(0, at + 18)
            if kind > BLOB:
                raise ValueError("not a directory of a track container")
            out[data[at + 18 : end].decode()] = Entry(kind, offset + where, size)
            at = end + 1
        return out

    def find(self, path: str) -> Entry:
        entry = Entry(DIRECTORY, ROOT, 0)
        for name in filter(None, path.split("/")):
            entries = self.directory(entry.offset) if entry.kind == DIRECTORY else {}
            if name not in entries:
                raise FileNotFoundError(path)
            entry = entries[name]
        return entry

    def walk(self, offset: int = ROOT, prefix: str = ""):
        """``(path, entry)`` of everything below a directory."""
        for name, entry in self.directory(offset).items():
            yield prefix + name, entry
            if entry.kind == DIRECTORY:
                yield from self.walk(entry.offset, f"{prefix}{name}/")

    def read(self, path: str) -> bytes:
        """What a stream or a blob holds."""
        entry = self.find(path)
        if entry.kind == DIRECTORY:
            raise IsADirectoryError(path)
        return self.stream(entry) if entry.kind == STREAM else self.at(entry.offset, entry.size)

    def tracks(self, offset: int = ROOT, path: str = "") -> list[str]:
        """Paths of directories with a track's metadata; nothing below one is looked at."""
        entries = self.directory(offset)
        if METADATA in entries and entries[METADATA].kind == STREAM:
            return [path]
        return [t for n, e in entries.items() if e.kind == DIRECTORY for t in self.tracks(e.offset, f"{path}/{n}".strip("/"))]


@dataclass
class TrackHeader:
    chroms: list[tuple[str, int]]
    low: int
    values: list[int] | None
    bits: int
    denominator: float
    primary: int
    streams: list = field(default_factory=list)  # (chrom, begin, end, offset, size)
    deflate: bool = False

    def decoded(self, code: np.ndarray) -> np.ndarray:
        if self.values is None:
            return (code + self.low).astype(np.int32)
        return np.array(self.values, dtype=np.int32)[np.minimum(code, len(self.values) - 1)]


def track_header(c: Container, path: str = "") -> TrackHeader:
    entries = c.directory(c.find(path).offset)
    meta = json.loads(c.stream(entries[METADATA]).rstrip(b"\0"))
    chroms = [(x["name"], x["size"]) for x in meta["chrom_list"]]
    dictionary, denominator = meta["dictionary"], meta.get("denominator", "One")
    if "SimpleRange" in dictionary:
        low, values = dictionary["SimpleRange"]["low"], None
        n = dictionary["SimpleRange"]["high"] - low
    else:
        low, values = 0, dictionary["Dictionary"]["i2v_map"]
        n = len(values)
    out = TrackHeader(chroms, low, values, max(n, 1).bit_length() - 1, 1.0 if denominator == "One" else float(denominator["Value"]), entries[PRIMARY].offset if PRIMARY in entries else 0)
    if SECONDARY in entries:
        inside = c.directory(entries[SECONDARY].offset)
        table = json.loads(c.stream(inside[METADATA]).rstrip(b"\0"))
        out.deflate = table.get("compression", "NoCompression") != "NoCompression"
        out.streams = [(chrom, b, e, inside[str(i)].offset, inside[str(i)].size) for i, (chrom, b, e) in enumerate(table["partitions"])]
    return out


def secondary(c: Container, offset: int, size: int, deflate: bool) -> np.ndarray:
    """Records of one stream of the secondary table."""
    if not deflate:
        data = b"".join(c.frames(offset, size))
    else:
        parts = []
        for i, frame in enumerate(c.frames(offset, size)):
            packed, head = (not i == 0 or frame[0] == 0), 1 if i == 0 else 0
            count = struct.unpack_from("<I", frame, head + 8)[0]
            raw = frame[head + 12 :]
            parts.append((zlib.decompressobj(-15).decompress(raw) if packed else raw)[: count * RECORD.itemsize])
        data = b"".join(parts)
    found = np.frombuffer(data, RECORD, len(data) // RECORD.itemsize)
    return found[found["left"] > 0]


def values_of(c: Container, h: TrackHeader, chrom: str, begin: int, end: int) -> np.ndarray:
    """Stored values of a stretch that begins at a multiple of eight positions."""
    n, last = end - begin, (1 << h.bits) - 1
    if h.bits:
        before = sum((size * h.bits + 7) // 8 for size in (s for name, s in h.chroms[: [x for x, _ in h.chroms].index(chrom)]))
        raw = np.frombuffer(c.at(h.primary + before + begin * h.bits // 8, (n * h.bits + 7) // 8), np.uint8)
        code = np.unpackbits(raw, bitorder="little")[: n * h.bits].reshape(n, h.bits) @ (1 << np.arange(h.bits))
        value, open_ = h.decoded(code), code == last
    else:
        value, open_ = np.full(n, h.decoded(np.zeros(1, np.int64))[0], np.int32), np.ones(n, bool)
    over, known = np.zeros(n, np.int32), np.zeros(n, bool)
    for name, b, e, offset, size in h.streams:
        if name == chrom and b < end and e > begin:
            for left, more, v in secondary(c, offset, size, h.deflate).tolist():
                a, z = max(left - 1 - begin, 0), min(left + more - begin, n)
                if a < z:
                    over[a:z], known[a:z] = v, True
    return np.where(open_ & known, over, value)


@dataclass
class Part(InputPartition):
    path: str
    track: str
    chrom: str
    begin: int
    end: int


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.track, self.region, self.split = options["path"], options.get("track"), options.get("region"), int(options.get("split", SPLIT)) // 8 * 8

    def partitions(self):
        out = []
        with opened(self.path) as f:
            c = Container(f)
            for track in [self.track] if self.track is not None else c.tracks():
                sizes = dict(track_header(c, track).chroms)
                wanted = [(chrom, 0, size) for chrom, size in sizes.items()]
                if self.region:
                    from tracklake.functions.regions import parse_region

                    got = parse_region(self.region, sizes)
                    wanted = [] if got is None else [(got[0], got[1] // 8 * 8, got[2])]
                out += [Part(self.path, track, chrom, a, min(a + self.split, e)) for chrom, b, e in wanted for a in range(b, e, self.split)]
        return out or [Part("", "", "", 0, 0)]

    def read(self, part: Part):
        if not part.path:
            return
        with opened(part.path) as f:
            c = Container(f)
            v = values_of(c, track_header(c, part.track), part.chrom, part.begin, part.end)
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1], [True])))
        n = len(at) - 1
        cols = [pa.array([part.track or "<default>"] * n), pa.array([part.chrom] * n), pa.array(at[:-1] + part.begin), pa.array(at[1:] + part.begin), pa.array(v[at[:-1]])]
        yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(cols, ARROW.types)], schema=ARROW)


class ContainerSource(DataSource):
    """``spark.read.format("track-container")``; options ``path``, ``track``, ``region`` and ``split`` (positions of a task)."""

    @classmethod
    def name(cls) -> str:
        return "track-container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options)


def container(spark: SparkSession, path: str, track: str | None = None, region: str | None = None, split: int = SPLIT) -> DataFrame:
    """Runs of all tracks of a file, or of one; equal neighbours in different tasks aren't merged."""
    spark.dataSource.register(ContainerSource)
    reader = spark.read.format("track-container").option("split", split)
    for key, value in (("track", track), ("region", region)):
        reader = reader if value is None else reader.option(key, value)
    return reader.load(path)


def genome_of(spark: SparkSession, path: str, track: str | None = None) -> DataFrame:
    """Chromosomes with sizes, in the header's order."""
    with opened(path) as f:
        c = Container(f)
        h = track_header(c, c.tracks()[0] if track is None else track)
    return spark.createDataFrame([(name, size, i) for i, (name, size) in enumerate(h.chroms)], "chrom string, size long, chrom_id int")


def denominator_of(path: str, track: str | None = None) -> float:
    with opened(path) as f:
        c = Container(f)
        return track_header(c, c.tracks()[0] if track is None else track).denominator


def dumped(spark: SparkSession, path: str) -> DataFrame:
    """Everything in a file: ``(path, kind, offset, size)``."""
    kinds = {STREAM: "stream", DIRECTORY: "directory", BLOB: "blob"}
    with opened(path) as f:
        rows = [(p, kinds[e.kind], e.offset, e.size) for p, e in Container(f).walk()]
    return spark.createDataFrame(rows, "path string, kind string, offset long, size long")


def content(path: str, inner: str) -> bytes:
    """The bytes of one stream or blob."""
    with opened(path) as f:
        return Container(f).read(inner)
