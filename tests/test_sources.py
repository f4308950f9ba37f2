"""Binary sources against files written here, and what leaves the engine."""

import json
import random
import struct
import threading
import urllib.request
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from tracklake import api, create, serve
from tracklake.operators import intervals
from tracklake.sources import alignment, bigwig, container, files, text

# --- alignments -------------------------------------------------------------------------

NAMES, SIZES = ["a", "b", "c"], [200_000, 90_000, 10]
ACROSS = {"M": 0, "I": 1, "D": 2, "N": 3, "S": 4}


def reads(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ref = rng.choice([0, 0, 1])
        ops = [("S", 2), ("M", rng.randint(5, 60)), ("D", rng.randint(1, 9)), ("M", 4)] if i % 3 else [("M", rng.randint(1, 90))]
        out.append((ref, rng.randrange(SIZES[ref] - 200), rng.choice([0, 20, 60]), rng.choice([0, 16, 99]), ops, f"read{i}" + "x" * rng.randint(0, 40)))
    return sorted(out) + [(-1, -1, 0, 4, [], "lost")]


def record(ref, pos, mapq, flag, ops, name):
    word = name.encode() + b"\0"
    length = sum(n for o, n in ops if o in "MIS")
    cigar = b"".join(struct.pack("<I", n << 4 | ACROSS[o]) for o, n in ops)
    seq = bytes([0x12] * ((length + 1) // 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(word), mapq, 0, len(ops), flag, length, -1, -1, 0) + word + cigar + seq + b"\xff" * length
    return struct.pack("<i", len(body)) + body


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(raw) + 25)
    return head + raw + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, rows, step):
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(NAMES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in zip(NAMES, SIZES))
    raw, places = [record(*r) for r in rows], [len(head)]
    for r in raw:
        places.append(places[-1] + len(r))
    data, out, starts = head + b"".join(raw), b"", []
    for at in range(0, len(data), step):
        starts.append(len(out))
        out += block(data[at : at + step])
    path.write_bytes(out + block(b""))
    return [starts[p // step] << 16 | p % step if p < len(data) else len(out) << 16 for p in places]


def number(b, e):
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if b >> shift == (e - 1) >> shift:
            return first + (b >> shift)
    return 0


def write_bai(path, rows, at):
    out = b"BAI\1" + struct.pack("<i", len(NAMES))
    for ref, size in enumerate(SIZES):
        bins, line = {}, [0] * ((size >> 14) + 1)
        for i, r in enumerate(rows):
            if r[0] == ref:
                end = r[1] + sum(n for o, n in r[4] if o in "MDN")
                bins.setdefault(number(r[1], end), []).append((at[i], at[i + 1]))
                for w in range(r[1] >> 14, (end - 1 >> 14) + 1):
                    line[w] = line[w] or at[i]
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *x) for x in v) for k, v in bins.items())
        out += struct.pack("<i", len(line)) + struct.pack(f"<{len(line)}Q", *line)
    path.write_bytes(out)


def row(r):
    ref, pos, mapq, flag, ops, name = r
    return (NAMES[ref] if ref >= 0 else None, pos, pos + sum(n for o, n in ops if o in "MDN"), mapq, flag, "".join(f"{n}{o}" for o, n in ops) or "*", name)


def same(df, rows):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr) == sorted(map(row, rows), key=repr)


@pytest.mark.parametrize("step,split", [(700, 900), (60_000, 5_000), (150, 1 << 20)])
def test_bam_is_split_anywhere(spark, tmp_path, step, split):
    rows = reads(600)
    write_bam(tmp_path / "x.bam", rows, step)
    df = alignment.bam(spark, str(tmp_path / "x.bam"), split=split)
    assert same(df, rows)
    assert df.where("name = 'lost'").first()["sequence"] == "*" and df.where("cigar LIKE '2S%'").first()["sequence"].startswith("ACAC")
    assert [tuple(r) for r in alignment.genome_of(spark, str(tmp_path / "x.bam")).collect()] == [(n, s, i) for i, (n, s) in enumerate(zip(NAMES, SIZES))]


def test_bam_regions_with_and_without_an_index(spark, tmp_path):
    rows = reads(400, 2)
    at = write_bam(tmp_path / "x.bam", rows, 900)
    wanted = [r for r in rows if r[0] == 0 and r[1] < 60_000 and row(r)[2] > 20_000]
    assert same(alignment.bam(spark, str(tmp_path / "x.bam"), "a:20000-60000"), wanted)
    write_bai(tmp_path / "x.bam.bai", rows, at)
    assert same(alignment.bam(spark, str(tmp_path / "x.bam"), "a:20000-60000"), wanted)
    assert alignment.bam(spark, str(tmp_path / "x.bam"), "none:1-2").count() == alignment.bam(spark, str(tmp_path / "x.bam"), "c").count() == 0


def test_track_from_alignments(spark, tmp_path):
    rows = reads(300, 3)
    write_bam(tmp_path / "x.bam", rows, 2_000)
    lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{n}\tLN:{s}" for n, s in zip(NAMES, SIZES))]
    for r in rows:
        chrom, b, _, mapq, flag, cigar, name = row(r)
        lines.append("\t".join(map(str, (name, flag, chrom or "*", b + 1, mapq, cigar, "*", 0, 0, "*", "*"))))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    depth = np.zeros(SIZES[1], dtype=int)
    for r in rows:
        if r[0] == 1 and r[2] >= 60 and not r[3] & 16:
            depth[r[1] : row(r)[2]] += 1
    for name in ("x.bam", "x.sam"):
        made = create.create(spark, str(tmp_path / name), flags="~16")
        assert made["b"].tolist() == depth.tolist() and made.chrom_names == NAMES
    with pytest.raises(NotImplementedError):
        alignment.alignments(spark, "x.cram")
    (tmp_path / "y.bam").write_bytes(block(b"nothing of the kind"))
    with pytest.raises(Exception, match="not a BAM file"):
        alignment.bam(spark, str(tmp_path / "y.bam")).collect()


# --- BigWig ---------------------------------------------------------------------------------


def write_bigwig(path, chroms, sections, packed=True, order="<"):
    """``sections``: (chrom number, kind, step, span, rows of (begin, end, value))."""
    p = lambda k, *v: struct.pack(order + k, *v)
    key = max(len(n) for n, _ in chroms)
    names = p("IIIIQQ", 0x78CA8C91, 4, key, 8, len(chroms), 0) + p("BBH", 1, 0, len(chroms)) + b"".join(n.encode().ljust(key, b"\0") + p("II", i, s) for i, (n, s) in enumerate(chroms))
    data, leaves, at = b"", [], 64 + len(names)
    for c, kind, step, span, rows in sections:
        raw = p("IIIIIBBH", c, rows[0][0], rows[-1][1], step, span, kind, 0, len(rows))
        raw += b"".join(p("IIf", *r) if kind == 1 else p("If", r[0], r[2]) if kind == 2 else p("f", r[2]) for r in rows)
        raw = zlib.compress(raw) if packed else raw
        leaves.append((c, rows[0][0], c, rows[-1][1], at + len(data), len(raw)))
        data += raw
    tree, half = at + len(data), len(leaves) // 2
    root = tree + 48
    parts = [x for x in (leaves[:half], leaves[half:]) if x]
    inner, where, nodes = b"", root + 4 + 24 * len(parts), b""
    for part in parts:
        inner += p("IIIIQ", part[0][0], part[0][1], part[-1][2], part[-1][3], where + len(nodes))
        nodes += p("BBH", 1, 0, len(part)) + b"".join(p("IIIIQQ", *x) for x in part)
    index = p("IIQIIIIQII", 0x2468ACE0, 4, len(leaves), 0, 0, 9, 9, 0, 1, 0) + p("BBH", 0, 0, len(parts)) + inner + nodes
    head = p("IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, tree, 0, 0, 0, 0, 32768 if packed else 0, 0)
    path.write_bytes(head + names + data + index)


BW = [(0, 1, 0, 0, [(5, 9, 0.5), (9, 20, 2.0)]), (0, 2, 0, 3, [(30, 33, 1.25), (40, 43, 7.0)]), (1, 3, 10, 4, [(0, 4, 1.0), (10, 14, 0.0), (20, 24, -2.5)]), (1, 1, 0, 0, [(60, 70, 3.0)])]


@pytest.mark.parametrize("packed,order", [(True, "<"), (False, ">")])
def test_bigwig(spark, tmp_path, packed, order):
    path = str(tmp_path / "x.bw")
    write_bigwig(tmp_path / "x.bw", [("one", 100), ("two", 70)], BW, packed, order)
    want = [(["one", "two"][c], *r) for c, _, _, _, rows in BW for r in rows]
    assert sorted(tuple(r) for r in bigwig.bigwig(spark, path, split=50).collect()) == sorted(want)
    assert sorted(tuple(r) for r in bigwig.bigwig(spark, path, "two:12-61").collect()) == sorted(x for x in want if x[0] == "two" and x[1] < 61 and x[2] > 12)
    made = create.create(spark, path, denominator="auto")
    assert made.denominator == 100 and made.chroms == [("one", 100), ("two", 70)]
    dense = np.zeros(70)
    for c, b, e, v in want:
        if c == "two":
            dense[b:e] = v
    assert made["two"].tolist() == dense.tolist()
    assert not create.sparse_pays(spark, path, made.track.genome)


# --- containers -----------------------------------------------------------------------------


class Writer:
    """A container with streams in several frames; a directory's place is kept free before what it holds."""

    def __init__(self):
        self.data = bytearray(8)

    def keep(self):
        self.data += bytes(512)
        return len(self.data) - 512

    def frames(self, payloads, first=None):
        """Writes linked frames; returns where the first is and its size."""
        where = len(self.data)
        for i, p in enumerate(payloads):
            size = first if i == 0 and first else 16 + len(p)
            at = len(self.data)
            step, following = (size, 16 + len(payloads[i + 1])) if i + 1 < len(payloads) else (0, 0)
            self.data += struct.pack("<qQ", step, following) + p + bytes(size - 16 - len(p))
            assert len(self.data) == at + size
        return where, first or 16 + len(payloads[0])

    def directory(self, entries, at):
        """``entries`` of (name, kind, offset, size); what the first frame can't hold goes to the end of the file."""
        raw = b"".join(b"\1" + struct.pack("<BQQ", kind, offset - at, size) + name.encode() + b"\0" for name, kind, offset, size in entries)
        link = (len(self.data) - at, 16 + len(raw) - 496) if len(raw) > 496 else (0, 0)
        if len(raw) > 496:
            self.frames([raw[496:]])
        self.data[at : at + 512] = (struct.pack("<qQ", *link) + raw[:496]).ljust(512, b"\0")
        return at


def write_track(w, chroms, values, low, high, deflate, listed=None):
    """One track's directory; values beyond the dictionary go to the secondary table, in streams of two partitions a chromosome."""
    bits = (len(listed) if listed else high - low).bit_length() - 1
    place, second = w.keep(), w.keep()
    meta = {"chrom_list": [{"name": n, "size": s} for n, s in chroms], "dictionary": {"Dictionary": {"i2v_map": listed}} if listed else {"SimpleRange": {"low": low, "high": high}}, "denominator": {"Value": 4.0} if deflate else "One"}
    raw = json.dumps(meta).encode()
    header = w.frames([raw[:40], raw[40:]])
    table, runs, parts = b"", [], []
    for n, s in chroms:
        v, codes = values[n], []
        known = {x: i for i, x in enumerate(listed)} if listed else {x: x - low for x in range(low, high)}
        last = (1 << bits) - 1
        codes = [min(known.get(int(x), last), last) for x in v]
        table += np.packbits(np.array([[c >> b & 1 for b in range(bits)] for c in codes], dtype=np.uint8).reshape(-1), bitorder="little").tobytes() if bits else b""
        middle = s // 2
        for b, e in ((0, middle), (middle, s)):
            got, at = [], b
            while at < e:
                end = at + 1
                while end < e and v[end] == v[at] and end - at < 65_536:
                    end += 1
                if int(v[at]) not in known or known[int(v[at])] == last or not bits:
                    got.append(struct.pack("<IHi", at + 1, end - at - 1, int(v[at])))
                at = end
            parts.append((n, b, e))
            runs.append(got)
    primary = (len(w.data), len(table))
    w.data += table
    streams = []
    for i, got in enumerate(runs):
        if deflate:
            halves = [got[: len(got) // 2], got[len(got) // 2 :]]
            pack = lambda x: (lambda c: c.compress(b"".join(x)) + c.flush())(zlib.compressobj(5, zlib.DEFLATED, -15))
            payloads = [(b"\0" if k == 0 else b"") + struct.pack("<III", 0, 0, len(x)) + pack(x) for k, x in enumerate(halves)]
            payloads[0] += bytes(30)
        else:
            flat = b"".join(got)
            payloads = [flat[:7], flat[7:] + bytes(20)]
        streams.append((str(i), container.STREAM, *w.frames(payloads)))
    meta = w.frames([json.dumps({"format": "array", "record_format": "range", "partitions": parts, "compression": {"Deflate": 5} if deflate else "NoCompression"}).encode()])
    more = [(f"unused-{'x' * 60}-{i}", container.BLOB, primary[0], 1) for i in range(9)]
    inner = w.directory([(".metadata", container.STREAM, *meta), *more, *streams], second)
    w.directory([(".metadata", container.STREAM, *header), (".ptab", container.BLOB, *primary), (".stab", container.DIRECTORY, inner, 512)], place)
    return place


CHROMS = [("a", 1000), ("b", 77)]


@pytest.fixture()
def packed_tracks(tmp_path):
    rng = np.random.default_rng(4)
    values = [{n: np.repeat(rng.integers(-2, 40, s // 3 + 1), 3)[:s] for n, s in CHROMS} for _ in range(4)]
    w = Writer()
    root, group = w.keep(), w.keep()
    kinds = [(0, 8, True, None), (-2, 14, False, None), (0, 1, False, None), (0, 0, False, [5, 7, 0, 9])]
    at = [write_track(w, CHROMS, v, *k) for v, k in zip(values, kinds)]
    w.directory([("deep", container.DIRECTORY, at[3], 512)], group)
    w.directory([("first", container.DIRECTORY, at[0], 512), ("second", container.DIRECTORY, at[1], 512), ("sparse", container.DIRECTORY, at[2], 512), ("group", container.DIRECTORY, group, 512)], root)
    path = tmp_path / "tracks.bin"
    path.write_bytes(bytes(w.data))
    return str(path), dict(zip(["first", "second", "sparse", "group/deep"], values))


def test_containers(spark, packed_tracks):
    path, values = packed_tracks
    with files.opened(path) as f:
        c = container.Container(f)
        assert sorted(c.tracks()) == sorted(values)
        assert json.loads(c.read("group/deep/.metadata"))["dictionary"] == {"Dictionary": {"i2v_map": [5, 7, 0, 9]}}
        with pytest.raises(FileNotFoundError):
            c.read("group/none")
    assert {r["kind"] for r in container.dumped(spark, path).collect()} == {"stream", "directory", "blob"}
    dense = {(t, n): np.full(s, -99) for t in values for n, s in CHROMS}
    for r in container.container(spark, path, split=96).collect():
        dense[r["track"], r["chrom"]][r["begin"] : r["end"]] = r["value"]
    for t, v in values.items():
        for n, _ in CHROMS:
            assert dense[t, n].tolist() == v[n].tolist(), (t, n)
    got = container.container(spark, path, "first", "a:100-110").collect()
    assert min(r["begin"] for r in got) <= 100 and max(r["end"] for r in got) == 110
    one = create.from_container(spark, f"{path}:first")
    assert one.denominator == 4.0 and one["b"].tolist() == (values["first"]["b"] / 4).tolist() and one.chroms == CHROMS


# --- stores, exports ----------------------------------------------------------------------------


@pytest.fixture()
def web(tmp_path):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            data = (tmp_path / self.path.lstrip("/")).read_bytes()
            first, last = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
            part = data[first : last + 1]
            asked.append(len(part))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{first + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", asked
    s.shutdown()


def test_files_over_http(spark, tmp_path, web, packed_tracks):
    url, asked = web
    data = bytes(random.Random(5).randbytes(2_000_000))
    (tmp_path / "big").write_bytes(data)
    with files.opened(f"{url}/big") as f:
        for at, n in ((0, 10), (16_000, 1_000), (1_999_990, 50), (700_000, 300_000), (5, 5)):
            f.seek(at)
            assert f.read(n) == data[at : at + n]
        assert f.seek(-3, 2) == 1_999_997 and f.read() == data[-3:]
    assert sum(asked) < 1_500_000
    _, values = packed_tracks
    got = create.from_container(spark, f"{url}/tracks.bin#second")
    assert got["b"].tolist() == values["second"]["b"].tolist()


def test_server_chart_and_exports(spark, tmp_path):
    v = np.arange(3000) // 7 % 50
    t = api.TrackBuilder(spark).add_chroms([("c", 3000), ("d", 5)]).write_np_array("c", 0, v).build()
    raw = serve.bins_bytes(t, "c", 10, 2510)
    start, step, n = struct.unpack_from("<III", raw)
    assert (start, step, n) == (10, 3, 834)
    assert np.allclose(np.frombuffer(raw, "<f4", n, 12), [v[b : min(b + 3, 2510)].mean() for b in range(10, 2510, 3)])
    assert serve.bins_bytes(t, "c", 5, 5) == struct.pack("<III", 5, 1, 0)
    s = serve.server(t, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}/?class="
    assert json.loads(urllib.request.urlopen(at + "header").read()) == ["c", "d"]
    assert urllib.request.urlopen(at + "data&chr=c&start=10&end=2510").read() == raw
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(at + "data&start=1")
    s.shutdown()
    svg = serve.area_svg(t, "c:0-3000")
    assert svg.startswith("<svg") and svg.count("<poly") == 2
    serve.export_dense(t, str(tmp_path / "dense"))
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "dense")).where("chrom = 'c'").orderBy("pos").collect()] == v.tolist()
    t.with_index().save(str(tmp_path / "saved"))
    assert sum(f[6] for f in serve.frames(str(tmp_path / "saved"))) == t.track.runs.count()
    assert [tuple(r) for r in serve.index_lines(t.with_index()).collect()][0] == ("c", 0, 3000, f"Sum({v.sum():.5f})")
    with pytest.raises(ValueError):
        serve.index_lines(t)


def test_merging_files_and_dictionaries(spark, tmp_path):
    a, b = (api.TrackBuilder(spark).add_chroms([("c", 4)]).write_np_array("c", 0, np.array(x)).build() for x in ([1, 1, 2, 0], [0, 3, 3, 3]))
    both = create.merge_files({"x": a, "y": b})
    assert both.matrix("c").tolist() == [[1, 1, 2, 0], [0, 3, 3, 3]] and [m.tolist() for m in both.matrix([("c", 0, 2), ("c", 3, 4)])] == [[[1, 1], [0, 3]], [[0], [3]]]
    assert [tuple(r)[1:] for r in a.partitions(9).collect()] == [("c", 0, 4)]
    bits = api.TrackBuilder(spark).like(a).named("bits").generate_index().write_bits("c", 1, [True, False, 7]).build()
    assert bits.list_tracks() == ["bits"] and bits["c"].tolist() == [0, 1, 0, 1] and bits.track.index.count() == 1
    assert both.list_tracks() == ["x", "y"] and both.open_track("y")["c"].tolist() == [0, 3, 3, 3]
    with pytest.raises(ValueError):
        create.merge_files({"x": a, "z": api.TrackBuilder(spark).add_chroms([("c", 5)]).build()})
    (tmp_path / "d").write_text("3\n1\n")
    assert create.dictionary(spark, path=str(tmp_path / "d")) == {"values": [3, 1]} and create.dictionary(spark, "4-12") == {"low": 4, "high": 12}
    assert json.loads(create.dictionary_json(create.dictionary(spark, sparse=True))) == {"low": 0, "high": 1}
    with pytest.raises(ValueError):
        create.dictionary(spark, "0-9")
    with pytest.raises(ValueError):
        text.kind_of("x.unknown")


def test_overlays_and_as_of(spark):
    runs = lambda rows: spark.createDataFrame(rows, "chrom string, begin long, end long, value int")
    base, over = runs([("c", 0, 5, 1), ("c", 5, 20, 2)]), runs([("c", 3, 7, 9), ("c", 7, 8, 0), ("c", 12, 20, 4)])
    dense = [1] * 3 + [9] * 4 + [0] + [2] * 4 + [4] * 8
    for tile in (4, 100):
        got = [-1] * 20
        for r in intervals.coalesced(base, over, tile).collect():
            got[r["begin"] : r["end"]] = [r["value"]] * (r["end"] - r["begin"])
        assert got == dense
        points = spark.createDataFrame([("c", p) for p in (0, 3, 4, 11, 19, 40)] + [("d", 1)], "chrom string, pos long")
        found = {(r["chrom"], r["pos"]): r["value"] for r in intervals.last_before(points, over, tile).collect()}
        assert found == {("c", 0): None, ("c", 3): 9, ("c", 4): 9, ("c", 11): 0, ("c", 19): 4, ("c", 40): 4, ("d", 1): None}
