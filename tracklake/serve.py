"""What leaves the engine for people and programs: down-sampled values over HTTP, an SVG chart, dense arrays."""

from __future__ import annotations

import json
import struct
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from tracklake.api import TrackFile
from tracklake.operators import resample

MOST_BINS = 1000


def header_bytes(file: TrackFile) -> bytes:
    """Names of the chromosomes as JSON."""
    return json.dumps(file.chrom_names).encode()


def bins_bytes(file: TrackFile, chrom: str, start: int, end: int) -> bytes:
    """Start, step and number of bins as little-endian 32-bit numbers, then the bins' stored means as floats; at most ``MOST_BINS``."""
    step = max(1, -(-(end - start) // MOST_BINS))
    regions = file.track.genome.sparkSession.createDataFrame([(0, chrom, start, end)] if start < end else [], "region_id long, chrom string, begin long, end long")
    rows = resample.server_bins(regions, file.track.runs, MOST_BINS, file.track.tile).orderBy("bin").collect()
    return struct.pack("<III", start, step, len(rows)) + struct.pack(f"<{len(rows)}f", *(r["mean"] for r in rows))


def server(file: TrackFile, host: str = "127.0.0.1", port: int = 60000) -> ThreadingHTTPServer:
    """``?class=header``, or ``?class=data&chr=..&start=..&end=..``; call ``serve_forever`` on what is returned."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = {k: v[-1] for k, v in parse_qs(urlparse(self.path).query).items()}
            try:
                kind, body = ("application/json", header_bytes(file)) if asked.get("class") == "header" else ("application/octet-stream", bins_bytes(file, asked["chr"], int(asked.get("start", 0)), int(asked.get("end", 0))))
            except (KeyError, ValueError) as e:
                self.send_error(400, str(e))
                return
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def area_svg(file: TrackFile, region: str, bins: int = 256, width: int = 1440, height: int = 768) -> str:
    """An area chart of one region's ``bins`` means."""
    rows = resample.plot_bins(file.regions(region), file.track.runs, bins, file.track.tile).orderBy("bin").collect()
    left, top, right, bottom = width // 10, height // 20, width - 10, height - height // 10
    x0, x1 = (rows[0]["x"], rows[-1]["x"]) if rows else (0, 0)
    most = max((r["y"] for r in rows), default=0) or 1
    place = lambda x, y: f"{left + (right - left) * (x - x0) / max(x1 - x0, 1):.1f},{bottom - (bottom - top) * y / most:.1f}"
    line = " ".join(place(r["x"], r["y"]) for r in rows)
    area = f"{left},{bottom} {line} {right},{bottom}"
    text = lambda x, y, s, anchor: f'<text x="{x}" y="{y}" text-anchor="{anchor}" font-family="sans-serif" font-size="14">{escape(str(s))}</text>'
    return "\n".join([
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">',
        text(width // 2, top - 8, f"{region} ({x0}-{x1})", "middle"),
        f'<polygon points="{area}" fill="#ff0000" fill-opacity="0.2"/>',
        f'<polyline points="{line}" fill="none" stroke="#ff0000"/>',
        f'<path d="M{left},{top} V{bottom} H{right}" fill="none" stroke="#000000"/>',
        text(left - 6, bottom, 0, "end"), text(left - 6, top + 6, f"{most:g}", "end"), text(left, bottom + 20, x0, "middle"), text(right, bottom + 20, x1, "end"),
        "</svg>",
    ])


def export_dense(file: TrackFile, path: str, spec=None, mode: str = "errorifexists") -> None:
    """One Parquet folder for each chromosome with a row per position, in order: what array stores hold."""
    rows = file.values(spec).select("chrom", "track", "pos", "value")
    rows.repartitionByRange("chrom", "track", "pos").sortWithinPartitions("chrom", "track", "pos").write.mode(mode).partitionBy("chrom").parquet(path)


def frames(path: str) -> list[tuple]:
    """Row groups of a saved track as an index: ``(file, group, chrom and begin at most and at least, rows)``, for those who seek by themselves."""
    import pyarrow.parquet as pq

    from tracklake.sources.files import local

    out = []
    for part in pq.ParquetDataset(local(path) + "/runs").files:
        meta = pq.ParquetFile(part).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}
            edge = lambda n, side: getattr(stats[n], side) if stats.get(n) is not None and stats[n].has_min_max else None
            out.append((part, g, edge("chrom", "min"), edge("begin", "min"), edge("chrom", "max"), edge("end", "max"), meta.row_group(g).num_rows))
    return sorted(out, key=lambda r: (r[2] or "", r[3] or 0))


def index_lines(file: TrackFile):
    """The sum index as text rows ``(chrom, begin, end, Sum(x))`` in the genome's order."""
    if file.track.index is None:
        raise ValueError("the track has no index")
    i = file.track.index.join(F.broadcast(file.track.genome.select("chrom", "chrom_id")), "chrom")
    return i.orderBy("chrom_id", "begin").select("chrom", "begin", "end", F.format_string("Sum(%.5f)", "sum").alias("sum"))
