"""WARC archives: a writer, and a reader that splits them.

Archives hold one gzip member per record. The reader cuts every archive into
byte ranges; a task scans its range for gzip magic, takes a candidate for a
member only if it decodes to a WARC header, and owns the records that start
inside its range, reading past the range's end to finish the last one. Between
records it goes on from where a member ended; where that isn't a member it scans
on, so damage costs the damaged records alone.

``write_records`` marks all but one of the records of equal payloads (of at
least ``min_revisit`` bytes) as revisits of the one with the largest id.

Defined cases: a null payload is an empty one; a null URL leaves its header out;
control characters in URLs are percent-encoded; of several rows with the same
id and payload each is a record of its own (all responses, if the id is the
largest); a null id is never referred to; an empty table gives no archive and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import arrow_schema, saved, shared_dir, tidy
from tracklake.sources.files import qualified

MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
MOST_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str, mode: str):
    """A file of any store that the workers reach by its URI."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, mode)
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "rb" else store.open_output_stream(inner)


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """An uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gz(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parsed(raw: bytes) -> dict:
    """A record's row; the payload's digest is computed from what was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is shorter than its length")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "revisit":
        size, body = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]), None
    else:
        size, body = len(payload), payload
        if (got := hashlib.sha1(payload).hexdigest()) != said:
            raise ValueError(f"payload digest {got} differs from {said}")
    at = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": at("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": at("X-Refers-To-Page"), "payload_digest": said, "payload_bytes": size, "payload": body}


class Window:
    """A file's bytes from any place, read in steps and forgotten behind."""

    def __init__(self, f, step: int = 1 << 20):
        self.f, self.step, self.at, self.buf = f, step, 0, b""

    def more(self) -> bool:
        self.f.seek(self.at + len(self.buf))
        got = self.f.read(self.step)
        self.buf += got
        return bool(got)

    def move(self, to: int) -> None:
        if self.at <= to <= self.at + len(self.buf):
            self.buf = self.buf[to - self.at :]
        else:
            self.buf = b""
        self.at = to


def member(w: Window, at: int) -> tuple[bytes, int] | None:
    """What the member at ``at`` decodes to and where it ends; None if there is no WARC record."""
    w.move(at)
    while len(w.buf) < 64 and w.more():
        pass
    if not w.buf.startswith(MAGIC):
        return None
    d, out, used, checked = zlib.decompressobj(31), [], 0, False
    try:
        while not d.eof:
            chunk = w.buf[used : used + w.step]
            if not chunk:
                if not w.more():
                    return None
                continue
            out.append(d.decompress(chunk))
            used += len(chunk)
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(out), at + used - len(d.unused_data)) if checked else None


def records_of(f, start: int, end: int):
    """Raw records that start in ``[start, end)``."""
    w, at = Window(f), start
    while at < end:
        got = member(w, at)
        if got:
            raw, at = got
            yield raw
            continue
        w.move(at + 1)
        while (k := w.buf.find(MAGIC)) < 0:
            if w.at >= end:
                return
            w.move(max(w.at, w.at + len(w.buf) - 2))
            if not w.more():
                return
        at = w.at + k


def write_records(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, level: int = 6, file_bytes: int = 256 << 20) -> DataFrame:
    """Write archives below ``to``; returns ``(path, bytes, n_records)`` of those that count.

    A task that runs again writes files of other names, and only the successful
    one's are returned. Duplicates are found by digest: one partial aggregate,
    and a join that Spark can split where one payload is very common.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    best = p.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("best"))
    p = p.join(best, "digest", "left")

    def run(batches):
        import pyarrow as pa

        out, path, size, count = None, "", 0, 0
        done = []
        for b in batches:
            for page_id, url, html, digest, best_id in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "best"))):
                if out is None:
                    path, size, count = f"{to}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = opened(path, "wb")
                again = best_id is not None and best_id != page_id
                data = gz(record(page_id, url, html.encode(), digest, best_id, again), level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "bytes", "n_records"])

    return p.mapInArrow(tidy(run), "path string, bytes long, n_records long")


def read_records(manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``manifest`` (``path``, ``bytes``), by byte ranges of ``split_bytes``."""
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    ranges = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # a range is a small row that stands for much work, so the number of tasks is given: left to itself, Spark would join all ranges into one
    tasks = min(MOST_TASKS, ranges.count())
    ranges = ranges.repartition(max(1, tasks), "path", "start")

    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                rows, held = [], 0
                with opened(path, "rb") as f:
                    for raw in records_of(f, start, start + split_bytes):
                        row = parsed(raw)
                        rows.append({k: row[k] for k in arrow.names})
                        held += len(raw)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ranges.mapInArrow(tidy(run), schema)


def round_trip(pages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, then read them back."""
    spark = pages.sparkSession
    to = qualified(spark, shared_dir(spark, "warc"))  # a path without a scheme is one of the default store, not of a worker's disk
    # Spark itself makes the folder, whatever store it is in
    spark.createDataFrame([], "x int").write.parquet(f"{to}/_made")
    manifest = saved(write_records(pages, to), "warc-manifest")
    return read_records(manifest, split_bytes, payloads=False)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE strlen(h) >= 1000 GROUP BY 1)
SELECT page_id, strlen(h) AS payload_bytes, payload_digest, CASE WHEN best IS NOT NULL AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN b USING (payload_digest)
"""
