"""Files of any store, opened by whatever process reads them: byte ranges of local, remote and HTTP files."""

from __future__ import annotations

import glob
import io
import os
import re
import urllib.request
import uuid

from pyspark.sql import SparkSession

#: What is fetched with the first request of an HTTP file, and the least of any later one.
HEAD, STEP = 16 << 10, 256 << 10


class HttpFile(io.RawIOBase):
    """A file behind HTTP, read by byte ranges; its first bytes are kept."""

    def __init__(self, url: str, head: int = HEAD):
        self.url, self.at, self.buf, self.buf_at = url, 0, b"", 0
        self.size = None
        self.head = self._get(0, head)

    def _get(self, start: int, stop: int) -> bytes:
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{stop - 1}"})
        with urllib.request.urlopen(request) as answer:
            data = answer.read()
            said = re.search(r"/(\d+)$", answer.headers.get("Content-Range") or "")
            if answer.status == 200:  # the server sent the whole file
                self.size = len(data)
                return data[start:stop]
        if said:
            self.size = int(said[1])
        return data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to if whence == 0 else self.at + to if whence == 1 else self.size + to
        return self.at

    def read(self, n: int = -1) -> bytes:
        stop = self.size if n is None or n < 0 else self.at + n
        if self.size is not None:
            stop = min(stop, self.size)
        if stop <= self.at:
            return b""
        if stop <= len(self.head):
            out = self.head[self.at : stop]
        else:
            if not self.buf_at <= self.at or stop > self.buf_at + len(self.buf):
                most = max(stop, self.at + STEP)
                self.buf, self.buf_at = self._get(self.at, most if self.size is None else min(most, self.size)), self.at
            out = self.buf[self.at - self.buf_at : stop - self.buf_at]
        self.at += len(out)
        return out

    def readinto(self, b) -> int:
        data = self.read(len(b))
        b[: len(data)] = data
        return len(data)


def opened(path: str):
    """A seekable binary file: of a plain path, or of the URI of any store that this process reaches."""
    if re.match("https?://", path):
        return HttpFile(path)
    if "://" not in path or path.startswith("file:"):
        return open(local(path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def sized(path: str) -> list[tuple[str, int]]:
    """Files that a path, a pattern or a directory stands for, with their sizes."""
    if re.match("https?://", path):
        return [(path, HttpFile(path).size)]
    if "://" not in path or path.startswith("file:"):
        at = local(path)
        names = sorted(glob.glob(f"{at}/*") if os.path.isdir(at) else glob.glob(at))
        if not names:
            raise FileNotFoundError(path)
        return [(n, os.path.getsize(n)) for n in names if os.path.isfile(n)]
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File]
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    return [(scheme + x.path, x.size) for x in found]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store, so that every process means the same file."""
    if re.match("https?://", path):
        return path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that the cluster shares; where none is named, in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
