"""Listing files as a data source: one partition per prefix, listed by tasks, as a table or as a stream.

Rows are arrival_id (the address as Spark's readers name the file), key (the path), size_bytes and arrived_at, files
without a byte included. Nobody opens a file, and the driver sees only the prefixes: the folders below the root, or
those of the option ``prefixes``. A task walks its prefix folder by folder and holds the entries of one folder.

The offset of the stream is a time and a key. A batch holds the files that were modified after its start and not
after its end, in the order of time and key; it ends ``settle`` seconds before now, so that files of one moment come
together. A file that turns up with an older time than that is found by the table, not by the stream.

This module is sent to workers as it is, so it imports nothing of the package.
"""

from __future__ import annotations

import fnmatch
import json
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "arrival_id string, key string, size_bytes bigint, arrived_at timestamp"
_SHAPE = pa.schema([("arrival_id", pa.string()), ("key", pa.string()), ("size_bytes", pa.int64()), ("arrived_at", pa.timestamp("us", "UTC"))])
_BATCH = 4096
#: Characters that stay as they are in the path of an address; those beyond ASCII do too.
_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~/:@!$&'()*+,;=")


@dataclass
class Prefix(InputPartition):
    path: str
    deep: bool
    after: tuple[int, str] | None = None
    upto: tuple[int, str] | None = None


def hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def address(scheme: str, path: str) -> tuple[str, str]:
    """arrival_id and key of a path, as ``_metadata.file_path`` and ``path`` of Spark's readers have them."""
    plain = "".join(c if c in _PLAIN or ord(c) > 0x9F and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in path)
    return (f"file:{plain}", f"file:{path}") if scheme == "file" else (f"{scheme}://{plain}", f"{scheme}://{path}")


def opened(root: str) -> tuple[str, fs.FileSystem, str]:
    """Scheme, file system and path of a root."""
    if "://" not in root and not root.startswith("file:"):
        return "file", fs.LocalFileSystem(), root
    scheme = root.split(":", 1)[0]
    if scheme == "file":
        return "file", fs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/")
    found, path = fs.FileSystem.from_uri(root)
    return scheme, found, path


def entries(held: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """What a folder holds, by name; nothing if it is not there or not a folder."""
    found = held.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((e for e in found if not hidden(e.base_name)), key=lambda e: e.base_name)


def millis(entry: fs.FileInfo) -> int:
    return (entry.mtime_ns or 0) // 1_000_000


class _Walk:
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.glob = options.get("glob", "*")
        self.prefixes = json.loads(options["prefixes"]) if "prefixes" in options else None

    def parts(self, after=None, upto=None) -> list[Prefix]:
        scheme, held, path = opened(self.root)
        if self.prefixes is not None:
            names = sorted({p.strip("/") for p in self.prefixes})
            # a prefix inside another one is walked with it
            names = [n for n in names if not any(n != o and (n + "/").startswith(o + "/" if o else "") for o in names)]
            return [Prefix(f"{path}/{n}" if n else path, True, after, upto) for n in names]
        folders = [e.path for e in entries(held, path) if e.type == fs.FileType.Directory]
        return [Prefix(path, False, after, upto), *[Prefix(f, True, after, upto) for f in folders]]

    def files(self, part: Prefix) -> Iterator[pa.RecordBatch]:
        scheme, held, _ = opened(self.root)
        todo, rows = [part.path], []
        while todo:
            for e in entries(held, todo.pop()):
                if e.type == fs.FileType.Directory:
                    if part.deep:
                        todo.append(e.path)
                elif e.type == fs.FileType.File and fnmatch.fnmatchcase(e.base_name, self.glob):
                    arrival_id, key = address(scheme, e.path)
                    at = (millis(e), key)
                    if (part.after is None or at > tuple(part.after)) and (part.upto is None or at <= tuple(part.upto)):
                        rows.append((arrival_id, key, e.size, at[0] * 1000))
            while len(rows) >= _BATCH:
                yield _batch(rows[:_BATCH])
                rows = rows[_BATCH:]
        if rows:
            yield _batch(sorted(rows, key=lambda r: (r[3], r[1])) if part.upto else rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SHAPE.types, strict=True)], schema=_SHAPE)


def _nothing(root: str) -> Prefix:
    return Prefix(root, False, (0, ""), (-1, ""))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.walk = _Walk(options)

    def partitions(self):
        return self.walk.parts() or [_nothing(self.walk.root)]

    def read(self, partition):
        yield from self.walk.files(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.walk = _Walk(options)
        self.settle = float(options.get("settle", "1"))

    def initialOffset(self):
        return {"time": -1, "key": ""}

    def latestOffset(self):
        # no name is greater than this one, so all files of that moment are in
        return {"time": int((time.time() - self.settle) * 1000), "key": "\U0010ffff"}

    def partitions(self, start, end):
        return self.walk.parts((start["time"], start["key"]), (end["time"], end["key"])) or [_nothing(self.walk.root)]

    def read(self, partition):
        yield from self.walk.files(partition)


class Listing(DataSource):
    """``spark.read.format("listing").option("glob", "*.csv").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _options(reader, root: str, glob: str, prefixes: list[str] | None):
    reader = reader.format("listing").option("glob", glob)
    if prefixes is not None:
        reader = reader.option("prefixes", json.dumps(prefixes))
    return reader.load(root)


def table(spark: SparkSession, root: str, glob: str = "*", prefixes: list[str] | None = None) -> DataFrame:
    """The files below a root whose name matches; with ``prefixes`` only those below them."""
    spark.dataSource.register(Listing)
    return _options(spark.read, root, glob, prefixes)


def stream(spark: SparkSession, root: str, glob: str = "*", prefixes: list[str] | None = None, settle: float = 1) -> DataFrame:
    """The same, as files come."""
    spark.dataSource.register(Listing)
    return _options(spark.readStream.option("settle", str(settle)), root, glob, prefixes)
