"""Listing and reading of whole files, as Spark jobs that no name rule leaves anything out of."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import running_total
from ..storage import stage

#: bytes of files that a partition reads, and of contents that a batch holds, about
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: bytes that opening a file counts for
OPEN_BYTES = 1 << 18
#: entries after which a listing task leaves the folders that it has not seen to other tasks
LISTED = 10_000
_ENTRIES = pa.schema([("root", pa.string()), ("path", pa.string()), ("shown", pa.string()),
                      ("size", pa.int64()), ("folder", pa.bool_())])
ENTRIES = "root string, path string, shown string, size long, folder boolean"


def open_root(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what a URI puts before paths."""
    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:"), ""
    system, path = fs.FileSystem.from_uri(root)
    local = isinstance(system, fs.LocalFileSystem)
    return system, path, "" if local else root[: root.index(path.lstrip("/"))].rstrip("/") + "/"


class _Root:
    """A folder, file or glob, on the file system that its path names."""

    def __init__(self, root: str) -> None:
        self.root = root
        self.system, path, self.prefix = open_root(root)
        self.wanted = (path.rstrip("/") or "/").split("/")
        fixed = (i for i, part in enumerate(self.wanted) if any(c in part for c in "*?["))
        self.fixed = next(fixed, len(self.wanted))
        self.base = "/".join(self.wanted[: self.fixed]) or "/"

    def fits(self, path: str) -> bool:
        parts = path.split("/")
        return self.fixed == len(self.wanted) or (
            len(parts) >= len(self.wanted) and all(map(fnmatchcase, parts, self.wanted)))

    def entry(self, info: fs.FileInfo) -> dict:
        shown = self.prefix + (info.path.lstrip("/") if self.prefix else info.path)
        return {"root": self.root, "path": info.path, "shown": shown, "size": info.size or 0,
                "folder": info.type == fs.FileType.Directory}

    def start(self) -> dict:
        info = self.system.get_file_info(self.base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        return self.entry(info)


def _listed(suffix: str, limit: int):
    """Folders to the files below them, and to folders that are left for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[str, _Root] = {}
        for batch in batches:
            for row in batch.to_pylist():
                root = roots.setdefault(row["root"], _Root(row["root"]))
                found, ahead, seen = [], deque(), 0
                if row["folder"]:
                    ahead.append(row["path"])
                elif row["path"].endswith(suffix) and root.fits(row["path"]):
                    found.append(row)
                while ahead and seen < limit:
                    infos = root.system.get_file_info(fs.FileSelector(ahead.popleft()))
                    seen += len(infos) + 1
                    for info in infos:
                        if info.type == fs.FileType.Directory:
                            ahead.append(info.path)
                        elif (info.type == fs.FileType.File and info.path.endswith(suffix)
                              and root.fits(info.path)):
                            found.append(root.entry(info))
                found += [row | {"path": path, "folder": True} for path in ahead]
                for a in range(0, len(found), LISTED):
                    yield pa.RecordBatch.from_pylist(found[a : a + LISTED], _ENTRIES)

    return run


def list_files(
    spark: SparkSession, roots: list[str], suffix: str = "", limit: int = LISTED
) -> DataFrame:
    """``root, path, shown, size`` of every file below folders, files or globs, once each.

    Every round is a job over the folders known so far. A task walks its folder until it has
    met ``limit`` entries, so a small tree takes one round and a large one is spread after the
    first; the driver only learns whether folders are left. A single folder is one listing.
    """
    rows = spark.createDataFrame([_Root(root).start() for root in dict.fromkeys(roots)], ENTRIES)
    rounds = []
    while True:
        listed = stage(
            rows.repartition("root", "path").mapInArrow(_listed(suffix, limit), ENTRIES), "listing")
        rounds.append(listed.where(~F.col("folder")))
        rows = listed.where("folder")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds).dropDuplicates(["shown"]).drop("folder")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    systems: dict[str, fs.FileSystem] = {}
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["root"] not in systems:
                systems[row["root"]] = open_root(row["root"])[0]
            with systems[row["root"]].open_input_stream(row["path"], compression=None) as stream:
                content = stream.read()
            rows.append({"path": row["shown"], "content": content})
            held += len(content)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def read_files(files: DataFrame) -> DataFrame:
    """``path, content`` of listed files, in partitions of about equal bytes.

    A running total of sizes cuts the list, which is the only thing that moves.
    """
    weighed = files.withColumn("_bytes", F.col("size") + OPEN_BYTES)
    placed = running_total(weighed, ["shown"], "_bytes", "_ahead")
    total = placed.agg(F.max(F.col("_ahead") + F.col("_bytes"))).first()[0] or 0
    part = F.expr(f"cast(_ahead div {PARTITION_BYTES} as int)")
    dealt = placed.repartitionById(total // PARTITION_BYTES + 1, part)
    return dealt.select("root", "path", "shown").mapInArrow(_read, "path string, content binary")
