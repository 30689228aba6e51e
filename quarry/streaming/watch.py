"""A streaming source of what changes below watched folders: files that are created, changed and deleted.

An offset is the number of a listing. Whenever Spark asks for the latest one, the folders are listed; if anything differs
from the last listing, the new one is stored beside it, cut into parts by a hash of the path, and gets the next number. A
batch compares two stored listings, a part to a task, so it is the same however often it is run, and a restart goes on
from the listings that its checkpoint names. As listings are compared, nothing is lost when very many files change at
once or while the stream is down. Listings before a committed one are deleted.

    spark.dataSource.register(watch.WatchSource)
    spark.readStream.format("watch").option("state", "hdfs:///state").load("hdfs:///library;hdfs:///inbox")

Hidden and skipped folders and files of other than the supported extensions are passed over. A folder that can't be read
is an error, not a deletion of its files; one that is gone is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.operators.library import SKIP_DIRS, SUPPORTED

SCHEMA = "path string, file_name string, size long, mtime long, change string"
PARTS = 16


@dataclass
class WatchPartition(InputPartition):
    start: int
    end: int
    part: int


def _wanted(path: str) -> bool:
    *folders, name = path.split("/")
    return not name.startswith(".") and name.rpartition(".")[2].lower() in SUPPORTED and "." in name[1:] and not any(f.startswith(".") or f in SKIP_DIRS for f in folders)


def listing(roots: list[str]) -> dict[str, tuple[int, int]]:
    """Size and modification time (epoch milliseconds) of all files wanted below the roots."""
    out = {}
    for root in roots:
        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        base = base.rstrip("/")
        for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            if f.type == fs.FileType.File and _wanted(f.path[len(base) + 1 :]):
                out[f"{root.rstrip('/')}/{f.path[len(base) + 1 :]}"] = (f.size, int(f.mtime_ns // 1_000_000))
    return out


class Listings:
    """Numbered listings in a folder; number 0 is the empty one."""

    def __init__(self, folder: str, parts: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.parts = parts

    def numbers(self) -> list[int]:
        names = [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if f.type == fs.FileType.Directory]
        return sorted(int(n) for n in names if n.isdigit())

    def part_of(self, path: str) -> int:
        return zlib.crc32(path.encode()) % self.parts

    def read(self, number: int, part: int) -> dict[str, tuple[int, int]]:
        if number == 0:
            return {}
        t = pq.read_table(f"{self.root}/{number}/{part}.parquet", filesystem=self.fs)
        return {p: (s, m) for p, s, m in zip(*(t.column(c).to_pylist() for c in ("path", "size", "mtime")))}

    def whole(self, number: int) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        for part in range(self.parts) if number else ():
            out |= self.read(number, part)
        return out

    def write(self, number: int, files: dict[str, tuple[int, int]]) -> None:
        """The folder gets its number when it is complete."""
        made = f"{self.root}/.new-{number}"
        if self.fs.get_file_info(made).type != fs.FileType.NotFound:
            self.fs.delete_dir(made)
        self.fs.create_dir(made, recursive=True)
        parts: list[list[tuple]] = [[] for _ in range(self.parts)]
        for path, (size, mtime) in files.items():
            parts[self.part_of(path)].append((path, size, mtime))
        for n, rows in enumerate(parts):
            cols = list(zip(*rows)) or [(), (), ()]
            table = pa.table({"path": pa.array(cols[0], pa.string()), "size": pa.array(cols[1], pa.int64()), "mtime": pa.array(cols[2], pa.int64())})
            pq.write_table(table, f"{made}/{n}.parquet", filesystem=self.fs)
        self.fs.move(made, f"{self.root}/{number}")

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.fs.delete_dir(f"{self.root}/{n}")


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options["path"].split(";") if r]
        self.state = Listings(options["state"], int(options.get("parts", PARTS)))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self.state.numbers(), default=0)
        now = listing(self.roots)
        if now != self.state.whole(last):
            last += 1
            self.state.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [WatchPartition(start["listing"], end["listing"], n) for n in range(self.state.parts)] if start != end else []

    def read(self, partition: WatchPartition) -> Iterator[tuple]:
        old, new = self.state.read(partition.start, partition.part), self.state.read(partition.end, partition.part)
        for path, (size, mtime) in new.items():
            if old.get(path) != (size, mtime):
                yield path, path.rpartition("/")[2], size, mtime, "changed" if path in old else "created"
        for path, (size, mtime) in old.items():
            if path not in new:
                yield path, path.rpartition("/")[2], size, mtime, "deleted"

    def commit(self, end: dict) -> None:
        self.state.forget(end["listing"])


class WatchSource(DataSource):
    """Format ``watch``: the folders are the path, the listings' folder the option ``state``."""

    @classmethod
    def name(cls) -> str:
        return "watch"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WatchReader:  # noqa: ANN001
        return WatchReader(self.options)
