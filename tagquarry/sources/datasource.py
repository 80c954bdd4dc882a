"""A data source for files of HTML: `spark.read.format("tagquarry")`, in batches and as a stream, and a sink of one file a document.

Reading gives (path, content), a row a file; of tar archives (plain, gzip, bzip2, xz, zstandard)
a row a member, as archive!member. A partition holds files of `partition_bytes` at most, or one
larger file; members are read one after the other. Conditions on paths are pushed down, so other
files aren't opened. A stream takes files in the order of their times of change, then names; its
offset is the last one, so a file is read once.

Writing takes rows (name, text) or (name, content) and makes a file `name` below the path. Tasks
write into a folder of their own; only when all have ended are files moved into place, so a task
that fails or is tried twice leaves none. Paths are local, or what pyarrow can open.
"""

from __future__ import annotations

import fnmatch
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage

ARCHIVES = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".tar.zst")
#: Where tasks write before their files are moved.
PENDING = "_pending"


def opened(path: str) -> tuple[Any, str]:
    """A file system and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True, order=True)
class Found:
    changed: int
    path: str
    size: int


def listed(path: str, glob: str) -> list[Found]:
    """Files below a path, or the one that it names, in the order of their changes."""
    from pyarrow import fs

    where, root = opened(path)
    info = where.get_file_info(root)
    every = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(Found(i.mtime_ns or 0, i.path, i.size or 0) for i in every if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob) and f"/{PENDING}" not in i.path and not i.base_name.startswith(("_", ".")))


@dataclass
class Files(InputPartition):
    files: list[str]


def dealt(found: list[Found], most: int) -> list[Files]:
    out: list[Files] = []
    size = 0
    for f in sorted(found, key=lambda f: f.path):
        if not out or size + f.size > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f.path)
        size += f.size
    return out


def members(stream: Any, path: str) -> Iterator[tuple[str, bytes]]:
    if path.endswith(".zst"):
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(stream)
    with tarfile.open(fileobj=stream, mode="r|" if path.endswith(".zst") else "r|*") as archive:
        for member in archive:
            if member.isfile():
                yield f"{path}!{member.name}", archive.extractfile(member).read()


class Reading:
    """What batches and streams share: options, and the rows of a partition."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.glob, self.most = options["path"], options.get("glob", "*"), int(options.get("partition_bytes", 64 << 20))
        self.wanted: list[Filter] = []

    def fits(self, path: str, whole: bool) -> bool:
        """Whether a row of this path, or any row of its archive, can be wanted."""
        for f in self.wanted:
            value = str(f.value)
            if isinstance(f, EqualTo) and not (path == value if whole else value.startswith(path + "!")):
                return False
            if isinstance(f, StringStartsWith) and not (path.startswith(value) or not whole and value.startswith(path)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        where, _ = opened(self.path)
        for path in partition.files:
            archive = path.endswith(ARCHIVES)
            if not self.fits(path, not archive):
                continue
            with where.open_input_stream(path, compression=None) as stream:
                if archive:
                    yield from ((name, data) for name, data in members(stream, path) if self.fits(name, True))
                else:
                    yield path, stream.read()


class BatchReader(Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        return dealt([f for f in listed(self.path, self.glob) if self.fits(f.path, not f.path.endswith(ARCHIVES))], self.most) or [Files([])]


class StreamReader(Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.path, self.glob)
        return {"changed": found[-1].changed, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return dealt([f for f in listed(self.path, self.glob) if low < (f.changed, f.path) <= high], self.most)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        if len(names) != 2:
            raise ValueError("rows of a name and a text, or bytes")
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Written:
        where, root = opened(self.path)
        folder = f"{root}/{PENDING}-{self.job}/{uuid.uuid4().hex}"
        names = []
        for name, value in iterator:
            parts = name.split("/")
            if not name or ".." in parts or "" in parts:
                raise ValueError(f"no name of a file below a folder: {name!r}")
            where.create_dir("/".join([folder, *parts[:-1]]), recursive=True)
            with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(value if isinstance(value, (bytes, bytearray)) else (value or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = opened(self.path)
        for m in messages:
            for name in m.names if m else []:
                where.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                where.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        where, root = opened(self.path)
        pending = f"{root}/{PENDING}-{self.job}"
        if where.get_file_info(pending).type == fs.FileType.Directory:
            where.delete_dir(pending)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagquarry"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: Any) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema: Any) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
