"""Files on storage that all executors share: local paths, file://, or what pyarrow can open."""

from __future__ import annotations

from typing import Any


def filesystem(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def create(path: str) -> Any:
    """A stream to write; folders above are made."""
    where, name = filesystem(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    return where.open_output_stream(name, compression=None)


def reader(path: str) -> Any:
    """A file to read by ranges."""
    where, name = filesystem(path)
    return where.open_input_file(name)
