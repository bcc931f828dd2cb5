"""Where files are: folders that every executor mounts, and object stores; what else is registered.

A store lists one folder at a time and reads the first bytes of a file, so
tasks can share a tree among them and fetch no more than they need.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Protocol
from urllib.parse import unquote, urlparse


@dataclass(frozen=True)
class Entry:
    """What a folder holds: ``key`` is the path below the store's root, ``changed`` nanoseconds since 1970; ``error`` says why a file can't be read."""

    key: str
    is_folder: bool = False
    size: int | None = None
    changed: int = 0
    error: str | None = None


class Store(Protocol):
    def entries(self, folder: str) -> Iterator[Entry]:
        """What stands right in a folder (the root: empty); a folder that can't be read raises OSError."""

    def read(self, key: str, limit: int | None = None) -> bytes:
        """A file, or its first ``limit`` bytes and no more."""


def said(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


class MountedFolder:
    """A folder by its path, as ``file:`` URIs and plain paths name it. Links to folders aren't followed, so no file comes twice."""

    def __init__(self, uri: str) -> None:
        self.root = os.path.abspath(unquote(urlparse(uri).path) if uri.startswith("file:") else os.path.expanduser(uri))

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            for entry in found:
                key = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    yield Entry(key, True)
                elif not entry.is_dir():
                    try:
                        facts = entry.stat()
                        # a file that was moved here keeps its own time, but not that of the change
                        yield Entry(key, False, facts.st_size, max(facts.st_mtime_ns, facts.st_ctime_ns))
                    except OSError as problem:
                        yield Entry(key, False, error=said(problem))

    def read(self, key: str, limit: int | None = None) -> bytes:
        with open(os.path.join(self.root, key), "rb") as file:
            return file.read() if limit is None else file.read(limit)


class ObjectStore:
    """Keys below a prefix, through the file systems that Arrow knows (s3, gs, abfs, hdfs)."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(uri)
        self.root = root.rstrip("/")

    def entries(self, folder: str) -> Iterator[Entry]:
        from pyarrow import fs

        for found in self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"))):
            key = found.path[len(self.root) :].lstrip("/")
            if found.type == fs.FileType.Directory:
                yield Entry(key, True)
            else:
                yield Entry(key, False, found.size, found.mtime_ns or 0)

    def read(self, key: str, limit: int | None = None) -> bytes:
        with self.files.open_input_file(f"{self.root}/{key}") as file:
            return file.read() if limit is None else file.read_at(limit, 0)


#: Import paths of what opens a URI of a scheme; tasks import them, so they must be importable on executors.
KINDS = {"": f"{__name__}:MountedFolder", "file": f"{__name__}:MountedFolder", **dict.fromkeys(["s3", "gs", "gcs", "abfs", "abfss", "hdfs"], f"{__name__}:ObjectStore")}


def register(scheme: str, path: str) -> None:
    """URIs of a scheme are opened by ``module:name``, a callable that takes the URI and gives a ``Store``."""
    if ":" not in path:
        raise ValueError(f"module:name, not {path!r}")
    KINDS[scheme] = path


def kind_of(uri: str) -> str | None:
    """The import path for a URI, or None if its scheme is Spark's alone."""
    return KINDS.get(urlparse(uri).scheme if ":" in uri.split("/")[0] else "")


def opened(uri: str, path: str | None = None) -> Store:
    path = path or kind_of(uri)
    if path is None:
        raise ValueError(f"no kind of store is registered for {uri}")
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)(uri)
