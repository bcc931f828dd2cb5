"""Files of a store as a Python data source: a batch lists all, a stream what has changed since the batch before.

Spark's own file listing passes over names that begin with a dot or an
underscore and stops at a file that it can't open; cameras write names such as
``_DSC0001.jpg``. Here every file is a row: what can't be read says why, junk
and hidden folders are pruned while walking. The driver walks only until there
are folders enough for the tasks; each task walks what is below its own.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from vitrine.functions.columns import JUNK_FOLDERS
from vitrine.sources.stores import Entry, Store, kind_of, opened, said

SCHEMA = "key string, size long, changed timestamp, error string"
#: Folders that the driver looks into at most to share a tree among tasks, and tasks.
LOOKED_INTO = 256
TASKS = 512
#: A stream leaves out what changed less than this many seconds ago: it may still be being written.
SETTLED_S = 5.0


def _kept(folder: str) -> bool:
    name = folder.rsplit("/", 1)[-1]
    return not name.startswith(".") and name not in JUNK_FOLDERS


@dataclass
class Wanted:
    """What filters leave: keys with a prefix, sizes in a range (they never keep a file without a size)."""

    prefix: str = ""
    least: int | None = None
    most: int | None = None

    def take(self, filter: Filter) -> bool:
        """Narrow by a filter, if it is one that files can be judged by."""
        column, value = getattr(filter, "attribute", None), getattr(filter, "value", None)
        if column == ("key",) and isinstance(filter, (StringStartsWith, EqualTo)) and (value.startswith(self.prefix) or self.prefix.startswith(value)):
            self.prefix = max(self.prefix, value, key=len)
            return isinstance(filter, StringStartsWith)
        if column == ("size",) and isinstance(value, int):
            if isinstance(filter, (GreaterThan, GreaterThanOrEqual)):
                least = value + isinstance(filter, GreaterThan)
                self.least = least if self.least is None else max(self.least, least)
                return True
            if isinstance(filter, (LessThan, LessThanOrEqual)):
                most = value - isinstance(filter, LessThan)
                self.most = most if self.most is None else min(self.most, most)
                return True
        return False

    def folder(self, key: str) -> bool:
        below = f"{key}/"
        return below.startswith(self.prefix) or self.prefix.startswith(below)

    def file(self, entry: Entry) -> bool:
        if not entry.key.startswith(self.prefix):
            return False
        if self.least is None and self.most is None:
            return True
        return entry.size is not None and (self.least is None or entry.size >= self.least) and (self.most is None or entry.size <= self.most)


@dataclass
class Folders(InputPartition):
    """Folders to walk, and folders of which files alone are meant."""

    deep: list[str]
    flat: list[str]


def _looked_into(store: Store, folder: str) -> list[Entry]:
    """A folder's entries; one that can't be read is an entry itself, which says why."""
    try:
        return list(store.entries(folder))
    except OSError as problem:
        return [Entry(f"{folder}/" if folder else "", error=said(problem))]


def shared(store: Store, wanted: Wanted) -> list[Folders]:
    """The tree as lists of folders, whole or with their files alone."""
    flat, deep = [], [""]
    while deep and len(flat) < LOOKED_INTO and len(deep) < TASKS:
        folder = deep.pop(0)
        flat.append(folder)
        deep += [e.key for e in _looked_into(store, folder) if e.is_folder and _kept(e.key) and wanted.folder(e.key)]
    tasks = max(1, min(TASKS, len(flat) + len(deep)))
    return [Folders(deep[i::tasks], flat[i::tasks]) for i in range(tasks)]


def walked(store: Store, part: Folders, wanted: Wanted) -> Iterator[Entry]:
    waiting = list(part.deep)
    for folder in part.flat:
        yield from (e for e in _looked_into(store, folder) if not e.is_folder and wanted.file(e))
    while waiting:
        for entry in _looked_into(store, waiting.pop()):
            if not entry.is_folder:
                if wanted.file(entry):
                    yield entry
            elif _kept(entry.key) and wanted.folder(entry.key):
                waiting.append(entry.key)


def _row(entry: Entry) -> tuple:
    from datetime import UTC, datetime

    return entry.key, entry.size, datetime.fromtimestamp(entry.changed / 1e9, UTC) if entry.changed else None, entry.error


class _Reader(DataSourceReader):
    def __init__(self, uri: str, kind: str) -> None:
        self.uri, self.kind, self.wanted = uri, kind, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if not self.wanted.take(one):
                yield one

    def partitions(self) -> Sequence[InputPartition]:
        return shared(opened(self.uri, self.kind), self.wanted)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for entry in walked(opened(self.uri, self.kind), partition, self.wanted):
            yield _row(entry)


@dataclass
class _Since(InputPartition):
    folders: Folders
    after: int
    until: int


class _StreamReader(DataSourceStreamReader):
    """Offsets are times, so the driver lists no files: tasks return those that changed in between."""

    def __init__(self, uri: str, kind: str, settled: float) -> None:
        self.uri, self.kind, self.settled = uri, kind, settled

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settled * 1e9)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Since(part, start["until"], end["until"]) for part in shared(opened(self.uri, self.kind), Wanted())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for entry in walked(opened(self.uri, self.kind), partition.folders, Wanted()):
            # what can't be read has no time: it comes again with every batch, and the log knows it
            if entry.error is not None or partition.after < entry.changed <= partition.until:
                yield _row(entry)


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(uri)``; ``kind`` is the import path of what opens the URI."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["kind"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.options["kind"], float(self.options.get("settled", SETTLED_S)))


def _kind(spark: SparkSession, uri: str) -> str:
    kind = kind_of(uri)
    if kind is None:
        raise ValueError(f"no kind of store is registered for {uri}")
    spark.dataSource.register(FileListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return kind


def listed(spark: SparkSession, uri: str) -> DataFrame:
    """``key``, ``size`` (null if the file can't be read), ``changed`` and ``error`` of every file below a folder or prefix."""
    return spark.read.format("file_listing").option("kind", _kind(spark, uri)).load(uri)


def listed_stream(spark: SparkSession, uri: str, settled: float = SETTLED_S) -> DataFrame:
    """The same as a stream: files as they come or change. Clocks of store and driver may differ by ``settled`` seconds at most."""
    return spark.readStream.format("file_listing").option("kind", _kind(spark, uri)).option("settled", str(settled)).load(uri)
