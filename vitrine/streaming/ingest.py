"""Ingest as a stream of files: listed, fetched, encoded in batches and appended, each file once.

The stream carries listings; files are fetched by tasks of their own, which
work while the encoder's tasks do. The checkpoint remembers up to when changes
were seen; the log, joined before each write, keeps a file from being done
twice if a batch is run again. A log belongs to one model.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from vitrine.functions.columns import is_image, is_junk, item_id
from vitrine.functions.encoders import Encoder
from vitrine.operators.ingest import oversized, pending
from vitrine.sources.files import fetched
from vitrine.sources.listing import SETTLED_S, listed_stream
from vitrine.sources.state import StateTable

_OUT = "id string, key string, size_bytes long, status string, error string, elapsed_ms double, embedding array<float>, updated_at timestamp"
#: Files that an encoder gets at a time.
BATCH = 32
#: Files of a write to the log.
PER_WRITE = 100_000


def files_stream(spark: SparkSession, folder: str, settled: float = SETTLED_S) -> DataFrame:
    """A listing of files as they come or change."""
    return listed_stream(spark, folder, settled)


def keyed(files: DataFrame) -> DataFrame:
    """Images of a listing that can be read, by key; a file that changed twice is one."""
    key = F.col("key")
    rows = files.where(F.col("error").isNull() & is_image(key) & ~is_junk(key)).groupBy("key").agg(F.max_by("size", F.struct("changed", "size")).alias("size_bytes"))
    return rows.withColumn("id", item_id(F.col("key")))


def _encoded(encode, contents: list[bytes], dimensions: int) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each content. A batch that fails is tried again in halves, so one that is broken fails alone."""
    try:
        vectors = [[float(x) for x in v] for v in encode(contents)]
        if len(vectors) != len(contents) or any(len(v) != dimensions for v in vectors):
            raise ValueError(f"not {len(contents)} vectors of {dimensions} numbers")
        return [(v, None) for v in vectors]
    except Exception as problem:  # noqa: BLE001
        if len(contents) == 1:
            return [(None, f"encode: {type(problem).__name__}: {problem}"[:500])]
        half = len(contents) // 2
        return _encoded(encode, contents[:half], dimensions) + _encoded(encode, contents[half:], dimensions)


def encoded(files: DataFrame, encoder: Encoder, batch_size: int = BATCH) -> DataFrame:
    """A row of the log for each file (id, key, size_bytes, content, and ``fetch_error`` where one couldn't be fetched)."""
    fetch_error = F.col("fetch_error") if "fetch_error" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder.images()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                began = time.time()
                there = part["fetch_error"].isna().to_numpy()
                own = iter(_encoded(encode, list(part["content"][there]), encoder.dimensions) if there.any() else [])
                found = [next(own) if ok else (None, error) for ok, error in zip(there, part["fetch_error"], strict=True)]
                spent, now = (time.time() - began) * 1000, pd.Timestamp.now(tz="UTC").tz_localize(None)
                status = ["done" if error is None else "failed" for _, error in found]
                yield part[["id", "key", "size_bytes"]].assign(status=status, error=[e for _, e in found], elapsed_ms=spent / len(part), embedding=[v for v, _ in found], updated_at=now)

    return files.select("id", "key", "size_bytes", "content", fetch_error.alias("fetch_error")).mapInPandas(run, _OUT)


Log = str | StateTable


def claimed(spark: SparkSession, log_path: Log, encoder: Encoder) -> None:
    """Notes the model of a log, or refuses one of another model."""
    if isinstance(log_path, StateTable):
        known = log_path.fact("model")
        mine = json.dumps([encoder.name, encoder.dimensions, encoder.revision])
        if known is None:
            log_path.remember("model", mine)
        elif known != mine:
            raise ValueError(f"the state was begun with {known}, not {mine}")
        return
    facts = f"{log_path.rstrip('/')}-facts"
    mine = (encoder.name, encoder.dimensions, encoder.revision)
    try:
        known = spark.read.schema("name string, dimensions int, revision string").json(facts).first()
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        known = None
    if known is None:
        spark.createDataFrame([mine], "name string, dimensions int, revision string").coalesce(1).write.mode("overwrite").json(facts)
    elif tuple(known) != mine:
        raise ValueError(f"{log_path} was begun with {known.name} ({known.dimensions} dimensions, revision {known.revision}), not {encoder.name}")


def ingested(todo: DataFrame, folder: str, log_path: Log, encoder: Encoder, most_bytes: int = 1 << 30, per_write: int = PER_WRITE) -> int:
    """Fetches and encodes what the log doesn't have yet, by key and so many files at a time; each time is appended to the log (or recorded in the state table, which is folded at the end), so an interruption loses no more. Returns how many files there were."""
    table = log_path if isinstance(log_path, StateTable) else None
    spark, files = todo.sparkSession, 0
    todo = todo.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while True:
            left = todo
            try:
                left = table.pending(todo) if table else pending(todo, spark.read.schema(_OUT).parquet(log_path))
            except Exception as problem:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(problem):
                    raise
            some = left.orderBy("key").limit(per_write).persist(StorageLevel.MEMORY_AND_DISK)
            n = some.count()
            if n:
                fits = encoded(fetched(some.where(F.col("size_bytes") <= most_bytes), folder, size_col="size_bytes"), encoder)
                large = some.join(oversized(some, most_bytes), "id").selectExpr("id", "key", "size_bytes", "status", "error", "0D AS elapsed_ms", "CAST(NULL AS array<float>) AS embedding", "current_timestamp() AS updated_at")
                if table:
                    table.seed(some)
                    table.record(fits.unionByName(large))
                else:
                    fits.unionByName(large).write.mode("append").parquet(log_path)
                files += n
            some.unpersist()
            if n < per_write:
                if table:
                    table.fold()
                return files
    finally:
        todo.unpersist()


def start(files: DataFrame, folder: str, log_path: Log, checkpoint: str, encoder: Encoder, most_bytes: int = 1 << 30, per_write: int = PER_WRITE) -> StreamingQuery:
    """Runs over what is there and ends; to go on, start it again with the same checkpoint and model."""
    claimed(files.sparkSession, log_path, encoder)

    def write(batch: DataFrame, _: int) -> None:
        ingested(keyed(batch), folder, log_path, encoder, most_bytes, per_write)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
