"""The state of an ingest as a table of one row an item: a snapshot, changes behind it, and a manifest that tells which of them count.

Changes are appended, each batch a folder of its own that counts once its
writer has committed. Folding joins the changes with the snapshot into a new
one and publishes it with a manifest of the next number; until then readers see
the old one, so a fold that dies leaves nothing but files to be swept. Readers
read one snapshot and the changes behind it, never the whole history.

A snapshot is divided by a hash of the id and sorted by id, so a look at single
ids reads the row groups that may hold them. One writer works at a time; there
may be any number of readers.
"""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Parts of a snapshot.
BUCKETS = 64
#: Changed ids up to which they go to the snapshot's tasks instead of the snapshot to them.
BROADCAST_ROWS = 200_000

#: What an item is (kept from its seed) and what was done with it (of its last record).
SEEDED = "id string, key string, size_bytes long"
RECORDED = "status string, error string, elapsed_ms double, metadata string, embedding array<float>, updated_at timestamp"
_SEED, _RECORD = 0, 1


class _Folder:
    """Small files of a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        at = self.path(f"{self.folder}/{below}")
        return sorted(x.getPath().getName() for x in self.files.listStatus(at)) if self.files.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(f"{self.folder}/{name}"))

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(f"{self.folder}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """All of a file or nothing; an error if it is there."""
        hidden = self.path(f"{self.folder}/_writing-{uuid4()}")
        stream = self.files.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.files.mkdirs(self.path(f"{self.folder}/{name}").getParent())
        if self.exists(name) or not self.files.rename(hidden, self.path(f"{self.folder}/{name}")):
            self.files.delete(hidden, False)
            raise RuntimeError(f"{self.folder}/{name} was written by another writer")

    def delete(self, name: str) -> None:
        self.files.delete(self.path(f"{self.folder}/{name}"), True)


class StateTable:
    """Items (``SEEDED``) and what became of them (``RECORDED``; null before a record, but for the status ``pending``)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets, self._folder = spark, buckets, _Folder(spark, folder)
        self.schema = StructType.fromDDL(f"{SEEDED}, {RECORDED}")
        self._changes = StructType([*self.schema.fields, *StructType.fromDDL("op int, turn long")])
        self._stored = StructType([*self.schema.fields, StructField("bucket", StructType.fromDDL("x int")["x"].dataType)])

    # --- what counts ---

    def _manifest(self) -> dict:
        names = self._folder.names("manifests")
        return json.loads(self._folder.read(f"manifests/{names[-1]}")) if names else {"version": 0, "snapshot": None, "folded": -1, "buckets": self.buckets, "facts": {}}

    def _batches(self, manifest: dict) -> list[int]:
        """Batches of changes behind the snapshot whose writers have committed."""
        later = (n for n in self._folder.names("changes") if n.isdigit() and int(n) > manifest["folded"])
        return [int(n) for n in later if self._folder.exists(f"changes/{n}/_SUCCESS")]

    def _publish(self, manifest: dict) -> None:
        self._folder.publish(f"manifests/{manifest['version'] + 1:012}", json.dumps(manifest | {"version": manifest["version"] + 1}))

    # --- changes ---

    def _append(self, rows: DataFrame, op: int) -> int:
        given = {f.name for f in rows.schema.fields}
        cells = [(F.col(f"`{f.name}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        numbers = [int(n) for n in self._folder.names("changes") if n.isdigit()]
        batch = max([self._manifest()["folded"], *numbers]) + 1
        rows.select(*cells, F.lit(op).alias("op"), F.monotonically_increasing_id().alias("turn")).write.mode("errorifexists").parquet(f"{self._folder.folder}/changes/{batch:012}")
        return batch

    def seed(self, items: DataFrame) -> int:
        """Adds items (id, key, size_bytes); those that are there stay as they are. Rows without id are passed over. Returns the batch's number."""
        return self._append(items.where("id IS NOT NULL"), _SEED)

    def record(self, results: DataFrame) -> int:
        """Sets what was done with items that are there; of several rows of an id the latest ``updated_at`` counts (ties: any one of them)."""
        return self._append(results.where("id IS NOT NULL"), _RECORD)

    def remember(self, name: str, value: str) -> None:
        """Sets a fact about the whole table."""
        manifest = self._manifest()
        self._publish(manifest | {"facts": manifest["facts"] | {name: value}})

    def fact(self, name: str) -> str | None:
        return self._manifest()["facts"].get(name)

    # --- what is ---

    def _snapshot(self, manifest: dict) -> DataFrame:
        if manifest["snapshot"] is None:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(f"{self._folder.folder}/snapshots/{manifest['snapshot']}")

    def _changed(self, batches: list[int]) -> DataFrame:
        """A row for each id with changes: its first seed, its last record before and after all seeds of the id, as places tell."""
        parts = [self.spark.read.schema(self._changes).parquet(f"{self._folder.folder}/changes/{b:012}").withColumn("batch", F.lit(b)) for b in batches]
        rows = reduce(DataFrame.unionAll, parts)
        place, is_seed = F.struct("batch", "turn"), F.col("op") == _SEED
        item = F.struct("key", "size_bytes")
        done = F.struct("status", "error", "elapsed_ms", "metadata", "embedding", "updated_at")
        last = F.struct("batch", "updated_at", "turn")
        return rows.groupBy("id").agg(
            F.min_by(F.when(is_seed, item), F.when(is_seed, place)).alias("seed"), F.min(F.when(is_seed, F.col("batch"))).alias("seeded"),
            F.max_by(F.when(~is_seed, done), F.when(~is_seed, last)).alias("done"), F.max(F.when(~is_seed, F.col("batch"))).alias("recorded"),
        )

    def _merged(self, manifest: dict, batches: list[int], old: DataFrame) -> DataFrame:
        """The snapshot's rows (``old``) with the changes; ids of neither stay out."""
        if not batches:
            return old.select(*self.schema.names)
        new = self._changed(batches)
        if new.count() <= BROADCAST_ROWS:
            new = F.broadcast(new)
            met = old.join(new, "id", "left")  # the snapshot stays where it is
            fresh = new.join(old.select("id"), "id", "left_anti") if manifest["snapshot"] else new
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != "id"]
            met = met.select("id", *self.schema.names[1:], "seed", "seeded", "done", "recorded", F.lit(True).alias("there"))
            fresh = fresh.where("seeded IS NOT NULL").select("id", *blank, "seed", "seeded", "done", "recorded", F.lit(False).alias("there"))
            rows = met.unionAll(fresh)
        else:
            rows = old.withColumn("there", F.lit(True)).join(new, "id", "full").withColumn("there", F.col("there").isNotNull()).where("there OR seeded IS NOT NULL")
        # a record of before the item was there did nothing
        takes = F.col("recorded").isNotNull() & (F.col("there") | (F.col("recorded") > F.col("seeded")))
        kept = lambda c: F.when(F.col("there"), F.col(c)).otherwise(F.col(f"seed.{c}")).alias(c)
        set_ = lambda c, none=None: F.when(takes, F.col(f"done.{c}")).when(F.col("there"), F.col(c)).otherwise(none).alias(c)
        return rows.select("id", kept("key"), kept("size_bytes"), set_("status", "pending"), *(set_(c) for c in ("error", "elapsed_ms", "metadata", "embedding", "updated_at")))

    def current(self) -> DataFrame:
        """All items as they are now."""
        manifest = self._manifest()
        return self._merged(manifest, self._batches(manifest), self._snapshot(manifest))

    def of(self, ids: list[str]) -> DataFrame:
        """Some items: the parts of the snapshot that may hold them are read, no others."""
        manifest = self._manifest()
        buckets = [F.pmod(F.xxhash64(F.lit(i)), F.lit(manifest["buckets"])).cast("int") for i in ids]  # constants once the plan is made
        old = self._snapshot(manifest).where(F.col("bucket").isin(*buckets) & F.col("id").isin(*ids))
        rows = self._merged(manifest, self._batches(manifest), old)
        return rows.where(F.col("id").isin(*ids))

    def finished(self, retry_failed: bool = False) -> DataFrame:
        """Ids that a run needn't take up."""
        return self.current().where(F.col("status").isin(["done"] if retry_failed else ["done", "skipped", "failed"])).select("id")

    def pending(self, items: DataFrame, retry_failed: bool = False) -> DataFrame:
        return items.join(self.finished(retry_failed), "id", "left_anti")

    # --- keeping it small ---

    def fold(self) -> bool:
        """Makes a snapshot of what is, and has it count; False if there was nothing to fold."""
        manifest = self._manifest()
        batches = self._batches(manifest)
        if not batches:
            return False
        name = str(uuid4())
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket")
        rows = self._merged(manifest, batches, self._snapshot(manifest)).select(*self.schema.names, bucket)
        ordered = rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "id")
        ordered.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self._folder.folder}/snapshots/{name}")
        self._publish(manifest | {"snapshot": name, "folded": batches[-1], "buckets": self.buckets})
        return True

    def sweep(self) -> int:
        """Deletes what no manifest but the last speaks of: folded changes, other snapshots, what folds that died have left. Returns how many folders went. Not while somebody reads an older manifest's."""
        manifest, gone = self._manifest(), []
        gone += [f"snapshots/{n}" for n in self._folder.names("snapshots") if n != manifest["snapshot"]]
        gone += [f"changes/{n}" for n in self._folder.names("changes") if not n.isdigit() or int(n) <= manifest["folded"]]
        for name in gone:
            self._folder.delete(name)
        for name in self._folder.names("manifests")[:-1]:
            self._folder.delete(f"manifests/{name}")
        return len(gone)

    def drop(self) -> None:
        """Deletes all of it."""
        self._folder.files.delete(self._folder.path(self._folder.folder), True)
