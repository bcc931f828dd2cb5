"""The ingest log: what is done, what went wrong, what is left, how fast it goes.

The log is append-only: id, key, size_bytes, status (done, skipped, failed,
pending), error, elapsed_ms, updated_at. The latest row of an id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pause of more seconds than this is no work time.
GAP_S = 900
MIB = 1 << 20


def _micros(name: str) -> Column:
    """Also of timestamps without zone, which count as the session's."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def latest(log: DataFrame) -> DataFrame:
    row = F.max_by(F.struct(*log.columns), F.struct("updated_at", "id"))
    return log.groupBy("id").agg(row.alias("row")).select("row.*")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("items"))


def problems(state: DataFrame, most: int = 10) -> DataFrame:
    error = F.substring("error", 1, 80)
    rows = state.where("status IN ('failed', 'skipped')").groupBy("status", error.alias("error")).agg(F.count("*").alias("items"), F.min("id").alias("first"))
    return rows.orderBy(F.desc("items"), "first").limit(most).select("status", "error", "items")


def pending(files: DataFrame, state: DataFrame, retry_failed: bool = False) -> DataFrame:
    finished = state.where(F.col("status").isin(["done"] if retry_failed else ["done", "skipped", "failed"])).select("id")
    return files.join(finished, "id", "left_anti")


def oversized(files: DataFrame, most_bytes: int) -> DataFrame:
    """Rows for the log of files that are too large to be fetched."""
    reason = F.concat(F.lit("skip: over "), F.lit(str(most_bytes)), F.lit(" bytes"))
    return files.where(F.col("size_bytes") > most_bytes).select("id", F.lit("skipped").alias("status"), reason.alias("error"))


def failed_files(state: DataFrame, most: int = 100) -> DataFrame:
    return state.where("status = 'failed'").select("key", "error", "id").orderBy("key", "id").limit(most).select("key", "error")


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first files by key, as a limited run takes them."""
    return files.orderBy("key").limit(limit)


def _finished(state: DataFrame) -> DataFrame:
    """Finishes of what is no longer pending, in whole seconds."""
    second = F.floor(_micros("updated_at") / 1_000_000)
    return state.where("status <> 'pending' AND updated_at IS NOT NULL").select(second.alias("at"), _micros("updated_at").alias("exact"), "id", "elapsed_ms")


def active_seconds(state: DataFrame, zone_s: int = 86_400) -> DataFrame:
    """Seconds of work: gaps between finishes of up to ``GAP_S``, and the first item's own time.

    Times are cut into zones of a day, worked on side by side, by seconds (a
    second's finishes count once); what lies between two zones' ends follows
    from their first and last times, a row a zone.
    """
    seconds = _finished(state).groupBy("at").agg(F.min(F.struct("exact", "id", F.coalesce("elapsed_ms", F.lit(0.0)).alias("ms"))).alias("first")).withColumn("zone", F.floor(F.col("at") / zone_s))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("zone").orderBy("at"))
    zones = seconds.withColumn("gap", gap).groupBy("zone").agg(
        F.coalesce(F.sum(F.when(F.col("gap") <= GAP_S, F.col("gap"))), F.lit(0)).alias("inside"), F.min("at").alias("low"), F.max("at").alias("high"), F.min("first").alias("first")
    )
    between = F.col("low") - F.lag("high").over(Window.orderBy("zone"))  # a row a day
    zones = zones.withColumn("between", between)
    active = F.sum(F.col("inside") + F.coalesce(F.when(F.col("between") <= GAP_S, F.col("between")), F.lit(0)))
    return zones.agg(F.coalesce(F.round(active + F.min("first")["ms"] / 1000, 3), F.lit(0.0)).alias("active_s"))


def rates(state: DataFrame) -> DataFrame:
    """Items, bytes read, start (the first finish less its own time), finish (null while something is pending), work time, and items and MiB for each second of it."""
    done, seen = F.col("status") == "done", F.col("status").isin("done", "failed")
    out = state.agg(
        F.count_if(done).alias("done"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.coalesce(F.sum(F.when(seen, F.col("size_bytes"))), F.lit(0).cast("long")).alias("bytes_read"),
    )
    ends = _finished(state).agg(F.min(F.struct("exact", "id", "at", F.coalesce("elapsed_ms", F.lit(0.0)).alias("ms"))).alias("first"), F.max("at").alias("last"))
    out = out.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(active_seconds(state)))  # one row each
    start = F.floor(F.col("first")["at"] - F.col("first")["ms"] / 1000)
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    seconds = F.nullif("active_s", F.lit(0.0))
    return out.select(
        "done", "pending", "bytes_read", iso(start).alias("started_at"), iso(F.when(F.col("pending") == 0, F.col("last"))).alias("finished_at"), F.bround("active_s", 1).alias("active_s"),
        F.bround(F.col("done") / seconds, 2).alias("items_per_s"), F.bround(F.col("bytes_read") / MIB / seconds, 1).alias("mib_per_s"),
    )


def running_sum(rows: DataFrame, value: str, at: str, tie: str, zone_s: int = 3_600) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` up to each row in the order of ``at`` (a timestamp) and ``tie``.

    Hours are summed side by side; what came before an hour is a sum of hours, a row each.
    """
    zoned = rows.withColumn("zone", F.floor(_micros(at) / (zone_s * 1_000_000)))
    sums = zoned.groupBy("zone").agg(F.sum(value).alias("s"))
    before = sums.select("zone", (F.sum("s").over(Window.orderBy("zone")) - F.col("s")).alias("before"))
    inside = F.sum(value).over(Window.partitionBy("zone").orderBy(at, tie))
    return zoned.join(before, "zone").withColumn("running", F.col("before") + inside).drop("zone", "before")


def in_flight(log: DataFrame) -> DataFrame:
    """``at``, ``change`` and ``running`` bytes that were being worked on: each finished item takes its bytes from its start to its finish (releases first)."""
    start = F.timestamp_micros(_micros("updated_at") - F.round(F.coalesce("elapsed_ms", F.lit(0.0)) * 1000).cast("long"))
    moves = F.array(F.struct(start.alias("at"), F.col("size_bytes").alias("change")), F.struct(F.col("updated_at").cast("timestamp").alias("at"), (-F.col("size_bytes")).alias("change")))
    steps = log.where("status <> 'pending' AND updated_at IS NOT NULL").select(F.explode(moves).alias("m")).groupBy("m.at").agg(F.sum("m.change").alias("change"))
    return running_sum(steps, "change", "at", "change")


def progress(log: DataFrame, total: int, tick_s: int = 2) -> DataFrame:
    """For each tick in which something finished: items and bytes so far, the rates of the tick and on average, and seconds that remain."""
    ticks = _finished(log).groupBy(F.floor(F.col("at") / tick_s).alias("tick")).agg(F.count("*").alias("items"))
    ticks = ticks.withColumn("at", F.timestamp_seconds(F.col("tick") * tick_s))
    rows = running_sum(ticks, "items", "at", "tick", 86_400)
    began = ticks.agg(F.min("tick").alias("began"))  # one row
    seconds = (F.col("tick") - F.col("began") + 1) * tick_s
    out = rows.crossJoin(F.broadcast(began)).withColumns({"seconds": seconds, "average": F.col("running") / seconds})
    left = F.greatest(F.lit(total) - F.col("running"), F.lit(0)) / F.col("average")
    return out.select("at", F.col("running").alias("items"), F.round(F.col("items") / tick_s, 4).alias("now_per_s"), F.round("average", 4).alias("average_per_s"), F.round(left, 1).alias("remaining_s"))


def summary(state: DataFrame) -> DataFrame:
    """One row of a run as a file for others: counts, rates, problems and failed files, as JSON."""
    as_list = lambda df, *c: df.agg(F.coalesce(F.to_json(F.collect_list(F.struct(*c))), F.lit("[]")).alias("x"))  # noqa: E731  a bounded top
    one = rates(state).select(F.to_json(F.struct("*")).alias("run"))
    counts = status_counts(state).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "items"))))).alias("counts"))
    out = one.crossJoin(counts)
    for name, df in (("problems", as_list(problems(state), "status", "error", "items")), ("failed_files", as_list(failed_files(state), "key", "error"))):
        out = out.crossJoin(df.withColumnRenamed("x", name))
    return out


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of events of a key that are at most ``GAP_S`` apart."""
    out = events.groupBy(key, F.session_window(ts, f"{GAP_S} seconds").alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("start"), F.max(ts).alias("last"))
    return out.select(key, "start", "last", "events")
