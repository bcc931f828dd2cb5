"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 places. Every shard owns some of them (its virtual nodes);
an arc is the run of places that ends in a virtual node, and a key belongs to
the arc of its hash. With bounded loads a shard takes rows until it is full;
what overflows continues clockwise, arc by arc, to the next shard with room.

Rows aren't placed one after another. An arc's rows have an order (by a hash of
the key), so what each shard takes of an arc is a run of ranks. The runs follow
from the counts of the arcs alone, which are as few as virtual nodes; a row
needs its rank within its arc only. Ranks are counts of cells of a few thousand
rows, summed up, and row numbers inside a cell.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved

PLACES = 1 << 16
#: Virtual nodes of a shard.
REPLICAS = 128
#: Rows of a cell, about.
CELL = 4096
#: A key with a larger part of all rows has its rows dealt over several cells.
HEAVY = 10_000

#: Of an arc: where its run of ranks ends, the shard that takes them, and what makes a slot of a rank.
Run = tuple[int, int, int]


def _owners(spark: SparkSession, shards: int, replicas: int) -> list[tuple[int, int]]:
    """Places of virtual nodes in order, and their shards; one place has one, the shard of the smaller number."""
    nodes = spark.range(shards * replicas).select(F.expr(f"cast(id div {replicas} as int)").alias("shard"), (F.col("id") % replicas).alias("replica"))
    nodes = nodes.select("shard", F.pmod(F.xxhash64(F.lit("shard"), "shard", "replica"), F.lit(PLACES)).alias("place"))
    return sorted((r["place"], r["shard"]) for r in nodes.groupBy("place").agg(F.min("shard").alias("shard")).collect())  # PLACES rows at most


def _arc_of_place(spark: SparkSession, owners: Sequence[tuple[int, int]]) -> DataFrame:
    """``place``, ``arc``: PLACES rows."""
    ends = [-1, *(place for place, _ in owners)]
    arcs = [{"arc": i, "low": low + 1, "high": high} for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    if ends[-1] < PLACES - 1:  # behind the last virtual node comes the first one
        arcs.append({"arc": 0, "low": ends[-1] + 1, "high": PLACES - 1})
    return _rows(spark, arcs, "arc int, low int, high int").select(F.explode(F.sequence("low", "high")).alias("place"), "arc")


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def runs(counts: Sequence[int], owners: Sequence[int], room: Sequence[int] | None, shards: int) -> list[list[Run]]:
    """For each arc, which ranks of its rows go to which shard: its own first, then clockwise to those with room (None: all have)."""
    free = list(room) if room is not None else [sum(counts)] * shards
    filled = [0] * shards
    out: list[list[Run]] = [[] for _ in counts]
    waiting = [(i, i, 0, n) for i, n in enumerate(counts) if n]
    while waiting:
        over = []
        for at, arc, low, high in waiting:
            shard = owners[at]
            taken = min(high - low, free[shard])
            if taken:
                out[arc].append((low + taken, shard, filled[shard] - low))
                free[shard] -= taken
                filled[shard] += taken
            if low + taken < high:
                over.append(((at + 1) % len(owners), arc, low + taken, high))
        waiting = over
    return out


def rooms(total: int, own: Sequence[int]) -> list[int]:
    """Equal rooms for ``total`` rows; the shards with most rows of their own have one more where they don't come out even."""
    base, more = divmod(total, len(own))
    first = set(sorted(range(len(own)), key=lambda s: (-own[s], s))[:more])
    return [base + (s in first) for s in range(len(own))]


def _mix(key: Column) -> Column:
    return F.xxhash64(F.lit("order"), key)


def placed(rows: DataFrame, shards: int, key_col: str = "doc_id", *, bounded: bool = True, replicas: int = REPLICAS) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``), ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    Bounded: counts of shards are at most one apart, whatever the keys; a key
    whose shard is full continues clockwise, and ``grown_shard`` is null.
    Else key and number of shards alone decide, counts are as even as virtual
    nodes make them, and ``grown_shard`` is the shard with one more shard,
    which takes rows only into itself.

    A null key is a key like others. Rows of one key, equal rows included, are
    rows of their own: they may go to different shards where one is full.
    Extra columns of any name stay in ``row``. An empty table gives no rows;
    with fewer rows than shards some shards are empty. ``rows`` is written
    once; pass what shall stay beside the shard, not whole texts.
    """
    if shards < 1 or replicas < 1 or (shards + 1) * replicas > PLACES:
        raise ValueError(f"1 to {PLACES} virtual nodes")
    spark = rows.sparkSession
    key = F.col(f"`{key_col}`")
    place = F.pmod(F.xxhash64(F.lit("key"), key), F.lit(PLACES))
    numbered = saved(rows.select(F.struct("*").alias("row"), place.alias("place"), _mix(key).alias("mix"), F.monotonically_increasing_id().alias("number")))

    owners = _owners(spark, shards, replicas)
    arcs = _arc_of_place(spark, owners)
    found = {r["arc"]: r["n"] for r in numbered.groupBy("place").agg(F.count("*").alias("n")).join(F.broadcast(arcs), "place").groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # as many as virtual nodes
    counts, shard_of = [found.get(i, 0) for i in range(len(owners))], [s for _, s in owners]
    total, own = sum(counts), [0] * shards
    for n, s in zip(counts, shard_of, strict=True):
        own[s] += n
    plan = runs(counts, shard_of, rooms(total, own) if bounded else None, shards)
    planned = _rows(
        spark,
        [{"arc": i, "cells": -(-n // CELL), "runs": [{"until": a, "shard": s, "shift": b} for a, s, b in own_runs]} for i, (n, own_runs) in enumerate(zip(counts, plan, strict=True)) if n],
        "arc int, cells long, runs array<struct<until:bigint,shard:int,shift:bigint>>".replace("long", "bigint"),
    )

    # rows of a key with very many rows differ by their number only
    heavy = numbered.groupBy("mix").agg(F.count("*").alias("n")).where(F.col("n") > max(CELL, total // HEAVY))  # under HEAVY rows
    heavy = heavy.select("mix", F.ceil(F.col("n") / CELL).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("number"), F.col("parts")), F.lit(0))
    in_cell = F.least(F.floor((F.col("mix") / F.lit(2.0**64) + 0.5) * F.col("cells")), F.col("cells") - 1)
    dealt = numbered.join(F.broadcast(arcs), "place").join(F.broadcast(planned), "arc").join(F.broadcast(heavy), "mix", "left")
    dealt = dealt.select("row", "place", "mix", "number", "arc", "runs", in_cell.alias("cell"), part.alias("part"))

    cell = ["arc", "cell", "part"]
    before = Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("mix", "number"))
    ranked = dealt.join(starts, cell).withColumn("rank", F.col("start") + inside - 1)
    run = F.element_at(F.filter("runs", lambda x: F.col("rank") < x["until"]), 1)
    out = ranked.select("row", "place", "rank", run.alias("run")).select("row", "place", F.col("run.shard").alias("shard"), (F.col("rank") + F.col("run.shift")).alias("slot"))
    if bounded:
        return out.select("row", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    more = _owners(spark, shards + 1, replicas)
    grown = _arc_of_place(spark, more).join(_rows(spark, [{"arc": i, "grown_shard": s} for i, (_, s) in enumerate(more)], "arc int, grown_shard int"), "arc")
    return out.join(F.broadcast(grown.select("place", "grown_shard")), "place").select("row", "shard", "slot", "grown_shard")
