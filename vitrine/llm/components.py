"""Connected components with DataFrame operations and tasks of bounded size.

Tasks first contract their own part of the edges to stars (each node points at
the smallest one that the part joins it with). A graph of a few parts is done
with that: parts are merged and contracted again while their edges fit
``PART`` a task. What is larger goes through alternating large-star and
small-star steps, which turn any graph into stars around each component's
smallest node in a number of rounds that follows the logarithm of its
diameter. A step groups by node for the smallest neighbour (a partial
aggregate, so a hub costs one row a task) and joins it back (a join that
adaptive execution splits at hubs); nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved

#: Edges in a task, about.
PART = 100_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that has a smaller one in its component, and that component's smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)  # the roots as well as the ends move
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with each task's own ones as stars, u > v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, rows = [], [], 0
        none = np.zeros(0, np.int64)
        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            rows += len(batch)
            if rows > 4 * PART:  # a task that got more works on some at a time
                x, y = stars(np.concatenate(u), np.concatenate(v))
                if len(x) > 2 * PART:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])
                    x = y = none
                u, v, rows = [x], [y], len(x)
        x, y = stars(np.concatenate(u or [none]), np.concatenate(v or [none]))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Every node's neighbours move to the smallest of them and the node."""
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that some link of two different nodes holds.

    Nodes are of one orderable type; tasks contract integer ones. Links may
    repeat, point either way and join a node to itself; links with a null end
    are left out. An empty table gives no rows.
    """
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    edges = saved(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    whole = dict(edges.dtypes)["u"] in ("bigint", "int")
    if whole:
        edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
        size = edges.count()
        while True:
            parts = max(1, -(-size // PART))
            edges = saved(_contracted(edges.coalesce(parts)))
            if parts == 1:
                return _named(edges)
            before, size = size, edges.count()
            if size > before // 2:
                break
    else:
        edges = saved(edges.distinct())
    seen = None
    for _ in range(most_rounds):
        edges = _star(_star(edges, large=True), large=False)
        edges = saved(_contracted(edges)) if whole else saved(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return _named(edges)


def _named(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
