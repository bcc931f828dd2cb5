"""Vector ranking, collapsing to objects, fusion and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.columns import dot, literal_vector
from vitrine.operators.browse import checked

#: Vectors in a block of a batch search.
BLOCK = 1024
#: Queries up to which their blocks are broadcast: some tens of megabytes.
BROADCAST_QUERIES = 8192


def vector_of(items: DataFrame, item: str) -> list[float]:
    """The stored vector of one item; an unknown one is an error."""
    row = items.where(F.col("item_id") == item).select("embedding").limit(1).collect()
    if not row:
        raise KeyError(f"no item {item}")
    return list(row[0][0])


def scored(items: DataFrame, vector: list[float]) -> DataFrame:
    return items.withColumn("similarity", dot(F.col("embedding"), literal_vector(vector))).drop("embedding")


def ranked(
    items: DataFrame, vector: list[float], limit: int, offset: int = 0, by_object: bool = True, exclude_object: str | None = None, transform: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``item_id``, ``object_id``, ``similarity`` and ``score`` of the nearest items, one an object if asked; ties by load order.

    ``transform`` changes the score that is reported, never the order.
    """
    rows = scored(items, vector)
    if exclude_object is not None:
        rows = rows.where(F.col("object_id") != exclude_object)
    if by_object:
        rows = best_of_objects(rows)
    page = rows.orderBy(F.desc("similarity"), "pos").offset(offset).limit(limit)
    s = F.col("similarity")
    return page.select("item_id", "object_id", "similarity", (transform(s) if transform else s).alias("score"))


def similar(items: DataFrame, item: str, limit: int) -> DataFrame:
    """What looks like an item, its own object left out, one item an object."""
    checked("similar", limit)
    own = items.where(F.col("item_id") == item).select("embedding", "object_id").limit(1).collect()
    if not own:
        raise KeyError(f"no item {item}")
    return ranked(items, list(own[0]["embedding"]), limit, exclude_object=own[0]["object_id"])


def best_of_objects(rows: DataFrame) -> DataFrame:
    """The most similar item of each object: an aggregate, combined before the shuffle."""
    best = F.max_by(F.struct("item_id", "pos", "similarity"), F.struct("similarity", -F.col("pos")))
    return rows.groupBy("object_id").agg(best.alias("best")).select("best.item_id", "object_id", "best.pos", "best.similarity")


def first_of_objects(items: DataFrame, groups: list[str]) -> DataFrame:
    """Each object's first item in the groups, else its first one."""
    first = F.min_by("item_id", F.struct(~F.col("group_id").isin(groups), "pos"))
    return items.groupBy("object_id").agg(first.alias("item_id"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            own = batch.slice(i, BLOCK)
            vectors = own.column(1).cast(pa.list_(pa.float64()))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary())], names=["ids", "vectors"])


def batch_nearest(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``pos`` and ``similarity`` of the ``k`` nearest items of each query.

    Both sides are packed into blocks of vectors, and blocks meet blocks: a
    pair is one matrix product that returns ``k`` rows a query, so rows follow
    the number of blocks, and the last step is a window over those. Both
    tables have ``pos`` (long) and ``embedding`` of one width.
    """
    left = items.select("pos", "embedding").mapInArrow(_packed, "ids array<long>, vectors binary")
    right = queries.select("pos", "embedding").mapInArrow(_packed, "ids array<long>, vectors binary").select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, a, q_ids, b in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, q_ids = np.array(ids.as_py()), np.array(q_ids.as_py())
                x, y = np.frombuffer(a.as_buffer()).reshape(len(ids), -1), np.frombuffer(b.as_buffer()).reshape(len(q_ids), -1)
                s = y @ x.T
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([np.repeat(q_ids, top.shape[1]), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()], names=["query_id", "pos", "similarity"])

    # few queries go to where the items are; many meet them block by block
    few = queries.count() <= BROADCAST_QUERIES
    pairs = left.crossJoin(F.broadcast(right) if few else right).mapInArrow(best, "query_id long, pos long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "pos")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "pos", "similarity")


def with_rank(rows: DataFrame, depth: int, *order: Column) -> DataFrame:
    """The first ``depth`` rows and their rank from 1; the window sees no more than those."""
    return rows.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fused(visual: DataFrame, keyword: DataFrame, weights: tuple[float, float], k: int = 60) -> DataFrame:
    """``object_id``, ``score``, ``visual_rank`` and ``keyword_rank`` by weighted reciprocal ranks.

    A channel of weight 0 keeps its rank but adds nothing, and what it alone
    has is left out.
    """
    sides = []
    for name, rows, weight in (("visual", visual, weights[0]), ("keyword", keyword, weights[1])):
        rank = F.col("rank")
        sides.append(
            rows.select(
                "object_id",
                (F.lit(float(weight)) / (k + rank)).alias("part"),
                F.lit(weight > 0).alias("counts"),
                (rank if name == "visual" else F.lit(None)).cast("int").alias("visual_rank"),
                (rank if name == "keyword" else F.lit(None)).cast("int").alias("keyword_rank"),
            )
        )
    both = sides[0].unionByName(sides[1]).groupBy("object_id")
    out = both.agg(F.sum("part").alias("score"), F.max("counts").alias("counts"), F.max("visual_rank").alias("visual_rank"), F.max("keyword_rank").alias("keyword_rank"))
    return out.where("counts").drop("counts")


def fused_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("visual_rank"), F.asc_nulls_last("keyword_rank"), "object_id").offset(offset).limit(limit)


def sampled(items: DataFrame, seed: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a shuffle that the seed fixes: ``object_id`` and one ``item_id`` of each; pages of one seed never overlap."""
    checked("sample", limit)
    turn = F.md5(F.concat(F.lit(seed + ":"), "object_id"))
    pick = F.min_by("item_id", F.md5(F.concat(F.lit(seed + ":"), "object_id", F.lit(":"), "item_id")))
    rows = items.groupBy("object_id").agg(pick.alias("item_id")).withColumn("turn", turn)
    return rows.orderBy("turn", "object_id").offset(offset).limit(limit).select("object_id", "item_id")
