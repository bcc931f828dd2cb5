"""Vectors as codes of their parts: a product quantizer over distinct integer parts.

Components become integers; a vector is cut into parts, and equal parts of one
position become one weighted row. Lloyd's rounds run over these distinct rows
alone: a round gives each the nearest entry of its position's codebook and
moves entries to the weighted floor mean. Codes and errors of distinct parts
are then joined back to the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved

SCALE = 256
#: Larger integers count as this one, so sums of squares fit into 64 bits.
LARGEST = 1 << 27
#: Distinct parts that hold more than this share of all parts (fewer than this many) are joined by broadcast.
HEAVY = 10_000
#: Rows times entries that are worked on at a time.
_CHUNK = 1 << 18


@dataclass
class Codebooks:
    """``entries[part][entry][component]``."""

    entries: np.ndarray

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(vector: Column) -> Column:
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    return F.transform(vector, lambda x: F.least(F.greatest(whole(x), F.lit(-LARGEST)), F.lit(LARGEST)))


def _finite(vector: Column) -> Column:
    """False for a null vector and for one with a null or non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(False))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the first one) and the squared distance to it."""
    codes, errors = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    step = max(1, _CHUNK // max(1, len(entries)))
    for i in range(0, len(parts), step):
        own = ((parts[i : i + step, None, :] - entries[None]) ** 2).sum(-1)
        codes[i : i + step] = own.argmin(1)
        errors[i : i + step] = own.min(1)
    return codes, errors


def _assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """``pos``, ``part``, ``weight``, ``code``, ``error`` of distinct parts."""
    entries = books.entries  # parts x entries x components: bounded by parameters

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, part = batch.column(0).to_numpy(), batch.column(1)
            values = part.flatten().to_numpy().reshape(len(pos), entries.shape[2])
            codes, errors = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                own = pos == p
                codes[own], errors[own] = nearest(values[own], entries[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), part, batch.column(2), pa.array(codes), pa.array(errors)], names=["pos", "part", "weight", "code", "error"])

    return distinct.select("pos", "part", "weight").mapInArrow(assign, "pos int, part array<long>, weight long, code int, error long")


def _moved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floor of its parts' weighted mean; unused ones stay."""
    width = books.entries.shape[2]
    sums = [F.sum(F.col("weight").cast("decimal(20,0)") * F.col("part")[i]).alias(f"s{i}") for i in range(width)]
    found = _assigned(distinct, books).groupBy("pos", "code").agg(F.sum("weight").alias("n"), *sums).collect()  # a row an entry
    entries = books.entries.copy()
    for r in found:
        entries[r["pos"], r["code"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return Codebooks(entries)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", *, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """``id_col``, ``label_col``, ``code`` (a byte's two hex digits for each part), ``error`` and ``label_error`` (summed
    over equal labels, nulls together) of each vector kept; and the codebooks.

    Vectors that are null or hold a null, NaN or infinity are dropped, and so
    are those of another length than the vector of the smallest id has. That
    length must be a multiple of ``parts``, else ValueError. Codebooks start
    from the vectors of the smallest ids (null ids last, equal ids by their
    components); with fewer vectors than ``entries``, from all. Rows of one id
    and equal vectors are rows of their own. Components of 2^19 or more count
    as 2^19. No vectors: no rows, and None for the codebooks. Other columns are
    neither read nor returned.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries: a code is one byte")
    vector = F.col(f"`{vector_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    kept = vectors.where(_finite(vector)).select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), _integers(vector).alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    dims = len(first[0]["v"]) if first else 0
    if dims % parts or (first and not dims):
        raise ValueError(f"vectors of {dims} components don't have {parts} equal parts")
    width = dims // parts
    kept = saved(kept.where(F.size("v") == dims).withColumn("row", F.monotonically_increasing_id()))
    starts = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    names = [id_col, label_col or "label", "code", "error", "label_error"]
    if not starts:
        none = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.toDF(*names), None
    books = Codebooks(np.array(starts, np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2).copy())

    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width)))
    pieces = kept.select("row", cut.alias("pos", "part"))
    distinct = saved(pieces.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        books = _moved(distinct, books)
    coded = saved(_assigned(distinct, books))

    # parts that very many vectors share are few, so they go to the vectors; the others meet them by the part
    total = coded.agg(F.sum("weight")).first()[0]
    heavy = F.col("weight") * HEAVY > total
    hot = coded.where(heavy).select("pos", "part", F.struct("code", "error").alias("found"))  # under HEAVY rows, as weights add up to total
    rare = coded.where(~heavy).select("pos", "part", "code", "error")
    met = pieces.join(F.broadcast(hot), ["pos", "part"], "left")
    by_hot = met.where("found IS NOT NULL").select("row", "pos", "found.code", "found.error")
    by_part = met.where("found IS NULL").select("row", "pos", "part").join(rare, ["pos", "part"]).select("row", "pos", "code", "error")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0"))), "")
    codes = by_hot.unionByName(by_part).groupBy("row").agg(digits.alias("code"), F.sum("error").alias("error"))
    out = saved(kept.select("row", "id", "label").join(codes, "row"))
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    if by_label.count() <= HEAVY:
        by_label = F.broadcast(by_label)
    of_label = by_label.withColumnRenamed("label", "of_label")
    return out.join(of_label, F.col("label").eqNullSafe(F.col("of_label"))).select("id", "label", "code", "error", "label_error").toDF(*names), books
