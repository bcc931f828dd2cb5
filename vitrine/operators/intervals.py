"""Joins of two tables of intervals by equality: no row meets all rows of the other side.

An interval's level is the least power of two that is as wide as it is, so it
touches two bins of that width at most. It is put into the bins of its own
level and of the wider levels that the other side uses; two intervals that
overlap share a bin at the wider one's level. The bin that holds the later of
their beginnings counts, so each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """The least k with 2^k > high - low."""
    return F.length(F.bin(high - low)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def _bounded(rows: DataFrame, low: str, high: str, least: int, most: int) -> DataFrame:
    """``row``, ``low``, ``high``, ``level`` of intervals that can meet anything: open ends stand at the ends of what there is, empty intervals go."""
    ends = F.greatest(F.coalesce(F.col(f"`{low}`").cast("long"), F.lit(least)), F.lit(least)).alias("low"), F.least(F.coalesce(F.col(f"`{high}`").cast("long"), F.lit(most)), F.lit(most)).alias("high")
    proper = F.coalesce(F.col(f"`{low}`") <= F.col(f"`{high}`"), F.lit(True))
    found = rows.where(proper).select(F.struct("*").alias("row"), *ends).where("low <= high")
    return found.withColumn("level", _level(F.col("low"), F.col("high")))


def _binned(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each bin of each level that is the interval's own or a wider one of ``levels``."""
    wider = F.filter(F.array(*(F.lit(n) for n in levels)), lambda n: n > F.col("level"))
    at = rows.withColumn("at", F.explode(F.array_append(wider, F.col("level"))))
    first, last = _bin(F.col("low"), F.col("at")), _bin(F.col("high"), F.col("at"))
    return at.withColumn("bin", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """``left`` and ``right``, structs of the rows of two tables whose intervals overlap, each pair of rows once.

    Ends belong to intervals and are whole numbers; a null end is open. An
    interval that ends before it begins meets nothing. Equal rows are rows of
    their own. Columns of any name stay in the structs.
    """
    ends = lambda rows, e: rows.agg(F.min(F.least(*(F.col(f"`{c}`").cast("long") for c in e))).alias("least"), F.max(F.greatest(*(F.col(f"`{c}`").cast("long") for c in e))).alias("most"))
    spans = [ends(left, left_ends).first(), ends(right, right_ends).first()]  # a row each
    known = [x for s in spans for x in s if x is not None]
    least, most = (min(known), max(known)) if known else (0, 0)
    one, two = _bounded(left, *left_ends, least, most), _bounded(right, *right_ends, least, most)
    levels = [sorted(r["level"] for r in rows.select("level").distinct().collect()) for rows in (one, two)]  # 64 at most
    a = _binned(one, levels[1]).select(F.col("row").alias("left"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("level").alias("a_level"), "at", "bin")
    b = _binned(two, levels[0]).select(F.col("row").alias("right"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("level").alias("b_level"), "at", "bin")
    met = a.join(b, ["at", "bin"]).where((F.col("at") == F.greatest("a_level", "b_level")) & (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high")))
    return met.where(F.col("bin") == _bin(F.greatest("a_low", "b_low"), F.col("at"))).select("left", "right")
