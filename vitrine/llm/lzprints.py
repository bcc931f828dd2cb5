"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases, each the longest phrase known so far and one
character more. The set of phrases is what a compressor would learn from it;
minima of 64 hash functions over the set, sixteen bits each, are its
fingerprint, and the share of equal minima tells how alike two texts are.

Comparing each document with the one that follows it by id needs neighbours
together: documents go to ranges of ids whose cuts are quantiles, each range
gets a copy of the next one's first document, and tasks stream through their
ranges in order, holding one document at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.textarrays import mixed

MINIMA = 64
#: Characters in a range of ids, about, and the most ranges.
RANGE_CHARS = 8 << 20
MOST_RANGES = 20_000

_random = np.random.Generator(np.random.PCG64(77))
_FACTORS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_FIRST = -(1 << 63)


def phrases(text: str, start: int, known: set[str]) -> list[int]:
    """Ends of the phrases from ``start`` on; ``known`` gains them. As every beginning of a known phrase is known,
    the search for the longest one may begin at the last one's length and go either way."""
    ends, i, n, size = [], start, len(text), 1
    while i < n:
        j = min(i + size, n)
        if text[i:j] in known:
            while j < n and text[i : j + 1] in known:
                j += 1
            j += 1
        else:
            while j - 1 > i and text[i : j - 1] not in known:
                j -= 1
        if j > n:  # the last phrase may be one that is known
            ends.append(n)
            break
        known.add(text[i:j])
        ends.append(j)
        size, i = j - i, j
    return ends


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _span_hashes(text: str, ends: np.ndarray) -> np.ndarray:
    global _powers, _inverse
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if n > len(_powers):
        base = np.full(max(n, 1 << 16), np.uint64(_STEP))
        back = np.full(len(base), np.uint64(pow(_STEP, -1, 1 << 64)))
        base[0] = back[0] = 1
        _powers, _inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(points + np.uint64(1)) * _powers[:n], dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]])
    return mixed((total[ends] - total[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def _minima(text: str, ends: list[int]) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint16)
    hashes = _span_hashes(text, np.array(ends))
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(out, (_FACTORS[:, None] * hashes[None, i : i + 2048] + _ADDENDS[:, None]).min(1), out=out)
    return (mixed(out) >> np.uint64(48)).astype(np.uint16)


def _text(minima: np.ndarray) -> str:
    return minima.astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    """256 hex digits; empty for the empty text."""
    return _text(_minima(text, phrases(text, 0, set())))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima. The empty text is like itself only."""
    return float((a == b).mean()) if len(a) and len(b) else float(len(a) == len(b))


class Parsed:
    """A text, where its phrases end, and its minima."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends = phrases(text, 0, set())
        self.minima = _minima(text, self.ends)

    def edited(self, after: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by as much of ``after``, and its minima.

        It begins as the text does, so it has the same phrases up to there.
        """
        half = len(self.text) // 2
        own = len(self.text) - half
        edited = self.text[:own] + after[:half]
        if edited == self.text:
            return edited, self.minima
        shared = self.ends[: bisect_right(self.ends, own)]
        known = {self.text[i:j] for i, j in pairwise([0, *shared])}
        return edited, _minima(edited, shared + phrases(edited, shared[-1] if shared else 0, known))


_COLUMNS = "id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order of ids, the next range's first document behind them; a document is done when the next one has come."""
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last: tuple[int, int, int, bool, Parsed] | None = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, late, key, no_id, cell in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            text = cell.as_py() or ""
            now = last[4] if last is not None and last[4].text == text else Parsed(text)
            if last is not None and last[0] == bucket and not last[1]:
                own = last[4]
                edited, minima = own.edited(text)
                digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((last[2], last[3], len(own.text), digest, _text(own.minima), _text(minima), likeness(own.minima, minima), likeness(own.minima, now.minima)))
            last = (bucket, late, key, no_id, now)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _range_of(cuts: np.ndarray):
    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        """Twice the range, and one more for the first id of a range that has one before it."""
        at = np.searchsorted(cuts, ids.to_numpy(), "right")
        return pd.Series(2 * at + ((at > 0) & (cuts[np.maximum(at - 1, 0)] == ids.to_numpy()) if len(cuts) else 0)).astype("int32")

    return range_of


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``, a row for each row of ``documents``.

    The edited text is the text with its last half replaced by as much of the
    beginning of the next document by id (of the first one, behind the last).

    Ids are whole numbers of 64 bits. A null text is empty. Null ids come first; rows with one id follow one
    another in the order of a hash of their texts. Other columns are neither
    read nor returned; an empty table gives no rows.
    """
    # a null id takes the place of the smallest number there is, before a row that has it
    key, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_FIRST)), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = documents.select(key.alias("id"), F.col(f"`{id_col}`").isNull().alias("no_id"), text.alias("text"))
    size, least = rows.agg(F.sum(F.length("text")), F.min("id")).first()
    ranges = int(min(max(16, (size or 0) // RANGE_CHARS), MOST_RANGES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = np.unique(np.array(rows.agg(F.percentile_approx("id", shares, 100 * ranges)).first()[0] or [], np.int64))
    cuts = cuts[cuts > (least if least is not None else 0)]
    # quantiles are doubles, which need not be ids: a range begins with its own first one
    begins = rows.groupBy(F.shiftright(_range_of(cuts)("id"), 1).alias("bucket")).agg(F.min("id").alias("first")).collect() if len(cuts) else []  # MOST_RANGES rows at most
    cuts = np.array(sorted(r["first"] for r in begins if r["bucket"]), np.int64)

    rows = rows.withColumn("at", _range_of(cuts)("id")).withColumn("bucket", F.shiftright("at", 1))
    none = F.lit(None).cast("struct<bucket:int,late:int>")
    place = lambda bucket, late: F.struct(bucket.cast("int").alias("bucket"), F.lit(late).alias("late"))
    places = F.array(
        place(F.col("bucket"), 0),
        F.when(F.col("at") % 2 == 1, place(F.col("bucket") - 1, 1)).otherwise(none),
        F.when(F.col("id") == F.lit(least), place(F.lit(len(cuts)), 1)).otherwise(none),
    )
    dealt = rows.select(F.explode(F.filter(places, lambda x: x.isNotNull())).alias("place"), "id", "no_id", "text").select("place.bucket", "place.late", "id", "no_id", "text")
    # a range is a partition: none gets several by chance
    ordered = dealt.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "late", "id", F.desc("no_id"), F.xxhash64("text"))
    out = ordered.mapInArrow(_streamed, _COLUMNS)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), *(c.split()[0] for c in _COLUMNS.split(", ")[2:]))
