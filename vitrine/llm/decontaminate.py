"""Benchmark decontamination by winnowing, with DataFrame functions only.

A fingerprint is the smallest hash of five consecutive words in each run of
six such hashes, so every shared span of ten words holds one in common. Test
items and documents are fingerprinted alike and joined on the fingerprints;
around each hit the words themselves are compared. Items of fewer than ten
words are matched by hashes of their whole length.

How it scales: documents' fingerprints meet the benchmark's in a semi join,
broadcast only while a count proves the benchmark's side small. What is found
is gathered by document, so the texts are read a second time only to be joined
with it. Windows name the set of items they stand in, not the items, until
each document has its distinct sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved

WINDOW = 10
GRAM = 5
#: Rows of the benchmark's side up to which it is broadcast: some megabytes.
BROADCAST_ROWS = 50_000
#: Slots of a document's matched fingerprints at most.
SLOTS = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(df: DataFrame, text_col: str) -> F.Column:
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _gram_hashes(k: int) -> str:
    grams = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"IF(size(w) >= {k}, transform(sequence(0, size(w) - {k}), i -> xxhash64({k}, {grams})), CAST(array() AS array<bigint>))"


def _winnowed(h: str, run: int) -> str:
    if run == 1:
        return f"array_distinct({h})"
    least = ", ".join(f"{h}[j + {x}]" for x in range(run))
    return f"IF(size({h}) >= {run}, array_distinct(transform(sequence(0, size({h}) - {run}), j -> least({least}))), CAST(array() AS array<bigint>))"


def _fingerprints(df: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``df`` (with its words, w) and ``fps``. A shape is a gram's length and the run it is the least of."""
    df = df.select("*", *(F.expr(_gram_hashes(k)).alias(f"h{k}") for k, _ in shapes))
    lists = [_winnowed(f"h{k}", run) for k, run in shapes]
    return df.withColumn("fps", F.expr(lists[0] if len(lists) == 1 else f"array_distinct(concat({', '.join(lists)}))")).drop(*(f"h{k}" for k, _ in shapes))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _starts(width: int, k: int) -> str:
    """Windows of ``width`` words that hold a gram of a matched fingerprint (in ``slots``): first word, width and text."""
    grams = ", ".join(f"w[i + {j}]" for j in range(k))
    hits = f"filter(sequence(0, size(w) - {k}), i -> exists(array(xxhash64({k}, {grams})), h -> array_contains(slots[CAST(pmod(h, size(slots)) AS int)], h)))"
    near = f"flatten(transform({hits}, i -> sequence(greatest(0, i - {width - k}), least(i, size(w) - {width}))))" if width > k else hits
    # a hit so near the end that no window begins before it counts from the last window
    near = near.replace(f"least(i, size(w) - {width})", f"greatest(greatest(0, i - {width - k}), least(i, size(w) - {width}))")
    return f"IF(size(w) >= {width}, transform(array_distinct({near}), s -> named_struct('start', s, 'width', {width}, 'window', concat_ws(' ', slice(w, s + 1, {width})))), CAST(array() AS array<struct<start:int,width:int,window:string>>))"


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` (start, width), a row for each row of ``documents``.

    Words are runs of letters and digits, A-Z lower-cased, and of characters
    beyond ASCII. A document's word is hit if it is in any occurrence of ten
    consecutive words of an item, or of a whole shorter item.

    Null texts and texts without words are not hit and hit nothing; items
    without id or words are left out; rows with one item id are one item. Rows
    of ``documents`` are judged each by itself, also with repeated or null ids.
    Other columns are neither read nor returned; empty tables are allowed on either side.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), _words(benchmark, item_text_col).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    items = saved(items)
    short = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # nine values at most
    shapes = [(GRAM, WINDOW - GRAM + 1)]
    parts = _fingerprints(items.where(F.size("w") >= WINDOW), shapes).select(F.explode_outer("fps").alias("fp"))
    shorter = [items.where(F.size("w") == n).select(F.explode_outer(F.expr(_gram_hashes(n))).alias("fp")) for n in short]
    fps = saved(reduce(DataFrame.unionAll, shorter, parts).distinct())
    n_fps = fps.count()

    cut = f"IF(size(w) >= {WINDOW}, transform(sequence(0, size(w) - {WINDOW}), s -> concat_ws(' ', slice(w, s + 1, {WINDOW}))), array(concat_ws(' ', w)))"
    windows = items.select("item", F.explode_outer(F.expr(cut)).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = saved(windows.withColumn("item_set", F.sha2(F.concat_ws(",", "items"), 256)))
    sets = windows.groupBy("item_set").agg(F.first("items").alias("items"))
    windows = windows.select("window", "item_set")
    n_windows = windows.count()

    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # 128 bits of id and text tell rows apart
    rows = rows.withColumn("key", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(7), "text", "id").alias("b")))
    plain = rows.select("key", _words(rows, "text").alias("w"))
    # a short item's gram length may be the long ones' too: then all grams of that length count
    wide = [s for s in shapes if s[0] not in short] + [(n, 1) for n in short]
    # explode() would add a filter that works the words out again for every gram
    found = _fingerprints(plain, wide).select("key", F.explode_outer("fps").alias("fp")).join(_sized(fps, n_fps), "fp", "left_semi")
    found = found.groupBy("key").agg(F.collect_set("fp").alias("found"))

    # a long text's matches stand in slots by remainders, so that no word is compared with all of them
    slots = f"transform(sequence(0, least({SLOTS}, size(found) div 32 + 1) - 1), b -> filter(found, f -> pmod(f, least({SLOTS}, size(found) div 32 + 1)) = b))"
    shaped = rows.select("key", "id", "text").join(found, "key", "left").select("key", "id", "found", F.when(F.col("found").isNotNull(), F.expr(slots)).alias("slots"), _words(rows, "text").alias("w"))
    cuts = [(WINDOW, GRAM), *((n, n) for n in short)]
    all_cuts = f"concat({', '.join(_starts(width, k) for width, k in cuts)})"
    shaped = shaped.select("key", "id", F.size("w").cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), F.expr(all_cuts)).alias("cuts"))
    shaped = saved(shaped)

    hits = shaped.where("size(cuts) > 0").dropDuplicates(["key"]).select("key", F.explode("cuts").alias("cut")).select("key", "cut.*").join(_sized(windows, n_windows), "window")
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "width"))).alias("spans"))
    spans = spans.withColumn("n_hit", F.expr("CAST(size(array_distinct(flatten(transform(spans, x -> sequence(x.start, x.start + x.width - 1))))) AS long)"))
    named = hits.select("key", "item_set").distinct().join(_sized(sets, n_windows), "item_set").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = shaped.select("key", "id", "n_words").join(spans, "key", "left").join(named, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,width:int>>")).alias("spans"),
    )
