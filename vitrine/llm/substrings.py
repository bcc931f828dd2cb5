"""Removing word passages that stand earlier in the corpus, by fixed-block anchors.

Every passage of ``width`` words holds a whole block of ``width // 2`` words
that begins at a multiple of that length. So the non-overlapping blocks of all
documents are the index, and every rolling window of that many words probes
it. Blocks that are hit are extended on both sides to all passages of
``width`` words around them, and those decide: a passage whose
words also start earlier is a repeat, and the repeats of a run of places make
up its maximal repeats.

How it scales: a task gathers the windows of some megabytes of text, keeps one
of each hash (the others have a hit beside them already, so a passage in a
third of all documents is one probe a chunk), and sends them packed, 32 bits a
hash and a few for the place, to hash buckets whose number follows the size of the
corpus. Windows side by side share a bucket, but for those of phrases that a
sample shows to stand in a ten-thousandth of all windows or more: these are
dealt by their own hashes, and in very large corpora all are in part, so a
bucket's windows stay within a few millions. Only places go back to
the documents; extension, too, sends only the passages around hits, by 96-bit
hashes. The text itself is shuffled once and read by both joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.llm.checkpoints import saved
from vitrine.llm.textarrays import TextSlice, give_back, mixed, slices, window_hashes

#: Words of text whose windows a task gathers before it sends them.
CHUNK_WORDS = 2_000_000
#: Windows in a bucket, about.
BUCKET_WINDOWS = 1_000_000
#: Characters of the sample that shows homes of many windows (it decides where windows meet, never which), and the share from which they are many.
SAMPLE_CHARS, HOT_SHARE = 32_000_000, 1e-4
#: Windows of one home in the sample below which it is never hot.
LEAST_HOT = 1000
#: Times a bucket's windows that one other home may add at most, about.
MOST_ADDED = 4

_ROW = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary()), ("hashes", pa.binary())])
_ROW_DDL = "bucket int, id long, tag long, places binary, hashes binary"
_HIT = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])
_HIT_DDL = "id long, tag long, places binary"
_EMPTY = np.zeros(0, np.int32)


def _pack(ids: np.ndarray, tags: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> bytes:
    """Places (document, word) in document order, each document named once."""
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    counts = np.diff(np.r_[first, len(docs)])
    steps = np.diff(pos, prepend=0)
    steps[first] = pos[first]
    head = np.array([len(first), len(docs)], np.int64).tobytes()
    own = docs[first]
    body = [np.diff(ids[own], prepend=0), np.diff(tags[own], prepend=0), counts.astype(np.int32), steps.astype(np.int32)]
    return head + pa.compress(b"".join(x.tobytes() for x in body), "zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tags and counts of the documents, and the places."""
    n, m = np.frombuffer(packed, np.int64, 2).tolist()
    body = pa.decompress(memoryview(packed)[16:], decompressed_size=20 * n + 4 * m, codec="zstd", asbytes=True)
    ids, tags = (np.cumsum(np.frombuffer(body, np.int64, n, i * 8 * n)) for i in (0, 1))
    counts, steps = np.frombuffer(body, np.int32, n, 16 * n), np.frombuffer(body, np.int32, m, 20 * n)
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return ids, tags, counts, total - np.repeat(total[first] - steps[first], counts)


def _by_document(ids: np.ndarray, tags: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A row for each document that has places; ``docs`` is in order."""
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    own = docs[first]
    offsets = (np.r_[first, len(docs)] * 4).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(pos.astype(np.int32))])
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(tags[own]), places], schema=_HIT)


class _Chunk:
    """Windows of several slices of text, sent on together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.documents = self.words = 0

    def add(self, ids: np.ndarray, tags: np.ndarray, docs: np.ndarray, pos: np.ndarray, words: int, *hashes: np.ndarray) -> None:
        self.parts.append((docs + self.documents, pos, *hashes))
        self.ids.append(ids)
        self.tags.append(tags)
        self.documents += len(ids)
        self.words += words

    def columns(self) -> tuple[np.ndarray, ...]:
        ids, tags = np.concatenate(self.ids), np.concatenate(self.tags)
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.__init__()
        return ids, tags, *columns


def _bucketed(ids: np.ndarray, tags: np.ndarray, docs: np.ndarray, pos: np.ndarray, bucket: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket; within it windows stand in document order."""
    order = np.argsort(bucket, kind="stable")
    docs, pos, bucket, hashes = docs[order], pos[order], bucket[order], [h[order] for h in hashes]
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist() if len(bucket) else [0]
    spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    none = pa.nulls(len(spans), pa.int64())
    packed = [_pack(ids, tags, docs[s], pos[s]) for s in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]], pa.int32()), none, none, pa.array(packed, pa.binary()), pa.array([b"".join(h[s].tobytes() for h in hashes) for s in spans], pa.binary())],
        schema=_ROW,
    )


def _straight(hits: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Places that need no answer, on their way past the buckets."""
    ids = hits.column(0).to_numpy()
    return pa.RecordBatch.from_arrays([pa.array((ids % buckets).astype(np.int32)), *hits.columns, pa.nulls(len(ids), pa.binary())], schema=_ROW)


@dataclass(frozen=True)
class Dealing:
    """Which bucket a window goes to: by its home and, in slices, by its own hash; by that alone if the home is hot."""

    buckets: int
    hot: np.ndarray

    @property
    def slices(self) -> int:
        return max(1, int(self.buckets * HOT_SHARE / MOST_ADDED))

    def of(self, home: np.ndarray, own: np.ndarray) -> np.ndarray:
        slices = np.uint64(self.slices)
        groups = np.uint64(max(1, self.buckets // self.slices))
        out = ((home >> np.uint64(32)) * groups >> np.uint64(32)) * slices + own % slices
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, home), len(self.hot) - 1)
            out = np.where(self.hot[at] == home, own % (groups * slices), out)
        return out.astype(np.int32 if self.buckets > 32_000 else np.int16)


def _hot_homes(rows: DataFrame, widths: tuple[int, ...], size: int) -> list[np.ndarray]:
    """For windows of each width, sorted, the homes of many: from a sample of ``rows``, a ten-thousandth of whose windows each has, so they are at most so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in _rows(batch):
                for i, width in enumerate(widths):
                    homes, counts = np.unique(_places(part, width, (3 + i,))[3], return_counts=True)
                    many = counts > 1
                    keys = np.concatenate([homes[many].view(np.int64), [0]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i), pa.int32()), pa.array(keys), pa.array(np.r_[counts[many], 0]), pa.array(np.r_[counts[many] * 0, counts.sum()])], names=["i", "home", "n", "windows"])

    scale = 1 << 20
    drawn = rows.where(F.pmod(F.xxhash64("id", "tag"), F.lit(scale)) < int(scale * min(1.0, SAMPLE_CHARS / max(1, size))))
    counted = drawn.mapInArrow(run, "i int, home long, n long, windows long").groupBy("i", "home").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")).where((F.col("n") >= LEAST_HOT) | (F.col("windows") > 0))
    counted = saved(counted)
    totals = {r["i"]: r["t"] for r in counted.groupBy("i").agg(F.sum("windows").alias("t")).collect()}  # a row a width
    out = []
    for i in range(len(widths)):
        hot = counted.where((F.col("i") == i) & (F.col("n") >= max(LEAST_HOT, HOT_SHARE * totals.get(i, 0)))).select("home").toPandas()["home"].to_numpy(np.int64)
        out.append(np.sort(hot.view(np.uint64)))
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, TextSlice]]:
    ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for part in slices(batch.column(2)):
        yield ids[part.first : part.last], tags[part.first : part.last], part


def _places(part: TextSlice, width: int, seeds: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Document and first word of every window of ``width`` words, the number of words, the windows' homes and hashes.

    A home is the least hash of half as many words in the window: windows side
    by side often share it, so they go to one bucket and come back together.
    """
    words = part.words()
    counts = words.counts
    docs = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    inside = docs[: max(0, len(docs) - width + 1)] == docs[width - 1 :] if len(docs) >= width else np.zeros(0, bool)
    pos = (np.arange(len(docs)) - np.repeat(words.bounds[:-1], counts)).astype(np.int32)
    own = [part.word_hashes(words, seed) for seed in seeds]
    n, half = len(inside), width - width // 2
    halves = window_hashes(own[0], half)
    home = halves[:n].copy()
    for j in range(1, width - half + 1):
        np.minimum(home, halves[j : j + n], out=home)
    return docs[:n][inside], pos[:n][inside], len(docs), mixed(home[inside]), *(window_hashes(h, width)[inside] for h in own)


def _probes(block: int, dealing: Dealing):
    """Anchors and probes, and anchors whose window stands twice in the chunk (hits as they are)."""

    def sent(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        ids, tags, docs, pos, home, hashes = chunk.columns()
        if not len(hashes):
            return
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        heads = np.flatnonzero(new)
        anchor = (pos % block == 0)[order]
        anchors = np.logical_or.reduceat(anchor, heads)
        single = np.diff(np.r_[heads, len(order)]) == 1
        again = np.ones(len(order), bool)
        again[order[heads[single]]] = False
        again &= pos % block == 0
        yield _straight(_by_document(ids, tags, docs[again], pos[again]), dealing.buckets)
        keep, flag = np.zeros(len(order), bool), np.zeros(len(order), np.uint32)
        keep[order[heads]] = True
        flag[order[heads]] = anchors
        short = (hashes[keep].astype(np.uint32) & np.uint32(0xFFFFFFFE)) | flag[keep]
        yield _bucketed(ids, tags, docs[keep], pos[keep], dealing.of(home[keep], hashes[keep]), [short])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        chunk = _Chunk()
        for batch in batches:
            for ids, tags, part in _rows(batch):
                docs, pos, n, home, hashes = _places(part, block, (3,))
                chunk.add(ids, tags, docs, pos, n, home, hashes)
                if chunk.words >= CHUNK_WORDS:
                    yield from sent(chunk)
        if chunk.parts:
            yield from sent(chunk)

    return run


def _answers(table: pa.Table, found) -> pa.Table:
    """Places of a bucket that ``found`` picks, and those that only pass."""
    rows = table.combine_chunks()
    passing = rows.filter(pa.compute.is_null(rows["hashes"])).select(["id", "tag", "places"])
    asked = rows.filter(pa.compute.is_valid(rows["hashes"]))
    out = [passing.cast(_HIT)]
    if len(asked):
        blobs = [_unpack(x.as_py()) for x in asked["places"]]
        picked = found(blobs, [x.as_py() for x in asked["hashes"]])
        at = 0
        for ids, tags, counts, pos in blobs:
            own = picked[at : at + len(pos)]
            at += len(pos)
            if own.any():
                docs = np.repeat(np.arange(len(ids)), counts)
                out.append(pa.Table.from_batches([_by_document(ids, tags, docs[own], pos[own])]))
    return pa.concat_tables(out)


def _anchored(blobs: list[tuple[np.ndarray, ...]], hashes: list[bytes]) -> np.ndarray:
    """Anchors whose window stands elsewhere, too. Any other window's answer is of no use: a repeated passage has an anchor of its own."""
    flagged = np.frombuffer(b"".join(hashes), np.uint32)
    order = np.argsort(flagged, kind="stable")
    ranked = flagged[order] >> 1
    same = ranked[1:] == ranked[:-1]
    picked = np.zeros(len(order), bool)
    picked[order] = np.r_[False, same] | np.r_[same, False]
    return picked & (flagged & 1).astype(bool)


def _later(blobs: list[tuple[np.ndarray, ...]], hashes: list[bytes]) -> np.ndarray:
    """Passages that are not the first of their words."""
    sizes = [len(b[3]) for b in blobs]
    h1 = np.concatenate([np.frombuffer(h, np.uint64, n) for h, n in zip(hashes, sizes, strict=True)])
    h2 = np.concatenate([np.frombuffer(h, np.uint32, n, 8 * n) for h, n in zip(hashes, sizes, strict=True)])
    ids, tags = (np.concatenate([np.repeat(b[i], b[2]) for b in blobs]) for i in (0, 1))
    return _repeats(h1, h2, ids, tags, np.concatenate([b[3] for b in blobs]))


def _repeats(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Passages whose words start earlier; rows of one text hold one place each, so none repeats the other."""
    order = np.lexsort((pos, tags, ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = (ids[order] != ids[first]) | (tags[order] != tags[first]) | (pos[order] != pos[first])
    return out


def _around(hits: pa.Array, counts: np.ndarray, bounds: np.ndarray, before: int, after: int) -> np.ndarray:
    """Words from ``before`` words before each place up to ``after`` words behind it."""
    change = np.zeros(int(bounds[-1]) + 1, np.int32)
    for i, own in enumerate(hits):
        if own.is_valid:
            at = np.frombuffer(b"".join(own.as_py()), np.int32)
            at = at[at < counts[i]]
            np.add.at(change, np.maximum(at - before, 0) + bounds[i], 1)
            np.add.at(change, np.minimum(at + after, counts[i]) + bounds[i], -1)
    return np.cumsum(change[:-1]) > 0


def _passages(width: int, block: int, dealing: Dealing):
    """Passages of ``width`` words around hits; those that stand earlier in the chunk are repeats as they are."""

    def sent(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        ids, tags, docs, pos, home, h1, h2 = chunk.columns()
        if not len(h1):
            return
        again = _repeats(h1, h2, ids[docs], tags[docs], pos)
        yield _straight(_by_document(ids, tags, docs[again], pos[again]), dealing.buckets)
        first = ~again
        yield _bucketed(ids, tags, docs[first], pos[first], dealing.of(home[first], h1[first]), [h1[first], h2[first]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        chunk = _Chunk()
        for batch in batches:
            for ids, tags, part in _rows(batch):
                bounds = part.words().bounds
                near = _around(batch.column(3).slice(part.first, part.last - part.first), np.diff(bounds), bounds, block - 1, 1)
                docs, pos, n, home, h1, h2 = _places(part, width, (4, 5))
                keep = near[bounds[docs] + pos]
                chunk.add(ids, tags, docs[keep], pos[keep], n, home[keep], h1[keep], h2[keep].astype(np.uint32))
                if chunk.words >= CHUNK_WORDS:
                    yield from sent(chunk)
        if chunk.parts:
            yield from sent(chunk)

    return run


def _kept(width: int, whole: bool):
    span = pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for ids, tags, part in _rows(batch):
                words = part.words()
                hits = batch.column(3).slice(part.first, part.last - part.first)
                gone = _around(hits, words.counts, words.bounds, 0, width)
                texts, removed, spans = [], [], []
                for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                    own = gone[a:b]
                    split = part.text(i).split()
                    if hits[i].is_valid and own.any():
                        edges = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0]))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                        split = [split[j] for j in np.flatnonzero(~own).tolist()]
                    else:
                        spans.append([])
                    removed.append(b - a - len(split))
                    texts.append(b" ".join(split))
                columns = [pa.array(ids), pa.array(tags), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))]
                names = ["id", "tag", "n_words", "n_removed", "kept_text", "removed"]
                if whole:
                    columns += [batch.column(i).slice(part.first, part.last - part.first) for i in (2, 4)]
                    names += ["text", "row"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_LAST = (1 << 63) - 1


def _key(documents: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Where a row stands: a number, a second one that tells rows of one number apart where there are such, and,
    of these two, whether the id is null. A null id has the largest number, behind a row whose id that is."""
    own = F.col(f"`{id_col}`").cast("long")
    place, text = F.coalesce(own, F.lit(_LAST)), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    if not documents.groupBy(place.alias("n")).count().where("count > 1").limit(1).count():
        none = documents.where(own.isNull()).limit(1).count()
        return place, F.lit(0).cast("long"), (F.col("id") == _LAST) & F.lit(bool(none))
    half = F.shiftright(text, 1)  # of those that share the largest number, null ids are not below 0, others are
    tag = F.when(own.isNull(), half.bitwiseAND(F.lit((1 << 62) - 1))).when(own == _LAST, half.bitwiseAND(F.lit((1 << 62) - 1)) - F.lit(1 << 62)).otherwise(text)
    return place, tag, (F.col("id") == _LAST) & (F.col("tag") >= 0)


def drop_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, whole: bool = False) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``removed`` (spans of words, from ``start`` up to before ``end``), a row for each row of ``documents``.

    Words are runs of other than ASCII white space, unchanged. A word goes if
    some ``width`` consecutive words of its text that hold it also start
    earlier: in a text of a smaller id, or before them in the same text.

    Ids are whole numbers of 64 bits. A null text has no words. A null id comes behind all others. Rows with one
    id count as texts one after another, in the order of a hash of their texts; rows
    with equal id and text count as one text, so neither repeats the other.
    Other columns are neither read nor returned, but with ``whole``: then each
    row's own columns, as they are, come with it as a struct ``row``. An empty table gives no rows.
    """
    if width < 2:
        raise ValueError("a passage has two words at least")
    block = width // 2
    size = documents.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(16, size // 6 // BUCKET_WINDOWS * 2)
    place, tag, no_id = _key(documents, id_col, text_col)
    rows = documents.select(
        place.alias("id"), tag.alias("tag"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        # all but the text, which goes along anyway; by place, whatever they are called
        F.struct(F.col(f"`{text_col}`").isNull().alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns) if c != text_col)).alias("row"),
    )
    every, rows = rows, rows.drop("row")
    probes, passages = (Dealing(buckets, hot) for hot in _hot_homes(rows, (block, width), size))
    hits = _gathered(rows.mapInArrow(_probes(block, probes), _ROW_DDL), _anchored)
    joined = rows.join(hits, ["id", "tag"]).select("id", "tag", "text", "places")
    repeats = _gathered(joined.mapInArrow(_passages(width, block, passages), _ROW_DDL), _later)
    schema = "id long, tag long, n_words long, n_removed long, kept_text string, removed array<struct<start int, end int>>"
    results = [F.when(~no_id, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_text", "removed"]
    if not whole:
        joined = rows.join(repeats, ["id", "tag"], "left").select("id", "tag", "text", "places")
        return joined.mapInArrow(_kept(width, False), schema).select(*results)
    joined = every.join(repeats, ["id", "tag"], "left").select("id", "tag", "text", "places", "row")
    out = joined.mapInArrow(_kept(width, True), StructType([*StructType.fromDDL(f"{schema}, text string"), every.schema["row"]]))
    own = [(F.when(~F.col("row.none"), F.col("text")) if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(documents.columns)]
    return out.select(*results, F.struct(*own).alias("row"))


def _gathered(sent: DataFrame, found) -> DataFrame:
    """The places that the buckets pick, in a row for each document."""
    picked = sent.groupBy("bucket").applyInArrow(lambda table: _answers(table, found), _HIT_DDL)
    return picked.groupBy("id", "tag").agg(F.collect_list("places").alias("places"))
