"""Documents drawn by importance towards a target: hashed n-gram weights and Gumbel noise.

Features are runs of one to three words. They go, with the documents they stand
in, to the partition of a dictionary of distinct strings; there each is counted
over all documents and over the target, and hashed once. Bucket totals give
gains, and gains come back over the dictionary to the counts of each document.

To keep what is shuffled small, a task gathers slices of some megabytes: a
distinct string of a slice goes once, as numbers of words in a list that goes
with them, with the documents that hold it and how often. A string of three
words stands for the run of its last two as well, so both go to the partition
of those two. Strings with a large part of a slice's words go to several
partitions in turn: each counts its part, and bucket totals add up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved
from vitrine.llm.textarrays import give_back

BUCKETS = 10_000
#: Bytes and documents of a slice at most; a longer text goes in pieces. So a slice has under 2^21 distinct words: few have under three bytes, and a gap stands behind each.
SLICE_BYTES = 4_000_000
SLICE_DOCS = 1 << 16
#: Bytes of text for a partition of the dictionary.
PART_BYTES = 24 << 20
#: A partition's dictionary is made in so many parts, one after another.
SHARES = 4
#: A word, or a run of two, that is more than this part of a slice has its strings dealt over FAN partitions.
COMMON = 1024
FAN = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


@dataclass
class _Slice:
    """Texts of documents that follow one another; the first ``before`` words belong to the piece before and only stand before others."""

    first: int
    ids: pa.Array
    data: np.ndarray
    offsets: np.ndarray
    before: int = 0

    def words(self) -> tuple[pa.Array, np.ndarray]:
        """All words, and the number of each document's."""
        data = _LOWER[self.data]
        inside = _INSIDE[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        at = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[at] = inside[at]
        last = at[at > 0] - 1
        ends[last] = inside[last]
        starts = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - starts
        places = np.append(0, np.cumsum(sizes)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))])
        return words, np.diff(np.searchsorted(starts, self.offsets))


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Slice]:
    document = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1), at + SLICE_DOCS)
            own = data[offsets[at] : offsets[end]]
            if len(own) <= most:
                yield _Slice(document + at, batch.column(0).slice(at, end - at), own, offsets[at : end + 1] - offsets[at])
            else:
                yield from _cut(document + at, batch.column(0).slice(at, 1), own, most)
            at = end
        document += len(texts)


def _cut(document: int, key: pa.Array, data: np.ndarray, most: int) -> Iterator[_Slice]:
    """A long text in pieces, cut between words; each begins with the last two words of the one before."""
    gaps = np.flatnonzero(~_INSIDE[_LOWER[data]])
    tail, before, at = np.zeros(0, np.uint8), 0, 0
    while at < len(data):
        near = np.searchsorted(gaps, at + most)
        end = int(gaps[near]) if near < len(gaps) else len(data)
        piece = np.concatenate([tail, data[at:end]])
        own = _Slice(document, key, piece, np.array([0, len(piece)]), before)
        yield own
        last = own.words()[0][-2:].to_pylist()
        tail, before, at = np.frombuffer(b"".join(w + b" " for w in last), np.uint8), len(last), end


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _packed(x: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
    return zstandard.compress(bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes(), 3)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, those upwards as even and those downwards as odd numbers: small ones, where ``x`` is in order."""
    step = np.diff(x, prepend=0)
    return np.where(step < 0, -2 * step - 1, 2 * step)


def _from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(x & 1, -(x + 1) // 2, x // 2))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number the place of its value among distinct values, and these; by sorting, which takes less memory than a table."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    places = np.empty(len(x), np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - 1
    return places, x[new]


def _shifts(most: int = 255) -> np.ndarray:
    """For each length, what as many zero bytes make of each byte of a crc32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (step >> 1)
    own = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    out = [own]
    for _ in range(most):
        own = step[own & 0xFF] ^ (own >> 8)
        out.append(own)
    return np.array(out)


_SHIFTS = _shifts()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of strings from those of their two parts, the second of which has ``length`` bytes."""
    out = second.astype(np.uint32)
    for at in range(0, len(out), 1 << 18):
        some = slice(at, at + (1 << 18))
        crc, left = first[some].astype(np.uint32), length[some].copy()
        while left.any():
            now = np.minimum(left, len(_SHIFTS) - 1)
            crc = _SHIFTS[now, 0, crc & 0xFF] ^ _SHIFTS[now, 1, crc >> 8 & 0xFF] ^ _SHIFTS[now, 2, crc >> 16 & 0xFF] ^ _SHIFTS[now, 3, crc >> 24]
            left -= now
        out[some] ^= crc
    return out


_ENTRIES = "part int, first long, target boolean, ids array<{id}>, sizes array<int>, words binary, w1 binary, w2 binary, w3 binary, holders binary, docs binary, counts binary"
_NAMES = [c.split()[0] for c in _ENTRIES.split(", ")]


def _features(parts: int, target: bool, id_type: pa.DataType, slice_bytes: int):
    """For each slice a row with its documents, and a row for each partition of the dictionary that its strings go to."""
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.list_(id_type), pa.list_(pa.int32()), *[pa.binary()] * 7]

    def rows(own: _Slice) -> Iterator[tuple]:
        words, sizes = own.words()
        if not target:
            counted = sizes.copy()
            counted[0] -= own.before
            yield int(_spread(np.uint64([own.first]))[0] % np.uint64(parts)), own.first, target, own.ids.to_pylist(), counted.astype(np.int32), *[None] * 7
        if len(words) <= own.before:
            return
        encoded = words.dictionary_encode()
        order = pa.compute.array_sort_indices(encoded.dictionary).to_numpy()
        vocabulary = encoded.dictionary.take(pa.array(order)).to_pylist()
        ended = pa.array([w + b"\n" for w in vocabulary], pa.binary())
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        last = number[encoded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        one, two = np.zeros_like(last), np.zeros_like(last)  # the words before, if they are of the same document
        one[1:] = np.where(doc[1:] == doc[:-1], last[:-1], 0)
        two[2:] = np.where(doc[2:] == doc[:-2], last[:-2], 0)
        live = slice(own.before, None)
        last, one, two, doc = last[live], one[live], two[live], doc[live]
        more, n = one > 0, len(last)
        keys = np.concatenate([last << 42, (last << 42 | one << 21 | two)[more]])  # 21 bits a word
        doc = np.concatenate([doc, doc[more]])
        del last, one, two, more
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        pairs = (np.cumsum(new) - 1) << 16 | doc[order]  # a string and a document
        keys = keys[new]
        pairs.sort()
        new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        counts, pairs = np.diff(np.append(new, len(pairs))), pairs[new]
        docs, holders = pairs & 0xFFFF, np.bincount(pairs >> 16, minlength=len(keys))
        starts = np.append(0, np.cumsum(holders)[:-1])
        total = np.add.reduceat(counts, starts)
        w3, w2, w1 = keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF
        # where strings go: by their last two words, the common ones by more
        marks = np.append(np.uint64(0), _spread(np.fromiter(map(zlib.crc32, vocabulary), np.uint64, len(vocabulary)) + np.uint64(1)))
        tails = np.flatnonzero(np.append(True, (keys >> 21)[1:] != (keys >> 21)[:-1]))
        common = np.repeat(np.add.reduceat(total, tails) * COMMON > n, np.diff(np.append(tails, len(keys))))
        fan = np.where(common, (marks[w1] + np.uint64(own.first & 0xFFFF) + np.uint64(own.first >> 40)) % np.uint64(FAN), np.uint64(0))
        part = (_spread(marks[w3] * np.uint64(3) + marks[w2] + fan * np.uint64(0x2545F4914F6CDD1D)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        bounds = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
        for members in np.split(order, bounds[1:]):
            used = np.zeros(len(vocabulary) + 1, bool)
            for w in (w1, w2, w3):
                used[w[members]] = True
            used[0] = False
            local = np.cumsum(used)
            local[0] = 0
            blob = zstandard.compress(_bytes(ended.take(pa.array(np.flatnonzero(used) - 1))), 3)
            held = holders[members]
            at = np.repeat(starts[members] - np.append(0, np.cumsum(held)[:-1]), held) + np.arange(held.sum())
            yield int(part[members[0]]), own.first, target, None, None, blob, *(_packed(x) for x in (local[w1[members]], _steps(local[w2[members]]), _steps(local[w3[members]]), held, docs[at], counts[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, slice_bytes):
            for row in rows(own):
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=_NAMES)
            give_back()

    return run


def _bytes(words: pa.Array) -> memoryview:
    _, places, data = words.buffers()
    ends = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1]
    return memoryview(data)[int(ends[0]) : int(ends[-1])]


def _words(blob: bytes) -> pa.Array:
    """Words of a list, each with the line's end behind it."""
    data = zstandard.decompress(blob)
    places = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])


class _Dictionary:
    """Distinct strings of a partition: words, runs of two, and runs of three as a word before a run of two.

    ``word``, ``two`` and ``three`` have for each row of entries in turn its
    places in these (-1: none), once ``shares`` has come to it.
    """

    def __init__(self, rows: list[_Row]) -> None:
        lists = [_words(r["words"]) for r in rows]
        encoded = pa.concat_arrays(lists).dictionary_encode()
        self.words, self.word_hashes = encoded.dictionary, None
        numbers = np.append(encoded.indices.to_numpy(), np.int32(-1))
        firsts = np.cumsum([0, *map(len, lists)])
        del lists, encoded
        sizes = [len(_unpacked(r["w1"])) for r in rows]
        self.ends = np.cumsum(sizes)
        self.ids = np.empty((3, sum(sizes)), np.int32)
        for row, first, end, n in zip(rows, firsts, self.ends, sizes, strict=False):
            for i, x in enumerate((_unpacked(row["w1"]), _from_steps(_unpacked(row["w2"])), _from_steps(_unpacked(row["w3"])))):
                self.ids[i, end - n : end] = np.where(x > 0, numbers[first + x - 1], np.int32(-1))

    def shares(self) -> Iterator[np.ndarray]:
        """Places of entries, a part of them at a time; all that end in the same two words (or one) come together."""
        share = (self.ids[1].astype(np.uint32) * np.uint32(2654435761) + self.ids[2].astype(np.uint32)) % np.uint32(SHARES)
        for i in range(SHARES):
            own = np.flatnonzero(share == i)
            w1, w2, w3 = (x[own] for x in self.ids)
            two, three = w2 >= 0, w1 >= 0
            self.word = np.where(two, np.int32(-1), w3)
            self.two, self.three = np.full(len(w3), -1, np.int32), np.full(len(w3), -1, np.int32)
            self.two[two], self.pairs = _distinct(w2[two].astype(np.int64) << 32 | w3[two])
            self.three[three], self.triples = _distinct(self.two[three].astype(np.int64) << 32 | w1[three])
            yield own

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """crc32 of each distinct string: of words, then of runs by the words'."""
        sizes = pa.compute.binary_length(self.words).to_numpy()  # with a byte for the gap
        if self.word_hashes is None:
            ended = (w.as_py() for w in self.words)
            self.word_hashes = np.fromiter((zlib.crc32(w[:-1]) for w in ended), np.uint32, len(self.words))
        word = self.word_hashes
        gap = np.full(len(word), zlib.crc32(b" "), np.uint32)
        before = joined_crc(word, gap, np.ones(len(word), np.int32))
        w2, w3 = (self.pairs >> 32).astype(np.int32), self.pairs.astype(np.int32)
        pair = joined_crc(before[w2], word[w3], sizes[w3] - 1)
        w1, tail = self.triples.astype(np.int32), (self.triples >> 32).astype(np.int32)
        triple = joined_crc(before[w1], pair[tail], (sizes[w2] + sizes[w3] - 1)[tail])
        return word, pair, triple

    def kinds(self) -> list[tuple[np.ndarray, int]]:
        return [(self.word, len(self.words)), (self.two, len(self.pairs)), (self.three, len(self.triples))]


class _Row:
    """A row of a batch, whose cells are copied only when they are asked for."""

    def __init__(self, batch: pa.RecordBatch, at: int) -> None:
        self.batch, self.at = batch, at

    def __getitem__(self, name: str):
        return self.batch.column(name)[self.at].as_py()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Row]:
    for batch in batches:
        yield from (_Row(batch, i) for i in range(batch.num_rows))


def _counted(buckets: int):
    """A partition's dictionary, counted and hashed; then its totals by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for r in _rows(batches) if r["words"] is not None]
        if not rows:
            return
        held = _Dictionary(rows)
        numbers = []
        for row in rows:
            holders = _unpacked(row["holders"])
            numbers.append(np.add.reduceat(_unpacked(row["counts"]), np.cumsum(holders) - holders).astype(np.int32))  # of a slice, so small
        number = np.concatenate(numbers)
        target = np.repeat([r["target"] for r in rows], [len(n) for n in numbers])
        del rows, numbers
        totals = np.zeros((2, buckets), np.int64)
        for share in held.shares():
            for (codes, n), hashes in zip(held.kinds(), held.hashes(), strict=True):
                for side in np.unique(target).astype(int):
                    own = (codes >= 0) & (target[share] == side)
                    sums = np.zeros(n, np.int64)
                    np.add.at(sums, codes[own], number[share[own]])
                    np.add.at(totals[side], hashes % np.uint32(buckets), sums)
        used = np.flatnonzero(totals.any(0))
        del held, number, target
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[0, used]), pa.array(totals[1, used])], names=["bucket", "s", "t"])

    return run


def _weighed(id_type: pa.DataType):
    """The gains of a partition's strings back to the documents of each slice."""
    types = [pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["first", "ids", "sizes", "docs", "weights"]

    def one(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, rows = np.zeros(0, np.int64), []
        for batch in batches:
            if not len(gains) and batch.num_rows:
                gains = batch.column("gains")[0].values.to_numpy().astype(np.int64)
            for row in _rows([batch.drop_columns(["gains"])]):
                if row["words"] is None:
                    yield one(row["first"], row["ids"], row["sizes"], None, None)
                elif not row["target"]:
                    rows.append(row)
        if not rows:
            return
        held = _Dictionary(rows)
        gain = np.zeros(held.ids.shape[1], np.int64)
        for share in held.shares():
            gain[share] = sum(np.append(gains[hashes % np.uint32(len(gains))], 0)[codes] for (codes, _), hashes in zip(held.kinds(), held.hashes(), strict=True))
        for row, own in zip(rows, np.split(gain, held.ends[:-1]), strict=True):
            docs = _unpacked(row["docs"])
            total = np.zeros(docs.max() + 1, np.int64)
            np.add.at(total, docs, np.repeat(own, _unpacked(row["holders"])) * _unpacked(row["counts"]))
            there = np.unique(docs)
            yield one(row["first"], None, None, there.astype(np.int32), total[there])
        del held, gain, rows
        give_back()

    return run


def _gathered(id_type: pa.DataType):
    """Weights of a slice's documents from all partitions, with ids and numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, ids, sizes, docs, weights in zip(*(batch.column(c) for c in ["first", "ids", "sizes", "docs", "weights"]), strict=True):
                first = first.as_py()
                if ids.is_valid:
                    n = len(ids)
                    numbers = pa.array(np.arange(first, first + n))
                    yield pa.RecordBatch.from_arrays([numbers, ids.values.cast(id_type), sizes.values.cast(pa.int64()), pa.array(np.zeros(n, np.int64))], names=["document", "id", "words", "weight"])
                else:
                    at, add = docs.values.to_numpy(), weights.values.to_numpy()
                    own = sums.get(first)
                    if own is None or len(own) <= at[-1]:
                        grown = np.zeros(int(at[-1]) + 1, np.int64)
                        if own is not None:
                            grown[: len(own)] = own
                        own = sums[first] = grown
                    own[at] += add
        for first, own in sums.items():
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.nulls(n, id_type), pa.array(np.zeros(n, np.int64)), pa.array(own)], names=["document", "id", "words", "weight"])

    return run


def weights(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_text: str = "text", buckets: int = BUCKETS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``document`` (a number of the row), ``id``, ``words`` and ``weight``: the sum of the gains of its features, each as often as it stands there."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    key, text = F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    rows = documents.select(key, text)
    id_name, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, size // PART_BYTES)
    wanted = target.select(F.lit(None).cast(id_name).alias("id"), F.col(f"`{target_text}`").cast("string").alias("text"))
    schema = _ENTRIES.format(id=id_name)
    entries = rows.mapInArrow(_features(parts, False, id_type, slice_bytes), schema).unionAll(wanted.mapInArrow(_features(parts, True, id_type, slice_bytes), schema)).repartitionById(parts, "part")  # not by the number's hash, which would put several into one task

    counts = entries.mapInArrow(_counted(buckets), "bucket int, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    by_bucket = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = by_bucket.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("each"))
    ratio = lambda x: (x["t"] + 1).cast("double") * (F.col("all_s") + buckets) / ((x["s"] + 1).cast("double") * (F.col("all_t") + buckets))
    gains = whole.select(F.transform("each", lambda x: F.floor(1000 * F.log(ratio(x))).cast("int")).alias("gains"))  # one row of as many numbers as buckets

    back = entries.select("*", gains.scalar().alias("gains")).mapInArrow(_weighed(id_type), f"first long, ids array<{id_name}>, sizes array<int>, docs array<int>, weights array<long>")
    gathered = back.repartition(parts, "first").mapInArrow(_gathered(id_type), f"document long, id {id_name}, words long, weight long")
    return gathered.groupBy("document").agg(F.max("id").alias("id"), F.sum("words").alias("words"), F.sum("weight").alias("weight"))


def resampled(
    documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` of each row of ``documents``.

    ``percent`` of the documents with ``least_words`` words or more are drawn,
    those of highest score (ties: the smaller id, null ids last); ``rank`` is
    their place, null for others. A null or empty text has no features and
    weight 0. The noise follows from seed and id (of a null id, from the
    empty text), so rows of one id and text have one score and ranks of their
    own. Ids may be of any type with an order. An empty target gives gains
    all the same; an empty table gives no rows. Other columns are neither read
    nor returned.
    """
    found = weights(documents, target, id_col, text_col, target_text=target_text, buckets=buckets, slice_bytes=slice_bytes)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    less = lambda n: F.greatest(F.col("words") - n, F.lit(0))
    scored = saved(found.select("document", "id", "words", (less(0) + less(1) + less(2)).alias("n_features"), "weight", (F.col("weight") + noise).alias("score")))
    able = F.col("words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    # the place of a row: rows of the partitions before it, and its place inside
    ordered = saved(scored.where(able).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "document")).withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("slice", F.shiftright("at", 33)).withColumn("inside", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ordered.groupBy("slice").agg(F.count("*").alias("n"))
    starts = sizes.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a partition
    place = F.col("start") + F.col("inside") + 1
    names = ["id", "n_features", "weight", "score"]
    ranked = ordered.join(F.broadcast(starts), "slice").select(*names, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionAll(scored.where(~able).select(*names, F.lit(None).cast("long"))).toDF(id_col, *names[1:], "rank")
