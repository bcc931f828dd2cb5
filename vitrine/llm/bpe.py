"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

Merges run on contiguous rank arrays: a word's parts and the rank of each
adjacent pair stand side by side; the smallest rank is found by a scan, the
boundary behind it deleted and the two neighbouring ranks looked up anew.
Words of one length are rows of one matrix, so numpy does each round for all
of them; words of over ``SHORT`` bytes go one by one through a heap.

Words repeat, so a task keeps what it has encoded, up to ``CACHE_RUNS``; past
that it keeps those of the slice at hand.

Null or empty texts give no ids and the empty text. Null ids decode to the
empty text, ids that the vocabulary lacks to nothing. Rows are independent: repeated rows
give repeated results, and other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_RUNS = 200_000
#: Characters of text that are worked on and returned at a time, and ids.
SLICE, SLICE_IDS = 1 << 19, 1 << 17
#: Bytes of a word up to which it is encoded with others of its length.
SHORT = 64
#: The rank of a pair that never merges.
NEVER = 1 << 30

#: The bytes that byte-level vocabularies show as themselves, and Unicode's white space.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    others = iter(range(256, 512))
    plain = set(_PLAIN)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE with word ends, as the vocabulary file describes it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        #: The rank of a pair of ids, first << 32 | second, and the id of the merged part by rank.
        self.rank: dict[int, int] = {}
        merged = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            merged.append(vocab[a + b])
        self.merged = np.array(merged, np.int64)
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        #: The id of each byte inside a word and at its end.
        self.alone = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.ending = np.array([vocab[c + suffix] for c in byte_characters()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(split["pattern"]["Regex"].replace("\\s", _SPACE))
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.cache: dict[str, bytes] = {}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        texts = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        #: Every token's text and a space behind it, end to end, and where each begins.
        self.shown = np.frombuffer(b"".join(texts), np.uint8)
        self.begins = np.cumsum([0, *map(len, texts)])

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as packed 32-bit integers."""
        by_length, out = defaultdict(list), {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if len(b) <= SHORT:
                by_length[len(b)].append((w, b))
            else:
                out[w] = np.array(self._long_word(b), np.int32).tobytes()
        for length, own in by_length.items():
            marks = np.frombuffer(b"".join(b for _, b in own), np.uint8).reshape(-1, length)
            parts = self.alone[marks]
            parts[:, -1] = self.ending[marks[:, -1]]
            rows, ranks = np.arange(len(own)), self._pair_ranks(parts[:, :-1], parts[:, 1:])
            while len(rows):
                if ranks.shape[1]:
                    i = ranks.argmin(1)
                    best = ranks[np.arange(len(rows)), i]
                    going = best < NEVER
                else:
                    going = np.zeros(len(rows), bool)
                for r, ids in zip(rows[~going].tolist(), parts[~going].astype(np.int32), strict=True):
                    out[own[r][0]] = ids.tobytes()
                rows, parts, ranks = rows[going], parts[going], ranks[going]
                if len(rows):
                    i, best = i[going], best[going]
                    parts, ranks = self._merge(parts, ranks, i, self.merged[best])
        return out

    def _merge(self, parts: np.ndarray, ranks: np.ndarray, i: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each row the parts i and i + 1 become one; the ranks beside it are looked up anew."""
        n, width = parts.shape
        parts[np.arange(n), i] = now
        parts = parts[np.arange(width) != (i + 1)[:, None]].reshape(n, width - 1)
        ranks = ranks[np.arange(width - 1) != i[:, None]].reshape(n, width - 2)
        for rows, at in ((np.flatnonzero(i > 0), i - 1), (np.flatnonzero(i < width - 2), i)):
            left = at[rows]
            ranks[rows, left] = self._pair_ranks(parts[rows, left], parts[rows, left + 1])
        return parts, ranks

    def _long_word(self, text: bytes) -> list[int]:
        marks = np.frombuffer(text, np.uint8)
        parts = self.alone[marks].tolist()
        parts[-1] = int(self.ending[marks[-1]])
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(parts)) if (r := self.rank.get(a << 32 | b, NEVER)) < NEVER]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := self.rank.get(parts[left] << 32 | parts[right], NEVER)) < NEVER:
                    heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    @staticmethod
    def normal(text: str) -> str:
        """Composed and lower-cased; white space stays, as it only parts pieces."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased a character at a time, without regard to its place
                return "".join(c.lower() for c in text)
        return text.lower()

    def runs(self, text: str) -> list[str]:
        """What stands between white space. str.split also parts at four control characters, which are none."""
        text = self.normal(text)
        return self.spaces.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def text_runs(self, text: str) -> list[str]:
        """Runs of a whole text. A special token stands as a run with a zero character before it, which no other run ends in."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.runs(text)
        return [r for part in self.cut.split(text) for r in ([part + "\0special"] if part in self.special else self.runs(part))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        split = [self.text_runs(t) for t in texts]
        wanted = set().union(*split) if split else set()
        missing = [r for r in wanted if r not in self.cache]
        if len(self.cache) + len(missing) > CACHE_RUNS:
            self.cache = {r: self.cache[r] for r in wanted if r in self.cache}
        pieces = {r: [r] if r.isalpha() else self.pieces.findall(r) for r in missing if not r.endswith("\0special")}
        ids = self.words(list({w for p in pieces.values() for w in p}))
        self.cache.update((r, b"".join([ids[w] for w in p])) for r, p in pieces.items())
        self.cache.update((r, np.array([self.special[r.removesuffix("\0special")]], np.int32).tobytes()) for r in missing if r not in pieces)
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts end to end and their bounds; ``bounds`` has the same of the ids."""
        known = (ids >= 0) & (ids < len(self.begins) - 1)
        ids = np.where(known, ids, 0)
        lengths = np.where(known, self.begins[ids + 1] - self.begins[ids], 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        jumps = np.repeat(self.begins[ids] - ends[:-1], lengths)
        out, cuts = self.shown[jumps + np.arange(ends[-1])], ends[bounds]
        some = np.flatnonzero(np.diff(cuts))  # texts lose the space at their end
        keep = np.ones(len(out), bool)
        keep[cuts[some + 1] - 1] = False
        lost = np.zeros(len(bounds), np.int64)
        lost[some + 1] = 1
        return out[keep], cuts - np.cumsum(lost)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode()


@lru_cache(2)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(f"`{n}`") for n in names))


_IDS = pa.list_(pa.field("element", pa.int32(), nullable=False))


def _encoded(bpe: WordBpe, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """For each slice of the texts its first row and the lists of ids."""
    own: list[str] = []
    size = first = 0
    for i, cell in enumerate(texts):
        own.append(cell.as_py() or "")
        size += len(own[-1])
        if size >= SLICE or i + 1 == len(texts):
            packed = bpe.encode_all(own)
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield first, pa.ListArray.from_arrays(pa.array(offsets), values, type=_IDS)
            own, size, first = [], 0, i + 1
    pa.default_memory_pool().release_unused()


def _decoded(bpe: WordBpe, lists: pa.Array) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """For each slice of the lists its first row, the lists and their texts."""
    sizes = np.array([0, *lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]).cumsum()
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + SLICE_IDS, "right")) - 1)
        own = lists.slice(first, last - first)
        ids = own.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
        data, bounds = bpe.decode_all(ids, sizes[first : last + 1] - sizes[first])
        texts = pa.Array.from_buffers(pa.large_string(), last - first, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        yield first, own, texts.cast(pa.string())
        first = last


def encode(documents: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int), a row for each row of ``documents``.

    ``path`` is the vocabulary file's place on every executor, or a function
    that gives it there.
    """
    field = documents.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path() if callable(path) else path)
        for batch in batches:
            for first, ids in _encoded(bpe, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), ids], names=[field.name, "ids"])

    schema = T.StructType([T.StructField(field.name, field.dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return _columns(documents, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (the tokens joined by one space, as a file without a decoder asks)."""
    field = encoded.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path() if callable(path) else path)
        for batch in batches:
            for first, own, texts in _decoded(bpe, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(own)), own, texts], names=[field.name, ids_col, "decoded"])

    schema = T.StructType([T.StructField(field.name, field.dataType), T.StructField(ids_col, encoded.schema[ids_col].dataType), T.StructField("decoded", T.StringType())])
    return _columns(encoded, id_col, ids_col).mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` gives of what ``encode`` gives, by one Python worker a task instead of two."""
    field = documents.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path() if callable(path) else path)
        for batch in batches:
            for at, ids in _encoded(bpe, batch.column(1)):
                for first, own, texts in _decoded(bpe, ids):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at + first, len(own)), own, texts], names=[field.name, "ids", "decoded"])

    schema = T.StructType([T.StructField(field.name, field.dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    return _columns(documents, id_col, text_col).mapInArrow(run, schema)
