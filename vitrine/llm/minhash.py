"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash permutations gives two values of a shingle set,
its smallest and its largest, so a signature of 256 values takes 128 hash
evaluations a shingle. Bands of values (minima and maxima mixed) are the
buckets in which candidates meet; four bits of each value make a sketch, and
pairs that differ in too many of them are not candidates. How wide bands are
and how many values may differ follow from the likeness wanted: for independent
values either loses a pair just at it with a chance of ``LOSS`` at most (42
bands of 6 and 70 values at 0.85, 51 bands of 5 and 86 at 0.80). Every link is
confirmed on full sets.

How it scales:

* Documents with equal shingle sets are one class from the start (a partial
  aggregate), so thousands of exact copies cost one candidate.
* Each document is compared with one centre of its buckets, which joins most of
  a large group; tasks stream, holding one centre's set.
* What that leaves in different components is compared in pieces: a bucket's
  smaller components with all of its largest one, then with each other. Pieces
  of ``PIECE`` documents meet pieces, and a pair of pieces returns a spanning
  forest, first of what sketches allow, then, by matrix products over full
  sets, of links. So rows follow the number of documents and pieces, never
  that of pairs, and no block of work grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved
from vitrine.llm.components import components
from vitrine.llm.textarrays import mixed, slices, window_hashes

SHINGLE = 5
PERMUTATIONS = 128
#: The chance at most that bands, or sketches, lose a pair just at the threshold.
LOSS = 1e-8
#: Documents that are compared with one centre in a block, about.
STAR = 512
#: Documents of a piece at most, about, and shingles of all its sets.
PIECE, PIECE_SHINGLES = 1024, 1 << 20
#: Rows of ids up to which they are broadcast to the texts: a few megabytes.
BROADCAST_ROWS = 50_000

_random = np.random.Generator(np.random.PCG64(20_240))
_FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_DEAL = _random.permutation(2 * PERMUTATIONS)
_SALTS = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_NIBBLES = np.uint64(4) * np.arange(16, dtype=np.uint64)


@cache
def band_width(percent: int) -> int:
    """Values of a band: the most with which a pair of that likeness misses all bands with a chance of ``LOSS`` at most."""
    for width in range(16, 0, -1):
        if (1 - (percent / 100) ** width) ** (2 * PERMUTATIONS // width) <= LOSS:
            return width
    raise ValueError(f"256 values do not find pairs of a likeness of {percent} percent")


@cache
def sketch_limit(percent: int) -> int:
    """Of the 256 four-bit values the most that differ in candidates: more do for a pair of that likeness with a chance of ``LOSS`` at most."""
    n, q = 2 * PERMUTATIONS, (1 - percent / 100) * 15 / 16
    above, k = 0.0, n
    while above + comb(n, k) * q**k * (1 - q) ** (n - k) <= LOSS:
        above, k = above + comb(n, k) * q**k * (1 - q) ** (n - k), k - 1
        if k < 0:
            return 0
    return k


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``width`` words, A-Z lower-cased."""
    for part in slices(column):
        words = part.words()
        hashes = part.word_hashes(words, seed=2, lower=True)
        windows = window_hashes(hashes, width)
        for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            n = last - first
            if n >= width:
                yield np.unique(windows[first : last - width + 1])
            else:
                yield window_hashes(hashes[first:last], n) if n else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value under each permutation, then the largest ones."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 2048):
        values = _FACTORS[:, None] * shingles[None, i : i + 2048] + _ADDENDS[:, None]
        np.minimum(least, values.min(1), out=least)
        np.maximum(most, values.max(1), out=most)
    return np.concatenate([least, most])


def band_keys(values: np.ndarray, width: int) -> np.ndarray:
    """The buckets of a signature, one a band of ``width`` values."""
    bands = len(values) // width
    out = _SALTS[:bands].copy()
    for own in values[_DEAL[: bands * width].reshape(bands, width)].T:
        out = mixed(out ^ own)
    return out.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Four bits of each value of a signature, sixteen in a word."""
    return np.bitwise_or.reduce((mixed(values) & np.uint64(15)).reshape(-1, 16) << _NIBBLES, axis=1).view(np.int64)


def signatures(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``n_shingles``, ``k1`` and ``k2`` (128 bits of the set), ``keys`` (buckets, by bands of ``width`` values) and ``sketch``."""

    def lists(rows: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, k1, k2, keys, sketches = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                k1.append(s.sum(dtype=np.uint64))
                k2.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                values = signature(s) if len(s) else none
                keys.append(band_keys(values, width) if len(s) else none)
                sketches.append(sketch(values) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)), lists(keys), lists(sketches)],
                names=["id", "n_shingles", "k1", "k2", "keys", "sketch"],
            )

    schema = "id long, n_shingles long, k1 long, k2 long, keys array<long>, sketch array<long>"
    return documents.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _texts(documents: DataFrame, wanted: DataFrame, classes: DataFrame, *order: str) -> DataFrame:
    """``wanted`` (id, block and more) with the texts of its ids and the classes' k1, dealt by block and sorted within it by ``order``."""
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.join(classes.select("id", "k1"), "id")
    return documents.join(F.broadcast(wanted) if few else wanted, "id").select("block", *order, "id", "k1", "text").repartition("block").sortWithinPartitions("block", *order)


def _own_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and shingle set, but for rows of a class's id whose text is another (k1 tells)."""
    k1 = batch.column("k1").to_numpy().view(np.uint64)
    for i, s in enumerate(shingle_sets(batch.column("text"))):
        if s.sum(dtype=np.uint64) == k1[i]:
            yield i, s


def _stars(buckets: DataFrame) -> DataFrame:
    """``centre``, ``id`` and ``block``: each document and, of the centres of its buckets, the one that meets most others.

    A bucket's centre is its member that meets most others. The pairs of a
    centre are dealt to blocks of some hundreds.
    """
    meets = buckets.groupBy("id").agg(F.sum("n").alias("met"))
    centres = buckets.join(meets, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("best"))
    own = buckets.join(centres, "key").select("id", "n", "best").where("id <> -best.minus")
    best = own.groupBy("id").agg(F.max(F.struct("best", "n")).alias("best")).select("id", (-F.col("best.best.minus")).alias("centre"), F.ceil(F.col("best.n") / STAR).alias("parts"))
    return best.select("centre", "id", F.xxhash64("centre", "parts", F.pmod(F.xxhash64("id"), "parts")).alias("block"))


def _confirmed(stars: DataFrame, documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``stars`` whose sets are alike, as a and b. A task streams through its blocks, holding one centre's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            blocks, centres, turns, ids = (batch.column(c).to_pylist() for c in ("block", "centre", "turn", "id"))
            found = []
            for i, s in _own_sets(batch):
                if turns[i] == 0:
                    at, centre = (blocks[i], centres[i]), s
                elif at == (blocks[i], centres[i]) and _alike(centre, s, percent):
                    found.append((centres[i], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    first = stars.select(F.col("centre").alias("id"), "block", "centre", F.lit(0).alias("turn")).distinct()
    wanted = first.unionAll(stars.select("id", "block", "centre", F.lit(1).alias("turn")))
    return _texts(documents, wanted, classes, "centre", "turn").mapInArrow(run, "a long, b long")


def _pieces(size: str, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(size) / most)).cast("int")


def _dealt(rows: DataFrame, among: bool) -> DataFrame:
    """``rows`` (key, id, other, po, pb) in the blocks in which they meet: pieces of a key's others (po of them) with
    pieces of its rest (pb of them) and, with ``among``, pieces of the others with each other."""
    own = "CAST(pmod(xxhash64(id), {0}) AS int)"
    of_others = f"transform(sequence(0, pb - 1), j -> xxhash64(key, 0, {own.format('po')}, j))"
    if among:
        with_others = f"transform(sequence(0, po - 1), j -> xxhash64(key, IF(po + pb = 2, 0, 1), least({own.format('po')}, j), greatest({own.format('po')}, j)))"
        of_others = f"array_distinct(concat(IF(pb > 0, {of_others}, CAST(array() AS array<bigint>)), {with_others}))"
    of_rest = f"transform(sequence(0, po - 1), i -> xxhash64(key, 0, i, {own.format('pb')}))"
    return rows.withColumn("block", F.explode_outer(F.expr(f"IF(other, {of_others}, {of_rest})"))).where("block IS NOT NULL").drop("key", "other", "po", "pb")


class _Forest:
    """Components of a block's rows as they grow; a link is told only if it joins two."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def links(self, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
        root, out = self.root, []
        new = root[p] != root[q]
        for x, y in zip(p[new].tolist(), q[new].tolist(), strict=True):
            a, b = x, y
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))
        if out:
            while (root[root] != root).any():
                root[:] = root[root]
        return out


def _whole_blocks(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.Table]:
    """Rows sorted by block, in tables of ``least`` rows or more that hold whole blocks."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        rows += len(batch)
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        if len(cuts) and rows >= least:
            last = int(cuts[-1])
            yield pa.Table.from_batches([*waiting[:-1], batch.slice(0, last)])
            waiting, rows = [batch.slice(last)], len(batch) - last
    if waiting:
        yield pa.Table.from_batches(waiting)


def _candidates(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A spanning forest, a and b, of pairs in a block of ``rows`` (block, id, label) that have different labels and that sizes and sketches do not tell apart."""
    limit = sketch_limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, 5_000):
            blocks, ids, labels, sizes = (table.column(c).to_numpy() for c in ("block", "id", "label", "n_shingles"))
            sketches = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            forest, found = _Forest(len(ids)), []
            for d in range(1, len(ids)):
                p = np.flatnonzero(blocks[:-d] == blocks[d:])
                if not len(p):
                    break
                for at in range(0, len(p), 16_384):
                    x = p[at : at + 16_384]
                    y = x + d
                    fits = (labels[x] != labels[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])) & (forest.root[x] != forest.root[y])
                    x, y = x[fits], y[fits]
                    for words in (4, 16):  # a quarter tells most apart
                        near = _differing(sketches[x, :words], sketches[y, :words]) <= limit
                        x, y = x[near], y[near]
                    found += forest.links(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(ids[[f[j] for f in found]] if found else [], pa.int64()) for j in (0, 1)], names=["a", "b"])

    sent = rows.join(classes.select("id", "n_shingles", "sketch"), "id").select("block", "id", "label", "n_shingles", "sketch")
    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many four-bit values differ."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def shared_counts(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with all sets: a matrix product for values in many sets, pairs of places for those in few."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(code, minlength=len(values))
    row_of = np.full(n, -1)
    row_of[rows] = np.arange(len(rows))
    out = np.zeros((len(rows), n), np.int64)
    dense = np.flatnonzero(held > max(8, n // 16))
    column = np.full(len(values), -1)
    column[dense] = np.arange(len(dense))
    own = column[code]
    for first in range(0, len(dense), 4096):
        inside = (own >= first) & (own < first + 4096)
        matrix = np.zeros((n, min(4096, len(dense) - first)), np.float32)
        matrix[owner[inside], own[inside] - first] = 1
        out += np.rint(matrix[rows] @ matrix.T).astype(np.int64)
    few = np.flatnonzero((own < 0) & (held[code] > 1))
    few = few[np.argsort(code[few], kind="stable")]
    codes, owners = code[few], owner[few]
    flat = out.reshape(-1)
    for d in range(max(8, n // 16)):
        p = np.flatnonzero(codes[: len(codes) - d] == codes[d:]) if d else np.arange(len(codes))
        if not len(p):
            break
        x, y = owners[p], owners[p + d]
        for a, b in ((x, y), (y, x)) if d else ((x, y),):
            at = row_of[a] >= 0
            np.add.at(flat, row_of[a][at] * n + b[at], 1)
    return out


def _linked_labels(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different labels of a block's sets."""
    names, own, size = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    rows = np.flatnonzero(own != size.argmax())  # every pair of two labels has one of these
    both, sizes = shared_counts(sets, rows), np.array([len(s) for s in sets])
    forest, out = _Forest(len(names)), []
    for i, r in enumerate(rows.tolist()):
        near = np.flatnonzero((100 * both[i] >= percent * (sizes[r] + sizes - both[i])) & (own != own[r]))
        out += forest.links(np.full(len(near), own[r]), own[near])
    return [(int(names[x]), int(names[y])) for x, y in out]


def _links(forest: DataFrame, labels: DataFrame, documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links, a and b, between labels of documents that a cluster of candidates holds: all pairs of different labels in it, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            blocks, names = table.column("block").to_numpy(), table.column("label").to_numpy()
            rows: dict[int, list[np.ndarray]] = {}
            owners: dict[int, list[int]] = {}
            at = 0
            for batch in table.to_batches():
                for i, s in _own_sets(batch):
                    rows.setdefault(int(blocks[at + i]), []).append(s)
                    owners.setdefault(int(blocks[at + i]), []).append(names[at + i])
                at += len(batch)
            found = [x for b, sets in rows.items() for x in _linked_labels(sets, np.array(owners[b]), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    own = components(forest).withColumnsRenamed({"node": "id", "component": "key"}).join(labels, "id")
    own = own.join(classes.select("id", F.greatest("n_shingles", F.lit(PIECE_SHINGLES // PIECE)).alias("weight")), "id")
    own = saved(own)
    largest = own.groupBy("key", "label").agg(F.sum("weight").alias("w")).groupBy("key").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("w"))
    sizes = largest.select("key", F.col("top.label").alias("most"), F.col("top.w").alias("wb"), (F.col("w") - F.col("top.w")).alias("wo"))
    rows = own.join(sizes, "key").select("key", "id", "label", (F.col("label") != F.col("most")).alias("other"), _pieces("wo", PIECE_SHINGLES).alias("po"), _pieces("wb", PIECE_SHINGLES).alias("pb"))
    return _texts(documents, _dealt(rows, among=True), classes, "label").mapInArrow(run, "a long, b long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    named = components(links).select(F.col("node").alias("label"), "component")
    return saved(labels.join(named, "label", "left").select("id", F.coalesce("component", "label").alias("label")))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept``, a row for each row of ``documents``.

    Documents are linked if 100 * |A and B| >= ``percent`` * |A or B| for their
    sets of five-word shingles (fewer words: the whole sequence is the one
    shingle); ``component_id`` is the smallest id that links reach.

    Null texts and texts without words have the empty set and are linked with
    nothing. Rows with one id count as one node: what either is linked with,
    both are. A row whose id is null is its own component, null, and kept.
    Other columns are neither read nor returned; an empty table gives no rows.
    A ``percent`` beyond 1 to 100, or too low for 256 values to find its pairs, is refused.
    """
    if not 1 <= percent <= 100:
        raise ValueError("a percentage from 1 to 100")
    signed = saved(signatures(documents, id_col, text_col, band_width(percent)))
    one = F.min(F.struct("id", "n_shingles", "keys", "sketch")).alias("one")
    classes = saved(signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(one).select("k1", "k2", "one.*"))
    plain = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    buckets = classes.select("id", F.explode("keys").alias("key"))
    many = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = saved(buckets.join(many, "key"))

    labels = buckets.select("id").distinct().withColumn("label", F.col("id"))
    labels = _relabelled(labels, _confirmed(saved(_stars(buckets)), plain, classes, percent))

    # a bucket's largest component, and its members of others
    entries = buckets.join(labels, "id").select("key", "id", "label")
    largest = entries.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
    others = entries.join(largest.where("labels > 1").select("key", F.col("top.label").alias("most")), "key").where("label <> most")
    others = saved(others)

    # those against all of that component
    asked = saved(others.select(F.col("most").alias("key"), "id", "label").distinct())
    sizes = asked.groupBy("key").agg(F.count("*").alias("no")).join(labels.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("nb")), "key")
    sizes = sizes.select("key", _pieces("no", PIECE).alias("po"), _pieces("nb", PIECE).alias("pb"))
    rest = labels.select(F.col("label").alias("key"), "id", "label").join(sizes, "key").withColumn("other", F.lit(False))
    rows = asked.join(sizes, "key").withColumn("other", F.lit(True)).unionByName(rest)
    labels = _settled(_dealt(rows, among=False), labels, plain, classes, percent)

    # and against each other, where they are still of different ones
    others = others.select("key", "id").join(labels, "id")
    apart = others.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("no")).where("low < high")
    rows = others.join(apart.select("key", _pieces("no", PIECE).alias("po"), F.lit(0).alias("pb")), "key").withColumn("other", F.lit(True))
    labels = _settled(_dealt(rows, among=True), labels, plain, classes, percent)
    return _described(signed, classes, labels, id_col)


def _settled(rows: DataFrame, labels: DataFrame, documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``labels`` with those joined that have a link in some block of ``rows``."""
    forest = saved(_candidates(rows, classes, percent))
    if not forest.limit(1).count():
        return labels
    return _relabelled(labels, _links(forest, labels, documents, classes, percent))


def _described(signed: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    rows = signed.select("id", "n_shingles", "k1", "k2")
    first = classes.select("k1", "k2", F.col("id").alias("first_id")).join(labels.select(F.col("id").alias("first_id"), "label"), "first_id", "left")
    members = rows.where("n_shingles > 0 AND id IS NOT NULL").join(first, ["k1", "k2"])
    named = members.select("id", F.coalesce("label", "first_id").alias("component"))
    # an id with several texts joins their components into one
    if rows.groupBy("id").count().where("count > 1 AND id IS NOT NULL").limit(1).count():
        joined = components(named, "id", "component")
        named = named.join(joined.withColumnsRenamed({"node": "id", "component": "least"}), "id", "left").select("id", F.coalesce("least", "component").alias("component"))
    named = named.distinct().groupBy("id").agg(F.min("component").alias("component"))
    out = rows.join(named, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(f"`{id_col}`"), F.lit(True)))
