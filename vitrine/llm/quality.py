"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from numpy passes over Arrow columns. Training
data are the statistics of at most ``SAMPLE_ROWS`` labelled documents (those
with the smallest hashes of their ids), so what reaches the driver is bounded
at any size of the corpus. Trees are grown level by level on binned statistics
and flattened into arrays; scoring walks all trees for a slice of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.textarrays import TextSlice, slices

#: Labelled documents that training uses at most.
SAMPLE_ROWS = 10_000
#: Values of the hash that draws them.
HASHES = 1 << 30

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "blank": [32, 9, 10, 11, 12, 13],
    "line": [10],
    "stop": [*b".?"],
    "comma": [*b",;:"],
    "bang": [*b"!"],
    "bar": [*b"|"],
    "mark": [*b"#$%&*@^~=+_<>\\/"],
    "quote": [*b"\"'()[]{}-`"],
    "control": [*range(0, 9), *range(14, 32), 127],
    "beyond": [*range(128, 256)],
}
FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "same_as_last", "distinct_words", "capital_words", "capital_after_first", "log_lines", "distinct_lines", "line_words", "ends_with_stop"]
_TABLES = np.zeros((len(_CLASSES), 256), bool)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLES[_i, _bytes] = True
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[10] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[bounds])


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different values each run has."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
    return np.bincount(o[new], minlength=len(bounds) - 1).astype(float)


def statistics(part: TextSlice) -> np.ndarray:
    """A row of ``FEATURES`` for each text; all zero but for shares of nothing in an empty one."""
    sizes = np.diff(part.offsets).astype(float)
    counts = np.stack([_sums(table[part.data], part.offsets) for table in _TABLES])
    words, lines = part.words(), part.words(_NOT_LINE)
    n, m = words.counts.astype(float), lines.counts.astype(float)
    some, per = np.maximum(sizes, 1), np.maximum(n, 1)
    lengths = (words.ends - words.starts).astype(float)
    hashes = part.word_hashes(words, 6)
    owner = np.repeat(np.arange(len(n)), words.counts)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])][: len(hashes)]
    capital = _TABLES[0][part.data[words.starts]]
    mean = _sums(lengths, words.bounds) / per
    spread = np.sqrt(np.maximum(_sums(lengths**2, words.bounds) / per - mean**2, 0))
    longest = np.zeros(len(n))
    np.maximum.at(longest, owner, lengths)
    second = np.zeros(len(lengths), bool)
    second[:] = lengths > 1
    inner = np.zeros(len(lengths))
    inner[second] = _TABLES[0][part.data[words.starts[second] + 1]]
    last = np.zeros(len(n))
    full = sizes > 0
    last[full] = _TABLES[5][part.data[part.offsets[1:][full] - 1]]
    return np.column_stack(
        [*(counts / some), np.log1p(sizes), np.log1p(n), mean, spread, np.log1p(longest), _sums(same, words.bounds) / per, _distinct(hashes, words.bounds) / per, _sums(capital, words.bounds) / per]
        + [_sums(inner, words.bounds) / per, np.log1p(m), _distinct(part.word_hashes(lines, 7), lines.bounds) / np.maximum(m, 1), n / np.maximum(m, 1), last]
    )


@dataclass
class Trees:
    """Complete binary trees as arrays: of node i the children are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.value[trees, node - (2**self.depth - 1)].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 2048):
            out[i : i + 2048] = 1 / (1 + np.exp(-np.clip(self.margins(x[i : i + 2048]), -30, 30)))
        return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Log-loss boosting. Without rows, or with one class only, scores are the classes' share."""
    share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log(share / (1 - share)))
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # bin > b means value > edges[b]
    width, features = bins, x.shape[1]
    flat = binned + np.arange(features) * width
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = (flat + ((node - first) * features * width)[:, None]).ravel()
            sums = [np.bincount(at, np.repeat(v, features), many * features * width).reshape(many, features, width) for v in (g, h)]
            gl, hl = (s.cumsum(2) for s in sums)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    model.feature[t, first + k], model.cut[t, first + k] = f, edges[f][b]
            own = model.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), own] > model.cut[t, node])
        leaf = node - inner
        model.value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += model.value[t, leaf]
    return model


def _measured(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                rows = statistics(part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(rows)), lists], names=["id", "x"])

    return documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`")).mapInArrow(run, "id long, x array<double>")


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees for ``label_col`` (0 or 1) of labelled documents, those of the smallest id hashes if there are over ``sample_rows``.

    Labels that are null or of no document are left out; of an id with several labels the mean counts, one half as 1.
    """
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").alias("y")).dropna().groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    # twice the rows wanted are below the limit on average, so tasks send no more than that to the last step
    hashed = F.pmod(F.xxhash64("id"), F.lit(HASHES))
    drawn = known.where(hashed < int(HASHES * min(1.0, 2 * sample_rows / max(1, known.count()))))
    chosen = drawn.orderBy(hashed, "id").limit(sample_rows)
    text = documents.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the sample is bounded: sample_rows rows of 12 bytes
    rows = _measured(text.join(F.broadcast(chosen.select("id")), "id", "left_semi"), "id", "text").join(F.broadcast(chosen), "id").orderBy("id", "x").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return boosted(x, rows["y"].to_numpy(float))


def _with_scores(documents: DataFrame, model: Trees, text_col: str, least: float | None = None) -> DataFrame:
    at = documents.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(documents.columns))), *(["score"] if least is None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(at)):
                rows, scores = batch.slice(part.first, part.last - part.first), model.scores(statistics(part))
                if least is None:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], names=names)
                else:
                    yield pa.RecordBatch.from_arrays(rows.filter(pa.array(scores >= least)).columns, names=names)

    more = [T.StructField("score", T.DoubleType())] if least is None else []
    # by place, as names may be of any kind
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    out = plain.mapInArrow(run, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, [*documents.schema.fields, *more], strict=True)]))
    return out.toDF(*documents.columns, *(f.name for f in more))


def scored(documents: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1), a row for each row of ``documents``.

    Null and empty texts are scored by the statistics of the empty text. Equal
    texts have equal scores. Other columns are neither read nor returned.
    """
    return _with_scores(documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), model, text_col).select(F.col(f"`{id_col}`"), "score")


def passed(documents: DataFrame, model: Trees, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose own text scores ``least`` or more, with all their columns."""
    return _with_scores(documents, model, text_col, least)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the fold that a row is in."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus
