"""Language identification by interpolated Kneser-Ney character models.

One model a language, of ``ORDER`` characters, from at most ``SAMPLE_ROWS``
labelled documents of each (those with the smallest hashes of their ids): what
reaches the driver is bounded by the sample, not the corpus. A model is sorted
arrays of n-gram hashes with the probability of each n-gram and the weight that
each context leaves to the shorter one. Texts are scored a slice at a time;
the language of the lowest cross-entropy a character wins, and a text that is
further from it than nearly all of a held-back part of the sample is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.checkpoints import saved
from vitrine.llm.textarrays import mixed

ORDER = 4
SAMPLE_ROWS = 500
#: Languages at most: each has a model of some megabytes in every task.
MOST_LANGUAGES = 500
#: Values of the hash that draws the sample.
HASHES = 1 << 30
#: Of every so many sampled documents one is held back to calibrate rejection.
HELD_BACK = 5
#: Share of held-back documents that a language's limit accepts.
ACCEPTED = 0.995
#: Characters up to which more text makes a verdict surer.
SURE_CHARS = 60
SLICE_CHARS = 2 << 20
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the texts, a 0 for each run of anything else, ``ORDER`` - 1 zeros before each text; and the bounds of each."""
    pad = " " * (ORDER - 1)
    padded = [f"{pad}{t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *map(len, padded)])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for j in range(ORDER - 1):
        keep[bounds[:-1] + j] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return np.where(letter, points, 0)[keep].astype(np.uint64), kept


def gram_hashes(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` characters that end at each of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n - 1, -1, -1):
        out = (out + chars[at - j] + np.uint64(1)) * _STEP
    return mixed(out + np.uint64(n))


def _places(bounds: np.ndarray) -> np.ndarray:
    """Every character but the zeros before each text."""
    inside = np.ones(bounds[-1], bool)
    for j in range(ORDER - 1):
        inside[bounds[:-1] + j] = False
    return np.flatnonzero(inside)


@dataclass
class Model:
    """For each n, sorted hashes of the n-grams and their log probabilities; for each shorter context, sorted hashes and log weights left over."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = table
        if not len(hashes):
            return np.full(len(keys), missing), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        hit = hashes[at] == keys
        return np.where(hit, values[at], missing), hit

    def log_probability(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, left = np.full(len(at), self.unseen), np.zeros(len(at))
        waiting = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            value, hit = self._found(self.grams[n - 1], gram_hashes(chars, at[waiting], n), 0.0)
            out[waiting[hit]] = value[hit] + left[waiting[hit]]
            waiting = waiting[~hit]
            if n > 1:
                left[waiting] += self._found(self.contexts[n - 2], gram_hashes(chars, at[waiting] - 1, n - 1), 0.0)[0]
        out[waiting] += left[waiting]
        return out


def trained(grams: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney with one discount an order, from distinct ``ORDER``-grams (rows of characters) and their counts."""
    tables, contexts = [], []
    current, weight = grams, counts.astype(float)
    levels = [(current, weight)]
    for n in range(ORDER - 1, 0, -1):  # of shorter ones, in how many contexts they stand
        current, weight = np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True)
        levels.append((current, weight.astype(float)))
    size = len(levels[-1][0]) + 1
    lower: dict[bytes, float] = {}
    for n, (rows, weight) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        singles, doubles = (weight == 1).sum(), (weight == 2).sum()
        discount = min(0.95, max(0.1, singles / (singles + 2 * doubles))) if singles else 0.5
        heads, owner, types = np.unique(rows[:, :-1], axis=0, return_inverse=True, return_counts=True) if n > 1 else (np.zeros((1, 0)), np.zeros(len(rows), int), np.array([len(rows)]))
        owner = owner.reshape(-1)
        total = np.bincount(owner, weight, len(heads))
        rest = discount * types / total
        short = np.array([lower[r.tobytes()] for r in rows[:, 1:]]) if n > 1 else np.full(len(rows), 1 / size)
        p = np.maximum(weight - discount, 0) / total[owner] + rest[owner] * short
        lower = {r.tobytes(): x for r, x in zip(rows, p.tolist(), strict=True)}
        keys = _row_hashes(rows)
        order = np.argsort(keys)
        tables.append((keys[order], np.log(p[order])))
        if n > 1:
            keys = _row_hashes(heads)
            order = np.argsort(keys)
            contexts.append((keys[order], np.log(rest[order])))
        else:
            unseen = float(np.log(rest[0] / size))
    return Model(tables, contexts, unseen)


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    n = rows.shape[1]
    return gram_hashes(np.ascontiguousarray(rows).ravel().astype(np.uint64), np.arange(len(rows)) * n + n - 1, n)


@dataclass
class Identifier:
    languages: list[str]
    models: list[Model]
    limits: np.ndarray

    def __post_init__(self) -> None:
        self._keys = np.zeros(1 << 19, np.uint64)
        self._values = np.zeros((1 << 19, max(1, len(self.languages))), np.float32)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "models": self.models, "limits": self.limits}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text under each language, and how many characters it has."""
        chars, bounds = characters(texts)
        at = _places(bounds)
        hashes = gram_hashes(chars, at, ORDER)
        slot = (hashes & np.uint64(len(self._keys) - 1)).astype(np.int64)
        hit = self._keys[slot] == hashes
        values = self._values[slot]
        if not hit.all():
            new, first, back = np.unique(hashes[~hit], return_index=True, return_inverse=True)
            own = np.column_stack([m.log_probability(chars, at[~hit][first]) for m in self.models]).astype(np.float32)
            values[~hit] = own[back]
            where = (new & np.uint64(len(self._keys) - 1)).astype(np.int64)
            self._keys[where], self._values[where] = new, own
        ends = bounds - np.arange(len(bounds)) * (ORDER - 1)
        sums = np.diff(np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])[ends], axis=0)
        n = np.diff(ends)
        return -sums / np.maximum(n, 1)[:, None], n

    def identify(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected. A text without letters is of no language."""
        some = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages or not some.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(1)
        lead = np.exp((h[np.arange(len(h)), best][:, None] - h) * np.minimum(n, SURE_CHARS)[:, None])
        score = np.where(some, 1 / lead.sum(1), 0.0)
        rejected = ~some | (h[np.arange(len(h)), best] > self.limits[best])
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score, rejected


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = [t.as_py() or "" for t, k in zip(batch.column(1), langs == lang, strict=True) if k]
            chars, bounds = characters(texts)
            at = _places(bounds)
            rows, counts = np.unique(np.column_stack([chars[at - j] for j in range(ORDER - 1, -1, -1)]), axis=0, return_counts=True)
            grams = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * ORDER, pa.int32()), pa.array(rows.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), grams, pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Identifier:
    """Models of the languages that ``lang_col`` names; rows without language or text teach nothing. Ties of hashes go by id."""
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    # twice the rows wanted are below the limit on average, so no language sends all of its rows to one task
    sizes = saved(rows.groupBy("lang").agg(F.count("*").alias("n")))
    if (languages := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; a model of each goes to every task, {MOST_LANGUAGES} at most")
    sizes = F.broadcast(sizes)  # a row a language
    drawn = rows.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(HASHES)).alias("key")).join(sizes, "lang").where(F.col("key") < HASHES * 2.0 * sample_rows / F.col("n"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))).where(F.col("r") <= sample_rows)
    held = (F.col("r") % HELD_BACK == 0).alias("held")
    # bounded: sample_rows rows of each language
    sample = saved(rows.join(F.broadcast(ranked.select("id", "lang", held)), ["id", "lang"]).select("lang", "text", "held"))
    counted = sample.where("NOT held").select("lang", "text").mapInArrow(_counted, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["lang"].to_pylist()))
    of = np.array(counted["lang"].to_pylist(), object)
    grams = counted["gram"].combine_chunks().flatten().to_numpy().reshape(-1, ORDER) if len(of) else np.zeros((0, ORDER), np.int32)
    counts = counted["n"].to_numpy()
    models = []
    for lang in languages:
        own = of == lang
        order = np.lexsort(grams[own].T[::-1])
        models.append(trained(grams[own][order].astype(np.int64), counts[own][order]))
    out = Identifier(languages, models, np.full(len(languages), np.inf))
    if languages:
        out.limits = _limits(sample.where("held").select("lang", "text"), out)
    return out


def _limits(held: DataFrame, model: Identifier) -> np.ndarray:
    index = {lang: i for i, lang in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            h, _ = model.entropies(texts)
            own = [h[i, index[x]] if x in index else None for i, x in enumerate(langs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["lang", "h"])

    rows = held.mapInArrow(run, "lang string, h double").toPandas().dropna()
    return np.array([rows.h[rows.lang == x].quantile(ACCEPTED) if (rows.lang == x).any() else np.inf for x in model.languages])


def identified(documents: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (0 to 1) and ``rejected``, a row for each row of ``documents``.

    ``lang_pred`` is the nearest language also where ``rejected`` says that no
    learned one fits, and ``und`` for null texts and texts without letters.
    Equal texts have equal results; other columns are neither read nor returned.
    """
    field = documents.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, first = [], 0, 0
            for i, cell in enumerate(batch.column(1)):
                texts.append(cell.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE_CHARS or i + 1 == len(batch):
                    langs, score, rejected = model.identify(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(langs), pa.array(score), pa.array(rejected)], names=[field.name, "lang_pred", "score", "rejected"])
                    texts, size, first = [], 0, i + 1

    schema = T.StructType([T.StructField(field.name, field.dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
