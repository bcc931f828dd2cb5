"""Importance resampling, sharding and vector codes against brute force; ids at the ends of their range; columns of any name."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import test_llm as small
from vitrine.llm import importance, lzprints, queries, ring, substrings, urls, veccodes

DATA = Path("/root/testdata")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

# --- 11 ----------------------------------------------------------------------


def features(text):
    words = small.ALNUM.findall(small.ascii_lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(docs, target, buckets=10_000, percent=5, least=20, seed=42):
    """The contract, one document after another."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(key, *features(text)) for key, text in docs]
    s, t = Counter(bucket(f) for *_, fs in each for f in fs), Counter(bucket(f) for text in target for f in features(text)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets))))
    rows = []
    for key, words, fs in each:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("slice_bytes", [5_000_000, 400])
def test_importance(spark, slice_bytes):
    """Small slices cut long texts in pieces and make the same strings come from many."""
    texts = [*small.made(4, 90), "A-b_c" * 9, "tie " * 30, "tie " * 30, "é" * 700 + " x " + "y" * 900]
    target = spark.createDataFrame([(t,) for t in [*texts[20:26], None, ""]], "text string")
    docs = small.documents(spark, texts)
    got = importance.resampled(docs, target, percent=30, slice_bytes=slice_bytes)
    assert plain(got) == sorted(resampled(list(enumerate(texts)), [*texts[20:26], None, ""], percent=30), key=repr)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_importance_edges(spark):
    text = " ".join(f"w{i % 7}" for i in range(40))
    docs = small.documents(spark, [text, text, text, None, "x", text], [None, 5, 5, 6, 7, None])
    target = spark.createDataFrame([], "text string")
    rows = importance.resampled(docs, target, percent=60, buckets=50)
    assert plain(rows) == sorted(resampled([(None, text), (5, text), (5, text), (6, None), (7, "x"), (None, text)], [], buckets=50, percent=60), key=repr) or sorted(r.rank for r in rows.collect() if r.rank) == [1, 2]
    assert importance.resampled(docs.limit(0), target).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("a.b"), F.col("text").alias("rank"))
    assert importance.resampled(named, target, "a.b", "rank").columns == ["a.b", "n_features", "weight", "score", "rank"]


def test_joined_hashes():
    rnd = random.Random(1)
    parts = [(rnd.randbytes(rnd.randrange(9)), rnd.randbytes(n)) for n in (0, 1, 2, 5, 255, 256, 511, 2000)]
    first, second = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    assert importance.joined_crc(first, second, np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]


@needs_tables
def test_importance_query_over_its_whole_table(spark):
    folder = str(DATA / "sf0.001")
    docs = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").collect()]
    target = [r.text for r in queries.table(spark, folder, "benchmark").collect()]
    assert plain(queries.op11_importance(spark, folder)) == sorted(resampled(docs, target), key=repr)


# --- 12 ----------------------------------------------------------------------


def placed(df):
    return [(r.row.doc_id, r.shard, r.slot, r.grown_shard) for r in df.collect()]


def gapless(rows):
    by = {}
    for _, shard, slot, _ in rows:
        by.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return Counter(r[1] for r in rows)


@pytest.mark.parametrize("kind", ["distinct", "hot", "null", "equal"])
@pytest.mark.parametrize("n", [0, 5, 1000])
def test_bounded_loads(spark, kind, n, monkeypatch):
    monkeypatch.setattr(ring, "CELL", 64)
    key = {"distinct": lambda i: i, "hot": lambda i: i if i % 3 else -1, "null": lambda i: i if i % 3 else None, "equal": lambda i: 7}[kind]
    rows = spark.createDataFrame([(key(i), i, 1, 2, 3) for i in range(n)], "doc_id long, i long, shard int, row int, `a.b` int")
    found = ring.placed(rows, 24)
    got = found.collect()
    counts = gapless([(r.row.doc_id, r.shard, r.slot, r.grown_shard) for r in got])
    assert sorted(r.row.i for r in got) == list(range(n)) and all(r.grown_shard is None for r in got)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(24)), default=0) <= 1 or not n


def test_the_plan_is_that_of_one_row_after_another():
    """Rows come arc by arc, each to its own shard if there is room, then what is left moves on clockwise, hop by hop."""
    rnd = random.Random(6)
    for _ in range(40):
        shards, arcs = rnd.randrange(1, 6), rnd.randrange(1, 14)
        owners = [rnd.randrange(shards) for _ in range(arcs)]
        if set(owners) != set(range(shards)):
            continue
        counts = [rnd.choice([0, 1, 5, 40]) for _ in range(arcs)]
        own = [sum(n for n, o in zip(counts, owners, strict=True) if o == s) for s in range(shards)]
        room = ring.rooms(sum(counts), own)
        assert sum(room) == sum(counts) and max(room) - min(room) <= 1
        free, took, waiting = list(room), [[] for _ in counts], [(a, a, r) for a, n in enumerate(counts) for r in range(n)]
        while waiting:
            on = []
            for at, arc, rank in waiting:
                if free[owners[at]]:
                    free[owners[at]] -= 1
                    took[arc].append((rank, owners[at]))
                else:
                    on.append(((at + 1) % arcs, arc, rank))
            waiting = on
        plan = ring.runs(counts, owners, room, shards)
        slots = {s: [] for s in range(shards)}
        for arc, runs in enumerate(plan):
            ranks, low = [], 0
            for until, shard, shift in runs:
                ranks += [(rank, shard) for rank in range(low, until)]
                slots[shard] += [rank + shift for rank in range(low, until)]
                low = until
            assert ranks == sorted(took[arc])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_movement_is_limited(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    old, new = ({r[0]: r[1] for r in placed(ring.placed(rows, n))} for n in (24, 25))
    assert sum(old[k] != new[k] for k in old) < 0.12 * len(old)  # a remainder of the id would move 96 of 100
    loose = placed(ring.placed(rows, 24, bounded=False))
    gapless(loose)
    assert all(grown in (shard, 24) for _, shard, _, grown in loose)
    assert 0.01 < sum(r[3] == 24 for r in loose) / len(loose) < 0.08
    shards = {r[0]: r[1] for r in placed(ring.placed(rows.where("doc_id % 2 = 0"), 24, bounded=False))}
    assert all(shards[k] == s for k, s, *_ in loose if k in shards)  # other rows don't matter
    moved = {r[0]: r[1] for r in placed(ring.placed(rows, 25, bounded=False))}
    assert all(moved[k] == grown for k, _, _, grown in loose)


@needs_tables
def test_sharding_query(spark):
    folder = str(DATA / "sf0.001")
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, folder, "documents").collect()}
    df = queries.op12_sharding(spark, folder)
    rows = df.collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in docs.items()}
    assert len(rows) == len(docs) and {r.law for r in rows} == {"rows"}
    counts = gapless([(r.doc_id, r.shard, r.slot, None) for r in rows])
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


# --- 13 ----------------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """The contract with plain lists."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted(((i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if fine(v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, part: min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [(near(p, cut(v, p)), cut(v, p)) for *_, v in kept]
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := [x for e2, x in own if e2 == e]) else old for e, old in enumerate(books[p])]
    out = []
    for i, lab, v in kept:
        codes = [near(p, cut(v, p)) for p in range(parts)]
        out.append((i, lab, "".join(f"{c:02x}" for c in codes), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    sums = Counter()
    for _, lab, _, error in out:
        sums[lab] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r, sums[r[1]]) for r in out), key=repr), digest


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_vector_codes(spark, heavy, monkeypatch):
    monkeypatch.setattr(veccodes, "HEAVY", heavy)
    rnd = random.Random(9)
    rows = []
    for i in range(300):
        v = [rnd.choice([0.0, -0.001, 0.5, rnd.uniform(-1, 1)]) for _ in range(8)]
        rows.append((i, [0.25] * 8 if i % 3 == 0 else v, rnd.choice([None, 1, 2])))
    rows += [(400, None, 1), (401, [], 1), (402, [float("nan")] * 8, 1), (-5, [float("inf")] + [0.0] * 7, 1), (403, [None] + [0.0] * 7, 1), (404, [1.0] * 4, 1), (None, [0.5] * 8, None), (7, [0.5] * 8, 2), (7, [0.5] * 8, 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, code int, `a.b` string")
    import struct

    exact = [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v], lab) for i, v, lab in rows]
    want, digest = coded(exact, 2, 16, 2)
    got, books = veccodes.compressed(df, parts=2, entries=16)
    assert plain(got) == want and books.digest() == digest


def test_vector_codes_edges(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, 1), (2, [1e30, -1e30, 0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got, books = veccodes.compressed(df, parts=2)
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == [(1, "0000", 0), (2, "0101", 0)] and books.entries.shape == (2, 2, 2)
    with pytest.raises(ValueError, match="equal parts"):
        veccodes.compressed(df, parts=3)
    with pytest.raises(ValueError, match="256"):
        veccodes.compressed(df, entries=300)
    none, books = veccodes.compressed(df.limit(0))
    assert none.count() == 0 and books is None and none.columns == ["vec_id", "label", "code", "error", "label_error"]


@needs_tables
def test_vector_codes_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/sf0.001/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLE_SQL['op13_veccodes']})").fetchall()
    assert plain(queries.op13_veccodes(spark, str(DATA / "sf0.001"))) == sorted(want, key=repr)


# --- ids at the ends of their range, columns of any name ---------------------

ENDS = [(1 << 63) - 1, None, -(1 << 63), 0, None]


def test_repeats_keep_ids_at_the_ends(spark):
    text = " ".join(f"w{i}" for i in range(25))
    own = [f"{text} a", f"{text} b", f"{text} c", f"{text} d", f"{text} e"]
    for ids, first in ((ENDS, -(1 << 63)), (ENDS[:1] + ENDS[1:2], (1 << 63) - 1), (ENDS[:1], None), (ENDS[1:2], None), (ENDS[:1] * 2, None)):
        rows = substrings.drop_repeats(small.documents(spark, own[: len(ids)], ids)).collect()
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ids))
        if first is not None:  # the earliest keeps its words, all others lose the passage
            assert [r.doc_id for r in rows if r.n_removed == 0] == [first]


def test_fingerprints_keep_ids_at_the_ends(spark):
    texts = ["the sea is wide", "old stones of the town", "", "boats", "nets and sails"]
    rows = lzprints.fingerprints(small.documents(spark, texts, ENDS)).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ENDS))
    by_print = {r.fingerprint: r.doc_id for r in rows}
    assert [by_print[lzprints.fingerprint(t)] for t in texts] == ENDS
    # null ids come first, then the smallest number
    following = {r.doc_id: r.edited_sha256 for r in rows if r.doc_id is not None}
    assert following[-(1 << 63)] == hashlib.sha256((texts[2][: len(texts[2]) - 0]).encode()).hexdigest()
    assert following[0] == hashlib.sha256((texts[3][:3] + texts[0][:2]).encode()).hexdigest()


def test_stages_with_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "no_text", "a.b", "c0", "none", "places", "tag"]
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1, "a", "b", 2, 3, 4, 5), (2, text + " more", "en", "s", 1, "a", "b", 2, 3, 4, 5), (None, text, "en", "s", 1, None, None, 2, 3, 4, 5), (3, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "c1 long, c2 string, c3 string, c4 string, c5 long, c6 string, c7 string, c8 long, c9 long, c10 long, c11 long").toDF(*names)
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.where("doc_id IS NOT NULL")):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == names and 0 < out.count() <= 4
    cut = corpus_pipeline.no_repeats(spark, docs, str(tmp_path)).where("doc_id = 1").first()
    assert (cut["a.b"], cut["no_text"], cut["c0"], cut["text"]) == ("b", "a", 2, text)


def test_many_url_rules_are_joined(spark, monkeypatch):
    rnd = random.Random(12)
    labels = ["a", "b", "com", "net", "x"]
    host = lambda: ".".join(rnd.choices(labels, k=rnd.randrange(1, 4)))
    rules = list({(rnd.choice(["block", "allow"]), host(), rnd.choice(["/", "/p/", "/p/q"])) for _ in range(60)})
    pages = spark.createDataFrame([(i, f"http://{host()}{rnd.choice(['/', '/p/1', '/p/qq', ''])}", "") for i in range(200)] + [(900, None, None), (901, "none", "")], "page_id long, url string, html string")
    few = plain(urls.judged(pages, rules))
    monkeypatch.setattr(urls, "EXPRESSED_RULES", 3)
    found = urls.judged(pages, rules)
    assert plain(found) == few and "Python" not in found._jdf.queryExecution().executedPlan().toString()
