"""Queries over whole tables against brute force or held-out labels, and large groups of near copies."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import test_llm as small
from vitrine.llm import lzprints, minhash, quality, queries, textarrays, urls

DATA = Path("/root/testdata")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


# --- near duplicates ---------------------------------------------------------


def linked_by_matrix(texts, percent):
    """Components of all pairs' likeness, by one matrix product."""
    sets = [small.shingles(t) for t in texts]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, own in enumerate(sets):
        held[i, [number[s] for s in own]] = 1
    both, sizes = held @ held.T, np.array([len(s) for s in sets])
    link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(len(sets))
    while True:
        low = np.where(link, label[None, :], len(sets)).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("pieces", [minhash.PIECE, 100])
def test_a_large_group_without_a_centre(spark, pieces, monkeypatch):
    """2,000 copies of a text with up to nine changed words: pairs straddle the threshold, and no text is like most others."""
    monkeypatch.setattr(minhash, "PIECE", pieces)
    monkeypatch.setattr(minhash, "PIECE_SHINGLES", pieces * 256)
    rnd = random.Random(21)
    base = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = []
    for _ in range(2000):
        own = base.copy()
        for at in rnd.sample(range(200), rnd.randrange(1, 8)):
            own[at] = "".join(rnd.choices("ijklmnop", k=6))
        texts.append(" ".join(own))
    want = linked_by_matrix(texts, 85)
    assert 20 < len(set(want.tolist())) < 1900  # neither one component nor all alone
    rows = small.by_id(minhash.near_duplicates(small.documents(spark, texts)))
    assert [rows[i].component_id for i in range(len(texts))] == want.tolist()


@pytest.mark.parametrize("common", [1, 5, 12])
def test_pairs_just_at_the_threshold(spark, common):
    """Recall of pairs of a likeness of 0.85 to 0.87, each pair a component of its own."""
    rnd, texts = random.Random(common), []
    for _ in range(200):
        own = ["".join(rnd.choices("abcdefghijkl", k=6)) for _ in range(130)]
        texts += [" ".join(own[:117]), " ".join([*own[:109], *own[117:125]])]  # 105 shingles of 121 are in both: 0.868
        assert 0.85 <= len(small.shingles(texts[-1]) & small.shingles(texts[-2])) / len(small.shingles(texts[-1]) | small.shingles(texts[-2])) < 0.88
    rows = small.by_id(minhash.near_duplicates(small.documents(spark, texts)))
    assert [rows[i].component_id for i in range(400)] == [i - i % 2 for i in range(400)]


def test_intersections_by_matrix_and_by_pairs():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 80)).astype(np.uint64)) for _ in range(120)] + [np.arange(30, dtype=np.uint64)] * 20
    rows = np.arange(0, 140, 3)
    got = minhash.shared_counts(sets, rows)
    assert got.tolist() == [[len(np.intersect1d(sets[r], s)) for s in sets] for r in rows]


# --- fingerprints ------------------------------------------------------------


def test_minima_by_whole_numbers():
    mask, step = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * factor & mask
        return x ^ (x >> 33)

    for text in ("abracadabra abracadabra", "Zoë 😀 Zoë", "x", "aaaaaaaaaaaaaaaa"):
        spans, start = set(), 0
        for end in small.lz78(text):
            phrase = text[start:end]
            spans.add(mix((sum(mix(ord(c) + 1) * pow(step, i, 1 << 64) for i, c in enumerate(phrase)) + len(phrase)) & mask))
            start = end
        least = [min((int(a) * h + int(b)) & mask for h in spans) for a, b in zip(lzprints._FACTORS, lzprints._ADDENDS, strict=True)]
        assert lzprints.fingerprint(text) == "".join(f"{mix(v) >> 48:04x}" for v in least)


# --- held-out labels ---------------------------------------------------------


@needs_tables
def test_language_of_held_out_documents(spark):
    docs = queries.table(spark, str(DATA / "sf0.01"), "documents").select("doc_id", "lang", "text")
    rows = queries.op6_language(spark, str(DATA / "sf0.01")).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.05  # texts of learned languages are seldom rejected


@needs_tables
def test_quality_of_held_out_documents(spark):
    labels = queries.table(spark, str(DATA / "sf0.01"), "labels").select("doc_id", "quality")
    rows = queries.op8_quality(spark, str(DATA / "sf0.01")).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(rows) > 80 and np.mean(right) > 0.95
    assert np.mean([x > y for x in good for y in bad]) > 0.97


# --- pipeline ----------------------------------------------------------------


@needs_tables
def test_each_stage_of_the_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder = str(DATA / "sf0.001")
    docs = queries.table(spark, folder, "documents")
    model = quality.fit(docs, queries.table(spark, folder, "labels"))
    items = [(r.item_id, r.text) for r in queries.table(spark, folder, "benchmark").collect()]
    tokenizer = Tokenizer.from_file(queries.word_vocabulary())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "quality":
            want = []
            for key, text in given:
                part = next(textarrays.slices(small.pa.array([text], small.pa.string())))
                if model.scores(quality.statistics(part))[0] >= 0.5:
                    want.append((key, text))
        elif name == "near_duplicates":
            component = linked_by_matrix([t for _, t in given], corpus_pipeline.NEAR) if given else []
            empty = [not small.shingles(t) for _, t in given]
            want = [row for i, row in enumerate(given) if component[i] == i or empty[i]]
        elif name == "repeated_passages":
            cut = small.without_repeats([t for _, t in given], 20)
            want = [(key, text if gone == 0 else left) for (key, text), (_, gone, left) in zip(given, cut, strict=True) if gone == 0 or left]
        elif name == "benchmark_leaks":
            want = [row for row, (_, n, _) in zip(given, small.contaminated([t for _, t in given], items), strict=True) if n == 0]
        else:
            assert {r.doc_id: list(r.ids) for r in docs.collect()} == {key: tokenizer.encode(text or "", add_special_tokens=False).ids for key, text in given}
            break
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == want, name
        assert len(want) > 20, name


def test_pipeline_stages_on_nothing_and_on_clashing_names(spark, tmp_path):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, row string, id long, key long, number long, digest string, own string, score double, label long"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1, "a", "b", 2, 3, 4, "c", "d", 0.5, 7), (2, text + " more", "en", "s", 1, "a", "b", 2, 3, 4, "c", "d", 0.5, 7), (3, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, names)
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= len(given)
        assert corpus_pipeline.as_ids(spark, docs, str(tmp_path)).count() == len(given)


# --- URLs --------------------------------------------------------------------


@needs_tables
def test_url_verdicts_against_sql_with_aliases(spark, tmp_path):
    """The SQL twin follows links, too: random pages that point at each other, in every form of link that it reads."""
    import duckdb

    from vitrine.llm import oracles

    rnd = random.Random(17)
    hosts = ["x.net", "example.net", "a.example.com", "b.org", "c.info", "d.info", "e.io"]
    spots = [f"{rnd.choice(hosts)}/{rnd.choice(['en/', 'de/', 'fr/', ''])}p{i}" for i in range(80)]
    pages = []
    for i, spot in enumerate(spots):
        other = rnd.choice(spots)
        link = rnd.choice([f"http://{other}", f"https://{other}#top", f"//{other}", "/" + other.partition("/")[2], f"q{rnd.randrange(9)}", f"?p={rnd.randrange(3)}", "#x", "mailto:me"])
        tag = rnd.choice([f'<link rel="canonical" href="{link}">', f'<meta http-equiv="refresh" content="0; url={link}">', "", "", ""])
        pages.append((i, f"{rnd.choice(['http', 'https'])}://{spot}{rnd.choice(['', '#a'])}", f"<html><head>{tag}</head>"))
    pages += [(90, None, ""), (91, "nothing", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.URLS})").fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df, queries.URL_RULES).collect()}
    assert got == want
    assert sum(rule is None and verdict == "block" for *_, rule, verdict in got.values()) >= 3  # links decide some
    assert df.where(F.col("html").contains("canonical")).count() > 5
