"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import bpe, components, decontaminate, language, licenses, lzprints, maintext, minhash, quality, substrings, urls
from vitrine.llm.queries import URL_RULES, word_vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t ", "one", "Zoë Ünal’s “café”", "a b c d", "😀 漢字 x", "the " * 3000, "<|endoftext|> end", "\x00\x1c odd"]


def ascii_lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def documents(spark, texts, ids=None):
    """With columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", 1, 2, 3, 4) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, key long, n_words long, score long")


def made(seed, n=60):
    """Texts that share passages and are copies of each other, and odd ones."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "sea", "of", "old", "stone"]) if rnd.random() < 0.3 else "".join(rnd.choices("abcdeé", k=rnd.randrange(2, 6)))
    passages = [[word() for _ in range(rnd.randrange(15, 50))] for _ in range(4)]
    texts = list(ODD)
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.2 and len(texts) > 12:
            own = (rnd.choice(texts) or "").split()
            for _ in range(rnd.randrange(3)):
                if own:
                    own[rnd.randrange(len(own))] = word()
        else:
            own = [word() for _ in range(rnd.randrange(0, 120))]
            if kind < 0.6:
                at = rnd.randrange(len(own) + 1)
                own[at:at] = rnd.choice(passages)
        texts.append(rnd.choice([" ", "\n", "  "]).join(own))
    return texts


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1 -----------------------------------------------------------------------


def test_bpe_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    texts = [*made(1), "x" * 500, "a" * 65, "I'll 'S don't Σίσυφος İstanbul ﬁ½²", "<|startoftext|>A<|endoftext|>B"]
    rows = by_id(bpe.decode(bpe.encode(documents(spark, texts), word_vocabulary), word_vocabulary))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert by_id(bpe.round_trip(documents(spark, texts), word_vocabulary)) == rows


def test_bpe_edges(spark):
    assert bpe.encode(documents(spark, []), word_vocabulary).count() == 0
    twice = bpe.encode(documents(spark, ["same text", "same text"], [5, 5]), word_vocabulary).collect()
    assert twice[0].ids == twice[1].ids
    ids = spark.createDataFrame([(1, None), (2, []), (3, [320, -1, 999_999]), (4, [320, None])], "doc_id long, ids array<int>")
    assert {i: r.decoded for i, r in by_id(bpe.decode(ids, word_vocabulary)).items()} == {1: "", 2: "", 3: "a</w>", 4: "a</w>"}


# --- 2 -----------------------------------------------------------------------


def shingles(text):
    w = WORDS.findall(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return [(len(sets[i]), top(i)) for i in range(len(texts))]


def test_near_duplicates(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(150)]
    chain = []
    for i in range(14):  # neighbours are alike, the ends are not
        base = base.copy()
        base[10 * i] = f"new{i}"
        chain.append(" ".join(base))
    rnd.shuffle(chain)
    texts = [*made(3), *chain, *["Copy of one TEXT here it is"] * 20]
    rows = by_id(minhash.near_duplicates(documents(spark, texts)))
    for i, (n, component) in enumerate(linked(texts)):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (n, component, component == i)


def test_near_duplicates_at_other_thresholds(spark):
    assert [(minhash.band_width(p), minhash.sketch_limit(p)) for p in (85, 80)] == [(6, 70), (5, 86)] and minhash.sketch_limit(100) == 0
    rnd, texts = random.Random(12), []
    for _ in range(300):  # 100 words, the last 19 of them others: 77 shingles of 115 are in both
        own = ["".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(119)]
        texts += [" ".join(own[:100]), " ".join(own[:81] + own[100:])]
    sets = [shingles(t) for t in texts]
    assert all(len(a & b) / len(a | b) == 77 / 115 for a, b in zip(sets[::2], sets[1::2], strict=True))
    found = {p: by_id(minhash.near_duplicates(documents(spark, texts), percent=p)) for p in (66, 67)}
    assert [r.component_id for _, r in sorted(found[66].items())] == [i - i % 2 for i in range(600)]
    assert [r.component_id for _, r in sorted(found[67].items())] == list(range(600))
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents(spark, texts), percent=5)


def test_near_duplicates_of_the_pipeline(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]
    texts = [" ".join(base), " ".join([*base[:92], *(f"v{i}" for i in range(8))])]  # 88 shingles of 108 are in both
    docs = documents(spark, texts)
    assert [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()] == [0]
    assert minhash.near_duplicates(docs).where("kept").count() == 2


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = minhash.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", "g h i j k l", "g h i j k l", None], [7, 3, 7, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False)]


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (1, 2), (2, 1), (5, 5), (None, 4), (20, 6)], "a long, b long")
    rows = {r.node: r.component for r in components.components(links).collect()}
    assert rows == {6: 6, 7: 6, 8: 6, 9: 6, 20: 6, 1: 1, 2: 1}
    assert components.components(links.limit(0)).count() == 0


@pytest.mark.parametrize("part", [components.PART, 40])
def test_components_of_random_graphs(spark, part, monkeypatch):
    """In one part, and in many, of long chains, hubs and repeated links; by numbers and by names."""
    monkeypatch.setattr(components, "PART", part)
    rnd = random.Random(13)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rnd.randrange(400, 900), rnd.randrange(400, 900)) for _ in range(300)] + [(1000, 1000 + i) for i in range(200)] * 2
    rnd.shuffle(links)
    root = {n: n for e in links for n in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {n: top(n) for a, b in links if a != b for n in (a, b)}
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components.components(df).collect()} == want
    if part == 40:
        named = df.select(F.lpad(F.col("a").cast("string"), 4, "0").alias("a"), F.lpad(F.col("b").cast("string"), 4, "0").alias("b"))
        assert {int(r.node): int(r.component) for r in components.components(named).collect()} == want


# --- 3 -----------------------------------------------------------------------


def test_main_text(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header>
    <nav><ul><li><a href=a>One</a><li>Two</ul></nav><div class="cookie-banner">We use cookies.</div>
    <article><header><h1>A &amp; B</h1></header><p>First&nbsp;one,\n  <b>bold</b> text.<script>var x = "</p>";</script><div class=ad>Buy</div><p>Second &lt;one&gt; &#233; here, it goes on.
    <form>Name <input></form><table><tr><td>cell<td>next</table></article>
    <section id="comments"><p>I liked this article very much, thank you all.</p></section><aside>More</aside><footer>&copy; me</footer>"""
    assert maintext.main_text(page) == "A & B First one, bold text. Second <one> é here, it goes on. cell next"
    long = "<p>" + "word " * 20000 + "</p>"
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<nav>x</nav>"), (4, "plain text without any markup, a whole sentence."), (5, long), (6, "<p>unclosed <b attr='x"), (6, page)], "page_id long, html string")
    rows = maintext.extracted(pages).collect()
    assert [r.text for r in rows[:4]] == ["", "", "", "plain text without any markup, a whole sentence."]
    assert len(rows[4].text) == 99_999
    assert maintext.extracted(pages.limit(0)).count() == 0


def test_minimum_cut():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        gain = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]

        def cost(keep, gain=gain, edges=edges):
            return sum(-g if k else 0 for g, k in zip(gain, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert cost(maintext.minimum_cut(gain, edges)) == pytest.approx(best)


# --- 4 -----------------------------------------------------------------------


def without_repeats(texts, width):
    seen, out = set(), []
    for text in texts:
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("width", [20, 7])
def test_repeats(spark, width, monkeypatch):
    texts = [*made(5), "x y " * 60, "z", *made(5)[20:30]]
    rows = by_id(substrings.drop_repeats(documents(spark, texts).repartition(5), width=width))
    for i, want in enumerate(without_repeats(texts, width)):
        r = rows[i]
        assert (r.n_words, r.n_removed, r.kept_text) == want
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_repeats_edges(spark):
    assert substrings.drop_repeats(documents(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = substrings.drop_repeats(documents(spark, [text, text, text + " more", text], [4, 4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows)[0] == (-1, 30)
    same = [r.n_removed for r in rows if r.doc_id == 4 and r.n_words == 30]
    assert same[0] == same[1]  # rows with equal id and text are one text
    assert sum(r.n_removed == 0 for r in rows) >= 1
    with pytest.raises(ValueError):
        substrings.drop_repeats(documents(spark, []), width=1)


def test_repeats_around_a_phrase_of_all_texts(spark, monkeypatch):
    """A phrase in every text makes its windows' home hot: they are dealt by their own hashes, no bucket gets them all, and nothing is lost."""
    monkeypatch.setattr(substrings, "LEAST_HOT", 20)
    monkeypatch.setattr(substrings, "HOT_SHARE", 0.01)
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    phrase = [word() for _ in range(6)]
    texts = [" ".join([*(word() for _ in range(8)), *phrase, *(word() for _ in range(8))]) for _ in range(300)]
    texts += texts[:40]
    rows = by_id(substrings.drop_repeats(documents(spark, texts).repartition(5)))
    for i, want in enumerate(without_repeats(texts, 20)):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_text) == want
    named = documents(spark, texts).selectExpr("doc_id AS id", "0L AS tag", "text")
    hot = substrings._hot_homes(named, (10, 20), 1)
    assert len(hot[0]) >= 1
    part = next(iter(substrings.slices(pa.array(texts))))
    *_, home, own = substrings._places(part, 10, (3,))
    loads = [np.bincount(substrings.Dealing(64, h).of(home, own), minlength=64).max() for h in (hot[0][:0], hot[0])]
    assert loads[1] < 0.5 * loads[0] and loads[1] < 4 * len(home) / 64
    many = substrings.Dealing(10_000_000, hot[0])
    assert many.slices > 1 and many.of(home, own).max() < 10_000_000


def test_repeats_of_one_row_twice(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    for chunk in (substrings.CHUNK_WORDS, 1):  # met within a task, and in the buckets
        monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
        for ids in ([4, 4], [None, None]):
            rows = substrings.drop_repeats(documents(spark, [text, text], ids)).collect()
            assert [(r.n_removed, r.kept_text, r.removed) for r in rows] == [(0, text, [])] * 2
        rows = substrings.drop_repeats(documents(spark, [text, text, text + " " + text, text], [4, 4, 5, 6])).collect()
        once = [n for _, n, _ in without_repeats([text, text + " " + text, text], 20)]
        assert sorted((r.doc_id, r.n_removed) for r in rows) == [(4, 0), (4, 0), (5, once[1]), (6, once[2])]


# --- 5 -----------------------------------------------------------------------


def test_licenses(spark):
    assert licenses.find("Some prose.\nreleased UNDER the\n MIT license. More")[0] == "MIT"
    assert licenses.find("the license of the work is under the sea")[0] is None
    changed = licenses.TEMPLATES["GPL-3.0"][1].replace("program", "library").replace("(at your option) ", "")
    name, coverage, start, end = licenses.find("The the of under. " * 200 + changed + " Of the end. " * 200)
    assert name == "GPL-3.0" and 0.85 < coverage < 1 and start == 800 and end <= 800 + 46
    rows = licenses.scanned(documents(spark, [*ODD, "Licensed under CC BY-NC 4.0."])).collect()
    assert [r.license for r in rows] == [None] * len(ODD) + ["CC-BY-NC-4.0"]
    assert (rows[0].coverage, rows[0].start, rows[0].end) == (0.0, 0, 0)
    assert licenses.scanned(documents(spark, [])).count() == 0


def test_licenses_that_stand_twice(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][1]
    found = lambda text: [(n.license, n.coverage, n.start, n.end) for n in licenses.notices(text)]
    assert found(mit + " Some prose. " + mit) == [("MIT", 1.0, 0, 5), ("MIT", 1.0, 7, 12)]
    assert found(" ".join([gpl] * 3)) == [("GPL-3.0", 1.0, 42 * i, 42 * i + 42) for i in range(3)]
    part = " ".join(licenses.words(gpl)[:36])  # the whole one behind it does not take its words
    assert found(f"{part} {gpl}") == [("GPL-3.0", 1.0, 36, 78), ("GPL-3.0", 36 / 42, 0, 36)]
    assert licenses.notices(part)[0].missing == tuple(licenses.words(gpl)[36:])
    apache = licenses.TEMPLATES["Apache-2.0"][0]
    assert sorted(n for n, *_ in found(f"{mit} or {apache}")) == ["Apache-2.0", "MIT"]
    around = "released software. the under a license. MIT students are under. " * 100  # no word of the notice is unique
    n = len(licenses.words(around))
    assert found(f"{around} {mit} {around}") == [("MIT", 1.0, n, n + 5)]
    rows = licenses.scanned(documents(spark, [f"{mit} and {gpl}", None])).collect()
    assert [(x.license, x.start, x.end) for x in rows[0].notices] == [("MIT", 0, 5), ("GPL-3.0", 6, 48)] and rows[0].license == "GPL-3.0" and rows[1].notices == []


def longest(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        last = rows.copy()
        for j, y in enumerate(b):
            rows[j + 1] = last[j] + 1 if x == y else max(rows[j], last[j + 1])
    return rows[-1]


def test_notices_against_every_window():
    """In random texts of few words, so that hardly any is unique: a notice is found where, and only where, some window allows its coverage."""
    rnd = random.Random(16)
    for _ in range(150):
        pool = "abcdefgh"[: rnd.randrange(3, 9)]
        template, text = rnd.choices(pool, k=rnd.randrange(3, 8)), rnd.choices(pool + "xyz", k=rnd.randrange(0, 25))
        span, need = int(licenses.MOST_SPREAD * len(template)), max(1, -(-8 * len(template) // 10))
        best = max((longest(template, text[s : s + span]) for s in range(len(text))), default=0)
        found = licenses.notices(" ".join(text), {"T": [" ".join(template)]})
        assert bool(found) == (best >= need)
        if found:
            assert round(found[0].coverage * len(template)) == best
        spans = sorted((n.start, n.end) for n in found)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        for n in found:  # each is as covered as its own words allow, and tells what it lacks
            assert round(n.coverage * len(template)) == longest(template, text[n.start : n.end]) == len(template) - len(n.missing)


def test_alignment_by_patience():
    a, b = "q w a x c y e".split(), "a b c d e a b".split()
    assert licenses.aligned(a, "z q w a x c y e z".split()) == [(i, i + 1) for i in range(7)]
    pairs = licenses.aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    rnd = random.Random(6)
    for _ in range(50):
        xs = [(i, v) for i, v in enumerate(rnd.sample(range(20), 9))]
        best = max((len(c) for k in range(10) for c in itertools.combinations(xs, k) if all(p[1] < q[1] for p, q in itertools.pairwise(c))), default=0)
        assert len(licenses._increasing(xs)) == best


# --- 6 -----------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    chars, bounds = language.characters(["the cat sat on the mat", "a hat that sat"])
    at = language._places(bounds)
    rows, counts = np.unique(np.column_stack([chars[at - j] for j in range(language.ORDER - 1, -1, -1)]), axis=0, return_counts=True)
    model = language.trained(rows.astype(np.int64), counts)
    letters = np.unique(chars)
    for context in ([0, 0, 0], [116, 104, 101], [113, 113, 113]):
        text = np.array([[*context, c] for c in letters], np.uint64).ravel()
        p = np.exp(model.log_probability(text, np.arange(3, len(text), 4)))
        assert p.sum() + np.exp(model.log_probability(np.array([*context, 0x4E00], np.uint64), np.array([3])))[0] == pytest.approx(1, abs=1e-6)


def test_language(spark):
    rnd = random.Random(7)
    stock = {"aa": ["thing", "other", "with", "that"], "bb": ["über", "nicht", "schön", "einen"]}
    texts, langs = zip(*((" ".join(rnd.choices(stock[k], k=20)), k) for k in rnd.choices(["aa", "bb"], k=80)), strict=True)
    train = documents(spark, texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    model = language.fit(train)
    rows = by_id(language.identified(documents(spark, ["THAT other thing", "einen schön", None, "", "123 !!", "漢字" * 30]), model))
    assert [rows[i].lang_pred for i in range(5)] == ["aa", "bb", "und", "und", "und"]
    assert rows[5].rejected and not rows[0].rejected and all(0 <= r.score <= 1 for r in rows.values())
    none = language.fit(documents(spark, []))
    assert none.identify(["abc"])[0] == ["und"]
    assert language.identified(documents(spark, []), model).count() == 0


# --- 7 -----------------------------------------------------------------------


def lz78(text):
    known, ends, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in known:
            j += 1
        known.add(text[i:j])
        ends.append(j)
        i = j
    return ends


def test_fingerprints(spark, monkeypatch):
    texts = [t for t in made(8)]
    order = sorted(range(len(texts)))
    rows = by_id(lzprints.fingerprints(documents(spark, texts).repartition(7)))
    for i in order:
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert lzprints.phrases(text, 0, set()) == lz78(text)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lzprints.fingerprint(text), lzprints.fingerprint(edited))
        if text == after:
            assert r.near_next == 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_fingerprints_edges(spark):
    assert lzprints.fingerprints(documents(spark, [])).count() == 0
    assert lzprints.fingerprints(documents(spark, ["alone"])).first().near_next == 1
    rows = lzprints.fingerprints(documents(spark, ["x y z", "x y z", "other words", "text"], [5, 5, 5, None])).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 1


def test_fingerprints_of_large_ids(spark):
    rnd = random.Random(9)
    ids = sorted({(1 << 60) + rnd.randrange(1 << 40) for _ in range(200)})
    rows = by_id(lzprints.fingerprints(documents(spark, [f"text {i}" for i in range(len(ids))], ids)))
    assert sorted(rows) == ids
    for i, key in enumerate(ids):
        text, after = f"text {i}", f"text {(i + 1) % len(ids)}"
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert rows[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


# --- 8 -----------------------------------------------------------------------


def test_quality(spark):
    rnd = random.Random(9)
    good = [" ".join(rnd.choices(["Sea", "stone", "old", "house,", "light."], k=rnd.randrange(5, 60))) for _ in range(150)]
    bad = [" ".join(rnd.choices(["##$", "AAA!!", "|", "x|y"], k=rnd.randrange(5, 60))) for _ in range(150)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)] + [(0, None), (2, 1), (999, 0)], "doc_id long, quality int")
    model = quality.fit(documents(spark, texts), labels)
    rows = by_id(quality.scored(documents(spark, [*texts, *ODD]), model))
    assert np.mean([(rows[i].score >= 0.5) == (i < 150) for i in range(1, 300, 2)]) > 0.97
    assert len(rows) == 300 + len(ODD) and rows[300].score == rows[301].score
    none = quality.fit(documents(spark, []), labels)
    assert {r.score for r in quality.scored(documents(spark, ["a", None]), none).collect()} == {0.5}
    assert quality.scored(documents(spark, []), model).count() == 0


def test_trees_are_walked_as_they_were_grown():
    rnd = np.random.default_rng(10)
    x, y = rnd.normal(size=(400, 5)), rnd.integers(0, 2, 400).astype(float)
    trees = quality.boosted(x, y, trees=5, depth=3)
    for row, margin in zip(x, trees.margins(x), strict=True):
        want = trees.base
        for t in range(5):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            want += trees.value[t, node - 7]
        assert margin == pytest.approx(want)


# --- 9 -----------------------------------------------------------------------


def contaminated(texts, items):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(ascii_lower(text))
        for i in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = ALNUM.findall(ascii_lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, short):
    texts = made(11)
    items = [(i, " ".join((texts[20 + i] or "").split()[3:40]).upper()) for i in range(12)]
    items += [(3, "one"), (30, "the sea"), (31, "b c d"), (32, None), (33, "..."), (None, "old"), (34, "a b c d")] if short else [(12, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = by_id(decontaminate.contamination(documents(spark, texts), bench))
    for i, want in enumerate(contaminated(texts, items)):
        assert (rows[i].n_words, rows[i].n_hit, list(rows[i].items)) == want


def test_contamination_of_a_long_copy(spark):
    """A text of 60,000 words that stands in the benchmark as a whole."""
    rnd = random.Random(18)
    text = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(60_000))
    bench = spark.createDataFrame([(1, text), (2, "other words that are in no text of these at all, ever")], "item_id long, text string")
    row = decontaminate.contamination(documents(spark, ["before it " + text + " and behind", "free"]), bench).orderBy("doc_id").first()
    assert (row.n_words, row.n_hit, list(row.items)) == (60_004, 60_000, ["1"])


def test_contamination_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(documents(spark, ["a b", None]), bench).collect()] == [0, 0]
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontaminate.contamination(documents(spark, []), item).count() == 0
    text = "ONE two three-four five six seven eight nine ten eleven"
    rows = decontaminate.contamination(documents(spark, [text, text, "other", text], [1, 1, 1, None]), item).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == [(0, 10), (1, 0), (1, 10), (1, 10)]


# --- 10 ----------------------------------------------------------------------


def test_urls(spark):
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head>'
    rows = [
        (1, "https://x.net/a", None), (2, "http://EXAMPLE.net/en/b?q", ""), (3, "http://www.example.com/de/x#f", ""), (4, "https://a.org/fr/", ""),
        (5, "https://free.org/1", link("http://x.net/a#z")), (6, "https://free.org/2", "<META http-equiv='Refresh' content='0; URL=https://free.org/1'>"),
        (7, "https://a.org/fr/2", link("https://free.org/2")), (8, "no scheme", ""), (9, None, None), (10, "https://notnet/", ""), (11, "http://free.org/2", ""), (12, "https://b.org/x", link("/y")), (13, "https://c.org/?u=http://x.net/", ""),
        (14, "https://d.org/1", link("https://gone.net/")),
    ]
    pages = spark.createDataFrame([(*r, "block") for r in rows], "page_id long, url string, html string, verdict string")
    out = by_id(urls.judged(pages, URL_RULES), "page_id")
    want = {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: ("example.com/de/", "block"), 4: ("org/fr/", "allow"), 5: (None, "block"), 6: (None, "block"), 7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "allow"), 13: (None, "allow"), 14: (None, "block")}
    assert {i: (r.rule, r.verdict) for i, r in out.items()} == want
    assert (out[2].host, out[2].path, out[8].host, out[9].path, out[13].host) == ("example.net", "/en/b", "", "", "c.org")
    assert urls.judged(pages.limit(0), URL_RULES).count() == 0
    redirects = spark.createDataFrame([("https://b.org/x", "https://x.net/a"), (None, "x")], "from_url string, to_url string")
    assert by_id(urls.judged(pages, URL_RULES, redirects), "page_id")[12].verdict == "block"


def test_relative_links(spark):
    want = {
        "index.html": "h.org/a/b/index.html", "./x": "h.org/a/b/x", "../x": "h.org/a/x", "../../../x?q=../1#f": "h.org/x?q=../1", "?p=1": "h.org/a/b/c?p=1", ".": "h.org/a/b/", "..": "h.org/a/", "x/../y/./z": "h.org/a/b/y/z",
        "/y/../z": "h.org/z", "//i.org/./k": "i.org/k", "HTTPS://I.org:443/k": "i.org/k", "/go?u=http://i.org/": "h.org/go?u=http://i.org/", "#top": "h.org/a/b/c?d/e", "mailto:a@i.org": None, "": None,
    }
    df = spark.createDataFrame([("http://h.org/a/b/c?d/e#g", k) for k in want], "url string, link string")
    assert {r.link: r.node for r in df.select("link", urls.node_of(urls.resolved(df.link, df.url)).alias("node")).collect()} == want
    refresh = lambda to: f'<meta http-equiv="refresh" content="0;url={to}">'
    rows = [(1, "http://x.net/a/b", "")] + [(i + 2, f"http://free.org/{i}", refresh(f"http://x.net/{i}")) for i in range(4)]
    rows += [(10 + i, f"http://own{i}.org/d/p", refresh(to)) for i, to in enumerate(["q.html", "./q.html", "../d/q.html", "?p=1", "#f"])]
    rows += [(20 + i, f"http://own{i}.org/d/{'p?p=1' if i == 3 else 'q.html'}", refresh("http://x.net/a/b")) for i in range(5)]
    out = by_id(urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES), "page_id")
    assert [out[10 + i].verdict for i in range(5)] == ["block"] * 4 + ["allow"]
    bare = urls.node_of(urls.resolved(df.link, F.lit("no scheme")))
    assert {r.link for r in df.select("link", bare.alias("node")).where("node IS NOT NULL").collect()} == {"//i.org/./k", "HTTPS://I.org:443/k"}


# --- pipeline ----------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(f"Word{i}x{j}," for j in range(60)) for i in range(40)]
    texts[3], texts[5] = texts[2] + " end", " ".join(texts[4].split()[:30] + [f"own{j}" for j in range(30)])
    bench = texts[6]
    texts += [f"### $$$ !!! {i} " * 20 for i in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40)) for i in range(70)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    clean = set(range(40)) - {3, 6}
    assert clean <= set(rows) and not {3, 6, *range(40, 70)} & set(rows)
    left = " ".join(f"own{j}" for j in range(30))
    library = __import__("tokenizers").Tokenizer.from_file(word_vocabulary())
    assert list(rows[5].ids) == library.encode(left, add_special_tokens=False).ids
    assert list(rows[4].ids) == library.encode(texts[4], add_special_tokens=False).ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "bpe"]


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    text = lambda name: " ".join(f"{name}x{j}," for j in range(60))
    bad = "### $$$ !!! " * 20
    learn = [(i, text(f"Learn{i}")) for i in range(30)] + [(i, f"### $$$ !!! {i} " * 20) for i in range(30, 60)]
    rows = [
        (None, text("NullGood")), (None, bad), (None, text("Bench")), (None, text("Learn1") + " " + text("NullOwn")),  # cut to the last part
        (None, text("NullTwice")), (None, text("NullTwice")), (100, text("Again")), (100, text("Again")),
        (101, text("Learn2") + " " + text("Tail")), (101, text("Whole")), (101, bad), (101, text("Clean")), (101, "One " + text("Bench")), (102, text("Whole") + " end"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in learn + rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text("Bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        left = spark.read.parquet(f"{tmp_path}/{i}")
    out = sorted((r.doc_id or -1, r.text) for r in left.collect() if r.doc_id is None or r.doc_id >= 100)
    assert all(r.n_chars == len(r.text) for r in left.collect())
    want = [(-1, text("NullGood")), (-1, text("NullOwn")), (-1, text("NullTwice")), (100, text("Again")), (100, text("Again"))]
    assert out == sorted([*want, (101, text("Tail")), (101, text("Whole")), (101, text("Clean"))])
