from __future__ import annotations

import functools
import itertools
import random
import re
import sqlite3
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from vitrine.functions import columns as fn
from vitrine.functions import encoders
from vitrine.functions.images import image_header, is_image_content
from vitrine.operators import browse, fulltext, ingest, intervals, profile, ranking, routing, search
from vitrine.operators.fulltext import Phrase
from vitrine.plans import planner
from vitrine.sources import files as sources
from vitrine.streaming import limits


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "low", "high"),
    [("1860s", 1860, 1869), ("1900s", 1900, 1909), ("1400s", 1400, 1499), ("1914-1918", 1914, 1918), ("1918–1914", 1914, 1918), ("1860", 1860, 1860), ("50s", 50, 59), ("5-20", 5, 20), ("7", 7, 7), ("18605", None, None), ("undated", None, None), (None, None, None), ("", None, None)],
)
def test_years(spark, value, low, high):
    row = spark.createDataFrame([(value,)], "x string").select(*(c.alias(n) for c, n in zip(fn.years(F.col("x")), "ab", strict=True))).first()
    assert (row.a, row.b) == (low, high)


def test_scalars(spark):
    assert one(spark, "a/b c+d.JPG", fn.item_id) == "YS9iIGMrZC5KUEc"
    assert one(spark, "x" * 200, fn.item_id).isascii()
    assert one(spark, "https://h.org/a%20b+c.jpg?x", fn.url_key) == "a b+c.jpg"
    assert one(spark, "plain/key", fn.url_key) == "plain/key"
    assert one(spark, "a/.b/Photo.TIFF", fn.extension) == "tiff"
    assert one(spark, "Élan ﬁn", fn.fold) == "elan fin"
    assert one(spark, "TE.E38", fn.shape) == "AA.A99"
    assert one(spark, "a, b , c", lambda c: fn.client_address(c, 2, F.lit("peer"))) == "b"
    assert one(spark, "spoofed", lambda c: fn.client_address(c, 2, F.lit("peer"))) == "peer"
    assert one(spark, None, lambda c: fn.client_address(c, 1, F.lit("peer"))) == "peer"
    assert one(spark, "a, b", lambda c: fn.client_address(c, 0, F.lit("peer"))) == "peer"
    assert one(spark, [0.0, 0.0], fn.normalized, "array<float>") == [0.0, 0.0]
    assert one(spark, "IMG_20481.JPG", fn.name_template) == "IMG_<n5>.jpg"
    assert one(spark, "36b92e1c7d9c04f81a357f9e8f5dcecd_4.jpg", fn.name_template) == "<hex32>_<n1>.jpg"
    assert one(spark, "1234567890123456_1862s.JPG", fn.name_template) == "<hex16>_<year>.jpg"
    assert one(spark, "1599-scan12", fn.name_template) == "<n4>-scan<n>"
    meaning = lambda name: one(spark, name, lambda c: fn.template_meaning(fn.name_template(c), c))
    assert meaning("DSC_0042.JPG").startswith("camera") and meaning("36b92e1c7d9c04f81a357f9e8f5dcecd.jpg").startswith("hash")
    assert meaning("view 1862.jpg").startswith("may contain a year") and meaning("plate_00012.tif").startswith("fixed prefix 'plate'") and meaning("00012.tif") == "carries no usable information" and meaning("harbour.tif") == ""


@pytest.mark.parametrize("text", ["Élan ﬁn ½ ² Ǆ", "ΑΒΓ Σίσυφος", "İstanbul", "한글 e\u0301", "plain", "", None, "Œuvre straße Ąć 𝔘"])
def test_fold_is_the_rule(spark, text):
    want = None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    assert one(spark, text, fn.fold) == want


def test_plain_text_and_figures(spark):
    assert one(spark, "A <i>red</i> sea &amp; &lt;b&gt;boats&lt;/b&gt;", fn.plain_text) == "A red sea & boats"
    assert one(spark, "caf&eacute; &#233;&#xe9; &notit; &amp;eacute; R&D <b>x</b>", fn.plain_text) == "café éé ¬it; &eacute; R&D x"
    assert one(spark, None, fn.plain_text) is None and one(spark, "&amp;amp;", fn.plain_text) == "&amp;"
    assert one(spark, "2 &lt; 3", fn.plain_text) == "2 < 3" and one(spark, "a > b", fn.plain_text) == "a > b"
    assert [one(spark, v, fn.human_bytes, "long") for v in (0, 1023, 1024, 5 * 1024**3, 2048 * 1024**4)] == ["0 B", "1,023 B", "1.0 KB", "5.0 GB", "2,048.0 TB"]
    assert [one(spark, v, fn.human_duration, "double") for v in (5.9, 61.0, 7260.0)] == ["5 s", "1 min 1 s", "2 h 1 min"]
    assert [one(spark, v, fn.clock, "double") for v in (3723.0, -1.0, float("nan"), float("inf"))] == ["01:02:03", *["--:--:--"] * 3]
    assert one(spark, "1885", fn.date_forms) == ["1885", "1880s"] and one(spark, "1880S", fn.date_forms) == ["1880s"]
    assert [one(spark, v, fn.is_query_date) for v in ("1885", "1880s", "2999", "1865s", "188")] == [True, True, False, False, False]


def osa_by_hand(a, b):
    """By the definition: the last letters stay, change, come, go or are swapped."""
    if not a or not b:
        return len(a) + len(b)
    ways = [osa_by_hand(a[:-1], b) + 1, osa_by_hand(a, b[:-1]) + 1, osa_by_hand(a[:-1], b[:-1]) + (a[-1] != b[-1])]
    if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1]:
        ways.append(osa_by_hand(a[:-2], b[:-2]) + 1)
    return min(ways)


def test_osa(spark):
    rnd = random.Random(5)
    pairs = [("ab", "ba"), ("ca", "abc"), ("kitten", "sitt"), ("x", "x"), ("müßig", "mißüg"), *(("".join(rnd.choices("abc", k=rnd.randrange(1, 6))), "".join(rnd.choices("abc", k=rnd.randrange(1, 6)))) for _ in range(60))]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fn.osa(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in rows] == [osa_by_hand(r.a, r.b) for r in rows]
    assert "Python" not in spark.createDataFrame(pairs, "a string, b string").select(fn.osa(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stored", [True, False])
def test_spellings_are_those_of_all_pairs(spark, stored):
    """Against every word of the vocabulary: edits at both ends and behind the compared beginnings, swaps, rare and seen words."""
    rnd = random.Random(8)
    vocab = {"".join(rnd.choices("abcd", k=rnd.randrange(3, 16))): rnd.randrange(1, 9) for _ in range(150)} | {"abc4": 9, "ünïcödé": 5}
    asked = set()
    for w in vocab:
        for _ in range(3):
            own = list(w)
            for _ in range(rnd.randrange(1, 3)):
                i = rnd.randrange(len(own))
                kind = rnd.randrange(4)
                if kind == 0 and len(own) > 2:
                    own.pop(i)
                elif kind == 1:
                    own.insert(i, rnd.choice("abcd"))
                elif kind == 2:
                    own[i] = rnd.choice("abcd")
                elif i + 1 < len(own):
                    own[i], own[i + 1] = own[i + 1], own[i]
            asked.add("".join(own))
    want = {}
    distance = functools.cache(osa_by_hand)
    for w in asked:
        edits = 0 if len(w) <= 4 else 1 if len(w) <= 7 else 2
        near = [(d, -n, t) for t, n in vocab.items() if w.isalpha() and t.isalpha() and n >= 3 and t[0] == w[0] and abs(len(t) - len(w)) <= edits and len(set(w) ^ set(t)) <= 4 and (d := osa_table(w, t)) <= edits]
        if w not in vocab and edits and near:
            want[w] = min(near)[2]
    assert len(want) > 100 and distance("ab", "ba") == 1
    table = spark.createDataFrame(list(vocab.items()), "term string, records long")
    near = fulltext.neighbours(table) if stored else None
    found = fulltext.spellings(spark.createDataFrame([(w,) for w in asked], "word string"), table, near=near)
    assert {r.word: r.correction for r in found.collect()} == want


def osa_table(a, b):
    """The same as ``osa_by_hand`` for longer words."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and (a[i - 1], a[i - 2]) == (b[j - 2], b[j - 1]):
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_intervals(spark, seed):
    rnd = random.Random(seed)

    def some(n, wide):
        rows = []
        for i in range(n):
            low = rnd.randrange(-50, 2000)
            rows.append((i % 37, rnd.choice([low, low, low, None]), rnd.choice([low + rnd.choice([0, 0, 1, 3, wide, -2]), low, None])))
        return rows

    left, right = some(120, 300), some(60, 2500)
    meets = lambda a, b: (a[1] is None or a[2] is None or a[1] <= a[2]) and (b[1] is None or b[2] is None or b[1] <= b[2]) and (a[1] is None or b[2] is None or a[1] <= b[2]) and (b[1] is None or a[2] is None or b[1] <= a[2])
    want = sorted(((a, b) for a in left for b in right if meets(a, b)), key=repr)
    one = spark.createDataFrame(left, "`a.b` long, low int, high int")
    two = spark.createDataFrame(right, "bin long, low int, high int")
    found = intervals.overlapping(one, two, ("low", "high"), ("low", "high"))
    assert sorted(((tuple(r.left), tuple(r.right)) for r in found.collect()), key=repr) == want
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    assert intervals.overlapping(one.limit(0), two, ("low", "high"), ("low", "high")).count() == 0


@pytest.fixture(scope="module")
def items(spark):
    rows = [("i0", 0, "g1", "o0", "r0", [1.0, 0.0]), ("i1", 1, "g1", "o0", "r0", [0.8, 0.6]), ("i2", 2, "g2", "o0", "r0", [0.0, 1.0]), ("i3", 3, "g2", "o1", "r1", [0.8, 0.6]), ("i4", 4, "g2", "u4", None, [0.6, 0.8])]
    return spark.createDataFrame(rows, "item_id string, pos long, group_id string, object_id string, record_id string, embedding array<float>").cache()


def test_ranking(items):
    rows = ranking.ranked(items, [1.0, 0.0], 10).collect()
    assert [r.item_id for r in rows] == ["i0", "i3", "i4"]
    assert [r.item_id for r in ranking.ranked(items, [1.0, 0.0], 10, by_object=False).collect()] == ["i0", "i1", "i3", "i4", "i2"]
    pages = [ranking.ranked(items, [1.0, 0.0], 1, offset=i).first().object_id for i in range(3)]
    assert pages == ["o0", "o1", "u4"]
    flat = ranking.ranked(items, [1.0, 0.0], 10, transform=lambda s: F.lit(1.0)).collect()
    assert [r.object_id for r in flat] == pages
    with pytest.raises(KeyError):
        ranking.vector_of(items, "nothing")


def test_samples(items):
    seen = [r.object_id for page in range(3) for r in ranking.sampled(items, "s", 1, page).collect()]
    assert sorted(seen) == ["o0", "o1", "u4"]
    assert seen == [r.object_id for r in ranking.sampled(items, "s", 3).collect()]


def test_fusion(spark):
    ranks = lambda *rows: spark.createDataFrame(list(rows), "object_id string, rank int")
    visual, keyword = ranks(("a", 1), ("b", 2)), ranks(("b", 1), ("c", 2))
    rows = {r.object_id: r for r in ranking.fused(visual, keyword, (1.0, 1.0)).collect()}
    assert rows["b"].score == pytest.approx(1 / 62 + 1 / 61)
    assert {r.object_id for r in ranking.fused(visual, keyword, (0.0, 1.0)).collect()} == {"b", "c"}
    assert [r.object_id for r in ranking.fused_page(ranking.fused(visual, keyword, (1.0, 1.0)), 3).collect()] == ["b", "a", "c"]


def test_masks_and_counts(spark, items):
    assert browse.wanted_groups(" g2 ,g1,g2,", ["g1", "g2"]) == ["g2", "g1"]
    assert browse.wanted_groups("  ", ["g1"]) is None
    with pytest.raises(ValueError, match="g9"):
        browse.wanted_groups("g9", ["g1"])
    with pytest.raises(ValueError):
        browse.checked("limit", 0)
    assert browse.masked(items).count() == 5
    assert browse.masked(items, ["g2"], cataloged_only=True).count() == 2
    groups = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "group_id string")
    rows = {r.group_id: (r.images, r.objects) for r in browse.group_summary(items, groups).collect()}
    assert rows == {"g1": (2, 1), "g2": (3, 3), "g3": (0, 0)}
    # a filter of the whole is the merge of the shards
    whole = {r.item_id for r in browse.masked(items, ["g1", "g2"]).collect()}
    assert whole == {r.item_id for g in ("g1", "g2") for r in browse.masked(items, [g]).collect()}


def test_facets(spark):
    rows = [("r1", "topic", "Sea"), ("r1", "place", "Rome"), ("r2", "topic", "sea"), ("r2", "date", "1860s"), ("r3", "date", "1400s")]
    facets = spark.createDataFrame(rows, "record_id string, facet string, value string")
    ids = lambda *a: sorted(r.record_id for r in browse.matching_records(facets, *a).collect())
    assert ids({"topic": ["SEA", "land"]}) == ["r1", "r2"]
    assert ids({"topic": ["sea"], "place": ["rome"]}) == ["r1"]
    assert ids({}, 1865, None) == ["r2"]
    assert ids({"topic": ["sea"]}, 1450, 1470) == []
    assert browse.matching_records(facets, {"topic": [" "]}) is None
    with pytest.raises(ValueError):
        browse.matching_records(facets, {}, 1900, 1800)


def test_bm25_is_that_of_sqlite(spark):
    rnd = random.Random(3)
    words = ["red", "blue", "sea", "boat", "old", "new"]
    rows = [(str(i), " ".join(rnd.choices(words, k=rnd.randrange(1, 9))), " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, notes)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    fields = spark.createDataFrame([(i, f, v) for i, title, notes in rows for f, v in (("title", title), ("notes", notes))], "record_id string, field string, value string")
    tokens = fulltext.tokens(fields).cache()
    cases = [
        ('"red" AND ("boat" OR "old")', [[Phrase(("red",))], [Phrase(("boat",)), Phrase(("old",))]]),
        ('"blue sea" AND "new"', [[Phrase(("blue", "sea"))], [Phrase(("new",))]]),
        ('title:"old" AND "red red"', [[Phrase(("old",), "title")], [Phrase(("red", "red"))]]),
    ]
    for text, query in cases:
        want = dict(db.execute("SELECT id, bm25(t, 0, 10.0, 1.0) FROM t WHERE t MATCH ?", (text,)).fetchall())
        got = {r.record_id: r.score for r in fulltext.bm25(tokens, query).collect()}
        assert got.keys() == want.keys()
        assert got == pytest.approx(want)


def test_copies_tie_exactly(spark, tmp_path):
    """Scores don't hang on the order in which rows are added up, so of copies the ids decide, with many phrases and clauses and with weights in fractions."""
    rnd = random.Random(5)
    named = "one two three four five six seven eight".split()
    copies = [f"c{i:03}" for i in range(200)]
    rows = [(r, f, " ".join(named)) for r in copies for f in ("title", "names", "places", "notes")]
    rows += [(f"d{i:03}", "notes", " ".join(w for j, w in enumerate(named) if rnd.random() < 0.03 * (j + 1)) or "x") for i in range(700)]
    fields = spark.createDataFrame(rows, "record_id string, field string, value string").repartition(7)
    fulltext.write_index(fields, str(tmp_path / "i"), buckets=4)
    index, live = fulltext.Index(spark, str(tmp_path / "i")), fulltext.Live(fulltext.tokens(fields))
    any_of, all_of = [[Phrase((w,)) for w in named]], [[Phrase((w,))] for w in named]
    fractions = {"title": 0.1, "names": 0.2, "places": 0.3, "notes": 0.15}
    pages = {"any": live.bm25(any_of), "all": live.bm25(all_of), "weights": live.bm25(any_of, fractions), "one word": live.bm25(all_of[:1], fractions), "index": index.bm25(any_of), "blocks": index.top(any_of, 2000)}
    found = {name: [(r.record_id, r.score) for r in page.orderBy("score", "record_id").collect() if r.record_id[0] == "c"] for name, page in pages.items()}
    assert {name: len({s for _, s in rows}) for name, rows in found.items()} == dict.fromkeys(pages, 1)
    assert all([r for r, _ in rows] == copies for rows in found.values())


CATALOG = {
    "ra": {"title": "Star quilt", "names": "Doe, Jane", "dates": "1880s", "topics": "Quilts", "object_types": "quilt", "identifiers": "TE.E388879", "notes": "A quilt with stars by Jane Doe"},
    "rb": {"title": "Percussion rifle", "names": "Roe, John\nDoe, Jim", "places": "Ohio", "topics": "Firearms", "identifiers": "TE.E100001", "notes": "A rifle"},
    "rc": {"title": "Bed cover", "dates": "1885", "notes": "Pieces of quilts, from percussion halls"},
    "rd": {"title": "Not shown", "notes": "quilt percussion"},
}
ASKED = [
    "portrait of jane doe", "Jane Doe", "cover stars", "stars cover", "quilt", "a quilt with stars", "the of", "1885", "1880s", "TE.E388879", "percusion  rifle", "percusion rifle", "teaa",
    'title:sea “star quilt” 1862 maker:"Jane Doe"', "quilt rifle", "zeppelin", "title:zeppelin", "2001",
]
NAMES = ["title", "names", "dates", "places", "topics", "object_types", "identifiers", "notes"]


@pytest.fixture(scope="module")
def catalog(spark):
    """Objects with their images, the catalog's text as it is, and what a planner needs of it."""
    rows = [("i0", 0, "east", "ra", "ra", [1.0, 0.0]), ("i1", 1, "east", "ra", "ra", [0.8, 0.6]), ("i2", 2, "west", "rb", "rb", [0.6, 0.8]), ("i3", 3, "east", "rc", "rc", [0.0, 1.0]), ("i4", 4, "west", "u4", None, [0.28, 0.96])]
    items = spark.createDataFrame(rows, "item_id string, pos long, group_id string, object_id string, record_id string, embedding array<float>").cache()
    fields = spark.createDataFrame([(r, f, v) for r, own in CATALOG.items() for f, v in own.items()], "record_id string, field string, value string")
    tokens = fulltext.tokens(fields).cache()
    terms = [("Doe, Jane", "name", 3), ("Roe, John", "name", 2), ("Doe, Jim", "name", 1), ("Ohio", "place", 1), ("Quilts", "topic", 2), ("quilt", "object_type", 3), ("Firearms", "topic", 1), ("bed cover of stars", "topic", 1)]
    gazetteer = fulltext.gazetteer(spark.createDataFrame(terms, "term string, field string, record_count long")).cache()
    vocab = fulltext.vocabulary(tokens).withColumn("records", F.col("records") + 2).cache()  # as if every word stood in some more records
    shapes = fulltext.identifier_shapes(fields, 2).cache()
    known = (tokens, vocab, gazetteer, shapes)
    # all at once: a table of queries is planned as fast as one
    made = {c: dict(zip(ASKED, planner.plans(ASKED, *known, NAMES, correct=c), strict=True)) for c in (True, False)}
    return items, fulltext.Live(tokens), lambda q, correct=True: made[correct][q], known


def test_kinds_of_queries(spark, catalog):
    """A table of queries is routed as a whole."""
    want = {
        "Jane Doe": "name", "doe, jane": "name", '"star quilt"': "phrase", "title:rifle": "field", "TE.E388879": "identifier", "1885": "date", "1880s": "date", "1865s": "description", "2999": "description",
        "Ohio": "place", "quilt": "object_type", "jane": "name", "firearm": "topic", "a red blanket on a bed": "description", "title:rifle 1885": "field", "": "description", "ÖHIO": "place", "nofield:x": "description",
    }
    queries = spark.createDataFrame(list(enumerate(want)), "query_id int, query string")
    rows = routing.routed(queries, *catalog[3], NAMES).collect()
    assert {r.query: r.kind for r in rows} == want and len(rows) == len(want)


def test_plans(catalog):
    plan = catalog[2]
    assert plan("portrait of jane doe").matched == {"term": "Doe, Jane", "field": "name", "records": 3, "whole": False}
    assert plan("portrait of jane doe").weights() == (1.0, 1.0) and plan("Jane Doe").weights() == (0.3, 1.0) and plan("Jane Doe").weights("visual") == (1.0, 0.0)
    assert plan("cover stars").matched["term"] == "bed cover of stars" and plan("stars cover").matched is None
    assert plan("quilt").clauses == [[Phrase(("quilt",)), Phrase(("quilts",))]]
    assert plan("a quilt with stars").terms == ["quilt", "stars"] and plan("the of").terms == ["the", "of"]
    assert plan("1885").clauses == [[Phrase(("1885",), "dates"), Phrase(("1880s",), "dates")]] and plan("1880s").clauses == [[Phrase(("1880s",), "dates")]]
    assert plan("TE.E388879").clauses == [[Phrase(("te", "e388879"), "identifiers")]]
    fixed = plan("percusion  rifle")
    assert fixed.correction == {"from": "percusion  rifle", "to": "percussion rifle"} and fixed.text == "percussion rifle"
    assert plan("percusion rifle", correct=False).correction is None and plan("teaa").correction is None and plan("quilt").correction is None
    both = plan('title:sea “star quilt” 1862 maker:"Jane Doe"')
    assert both.kind == "field" and both.matched == {"field": "title"} and both.terms == ["1862", "star quilt", "sea", "Jane Doe"]
    assert both.clauses == [[Phrase(("1862",))], [Phrase(("star", "quilt"))], [Phrase(("sea",), "title")], [Phrase(("jane", "doe"), "names")]]


def test_hybrid_search(spark, catalog):
    items, text, plan, _ = catalog
    seen = []

    def run(query, **more):
        found = search.hybrid(items, text, plan(query), lambda t: seen.append(t) or [1.0, 0.0], 10, **more)
        return found, [(r.object_id, r.explanation) for r in found.results.collect()]

    found, rows = run("quilt", mode="keyword")
    assert rows == [("ra", "Matches the title and kind of object"), ("rc", "Matches the description")] and not seen
    assert {r.group_id: r.objects for r in found.groups.collect()} == {"east": 2} and found.empty is None
    assert [r.item_id for r in found.results.collect()] == ["i0", "i3"]
    assert [o for o, _ in run("quilt", mode="visual")[1]] == ["ra", "rb", "u4", "rc"] and seen == ["quilt"]
    assert [o for o, _ in run("quilt", mode="visual", cataloged_only=True)[1]] == ["ra", "rb", "rc"]
    found, rows = run("quilt", mode="keyword", groups=["west"])
    assert rows == [] and found.empty["kind"] == "outside_groups" and {r.group_id: r.objects for r in found.groups.collect()} == {"east": 2}
    chosen = lambda *ids: spark.createDataFrame([(i,) for i in ids], "record_id string")
    assert [o for o, _ in run("quilt", records=chosen("rc"))[1]] == ["rc"]
    assert run("quilt", mode="keyword", records=chosen("rb"))[0].empty["kind"] == "filtered_out"
    assert run("quilt", mode="keyword", groups=["west"], records=chosen("ra"))[0].empty["kind"] == "outside_groups"
    found, rows = run("quilt rifle")
    assert found.empty["message"] == "No records mention both “quilt” and “rifle”; showing visually similar items" and rows
    assert run("zeppelin")[0].empty["terms"] == ["zeppelin"] and run("title:zeppelin")[0].empty["message"] == "No records have “zeppelin” in the title field"
    assert run("2001", mode="keyword")[0].empty["message"] == "No records are dated “2001”"
    assert [o for o, _ in run("1885", mode="keyword")[1]] == ["rc", "ra"] and run("TE.E388879")[1] == [("ra", "Matches the catalog number")]
    assert run("Jane Doe")[0].message == "Treated as a name query; matching the catalog first" and "“Doe, Jane”" in run("portrait of jane doe")[0].message
    one = run("quilt", mode="hybrid", k=0)[0].results.first()
    assert one.object_id == "ra" and one.score == pytest.approx(2.0) and one.similarity == pytest.approx(1.0)
    with pytest.raises(ValueError):
        run("quilt", page=2000)


def test_an_object_with_two_records_is_one_hit(spark):
    items = spark.createDataFrame([("a", 0, "g", "o", "r1", [1.0]), ("b", 1, "g", "o", "r2", [1.0])], "item_id string, pos long, group_id string, object_id string, record_id string, embedding array<float>")
    scores = spark.createDataFrame([("r1", -1.0), ("r2", -2.0)], "record_id string, score double")
    assert [tuple(r) for r in search.keyword_objects(scores, items).collect()] == [("o", "r2", -2.0)]


def test_written_index(spark, tmp_path, catalog):
    fields = spark.createDataFrame([(r, f, v) for r, own in CATALOG.items() for f, v in own.items()], "record_id string, field string, value string")
    terms = spark.createDataFrame([("Doe, Jane", "name", 3)], "term string, field string, record_count long")
    fulltext.write_index(fields, str(tmp_path / "index"), terms, buckets=8)
    index = fulltext.Index(spark, str(tmp_path / "index"))
    query = [[Phrase(("quilt",)), Phrase(("star", "quilt"))], [Phrase(("jane",))]]
    same = lambda text: sorted((r.record_id, round(r.score, 9)) for r in text.bm25(query).collect())
    assert same(index) == same(catalog[1]) and same(index)
    assert index.vocabulary.where("term = 'quilt'").first().records == 2 and {r.key for r in index.gazetteer.collect()} == {"doe jane", "jane doe"}
    plan = index.postings(query)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.postings([]).count() == 0


def scanned(df):
    """Rows that the scans of a finished query gave, by what they read."""
    df.collect()
    found, waiting = {}, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
        elif "QueryStage" in name:
            waiting.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                key = re.search(r"Location: InMemoryFileIndex.*?\[(.*?)\]", node.verboseStringWithOperatorId() or "")
                key = key[1].rstrip("/").split("/")[-1] if key else name
                found[key] = found.get(key, 0) + node.metrics().apply("numOutputRows").value()
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_pages_by_block_maxima(spark, tmp_path, monkeypatch):
    """The page is that of all scores, for pages that few and that many blocks reach, and ties; short pages read a part of the blocks."""
    monkeypatch.setattr(fulltext, "BLOCK_RECORDS", 8)
    monkeypatch.setattr(fulltext, "FIRST_BLOCKS", 3)
    monkeypatch.setattr(fulltext, "PAGE_ROWS", 16)
    rnd = random.Random(1)
    rows = []
    for i in range(500):
        rows.append((f"r{i:04}", "notes", " ".join(rnd.choices(["sea", "old", "town", "net", "x", "y", "z"], [1, 2, 2, 1, 20, 20, 20], k=rnd.randrange(1, 120)))))
        if rnd.random() < 0.2:
            rows.append((f"r{i:04}", "title", rnd.choice(["sea", "old town", "the sea"])))
    rows += [(f"s{i}", "notes", "rare sea") for i in range(5)]
    fields = spark.createDataFrame(rows, "record_id string, field string, value string")
    fulltext.write_index(fields, str(tmp_path / "i"), buckets=4)
    index = fulltext.Index(spark, str(tmp_path / "i"))
    word = lambda w: Phrase((w,))
    shown = lambda df: [(r.record_id, round(r.score, 9)) for r in df.collect()]
    for query in ([[word("sea")]], [[word("sea"), word("net")], [word("old")]], [[word("rare")]], [[word("sea")], [word("none")]], [[word("sea"), word("none")]], [[Phrase(("old", "town"))]], [[Phrase(("sea",), "title")]], [[word("x")], [word("y")], [word("z")]]):
        every = shown(index.bm25(query).orderBy("score", "record_id"))
        for limit in (1, 10, 2000):
            page = shown(index.top(query, limit))
            # sums differ in their last digits, so of records with one score others may stand at a page's end
            assert [s for _, s in page] == [s for _, s in every[:limit]] and set(page) <= set(every) and len({r for r, _ in page}) == len(page)
    # a short page comes from the first blocks alone, and their pages are what is read of a word's parts
    assert "impacts" not in scanned(index.top([[word("sea")]], 1))
    blocks = [r["block"] for r in index._read("maxima").where("term = 'sea'").orderBy(F.desc("most")).limit(3).collect()]
    few, every = (scanned(df)["impacts"] for df in (index._of("impacts", ["sea"]).where(F.col("block").isin(blocks)), index._of("impacts", ["sea"])))
    assert few < 0.7 * every


def test_reasons_for_several_plans(spark):
    """A table of plans gives what each gives alone."""
    fields = spark.createDataFrame([("1", "title", "red boat"), ("2", "title", "blue sea"), ("3", "dates", "1885")], "record_id string, field string, value string")
    text = fulltext.Live(fulltext.tokens(fields))
    word = lambda w, f=None: [Phrase((w,), f)]
    plans = [
        planner.Plan("boat", "boat", "description", [word("boat")], ["boat"]),
        planner.Plan("boat sea", "", "description", [word("boat"), word("sea")], ["boat", "sea"]),
        planner.Plan("boat sea red", "", "description", [word("boat"), word("sea"), word("red")], ["boat", "sea", "red"]),
        planner.Plan("boat zeppelin quilt", "", "description", [word("boat"), word("zeppelin"), word("quilt")], ["boat", "zeppelin", "quilt"]),
        planner.Plan("1999", "", "date", [[Phrase(("1999",), "dates"), Phrase(("1990s",), "dates")]], ["1999"]),
        planner.Plan("X.1", "", "identifier", [word("x", "identifiers")], ["X.1"]),
        planner.Plan("title:zz", "", "field", [word("zz", "title")], ["zz"], matched={"field": "title"}),
    ]
    want = [
        ("outside_groups", "No records in the chosen groups match"), ("not_together", "No records mention both “boat” and “sea”"), ("not_together", "No records mention all of “boat”, “sea” and “red”"),
        ("missing", "No records mention “zeppelin” or “quilt”"), ("missing", "No records are dated “1999”"), ("missing", "No record has the catalog number “X.1”"), ("missing", "No records have “zz” in the title field"),
    ]
    assert [(r.kind, r.message) for r in search.empty_reasons(plans, text).orderBy("plan").collect()] == want
    assert [search.empty_reason(p, text)["message"] for p in plans[:4]] == [m for _, m in want[:4]]
    assert [r.message for r in search.route_messages(plans, "auto", spark).orderBy("plan").collect()][4:] == ["Treated as a date; matching catalog dates first", "Looked up as a catalog number", "Searching only the title field of the catalog"]
    assert search.route_messages(plans[:1], "visual", spark).first().message == "Searching by appearance only"


def test_limits_of_parameters(spark, items):
    with pytest.raises(ValueError, match="sample"):
        ranking.sampled(items, "1", 201)
    with pytest.raises(ValueError, match="similar"):
        ranking.similar(items, "i0", 101)
    with pytest.raises(KeyError):
        ranking.similar(items, "none", 3)
    assert "o0" not in {r.object_id for r in ranking.similar(items, "i0", 100).collect()}
    with pytest.raises(ValueError, match="query_chars"):
        search.hybrid(items, None, planner.Plan("x" * 501, "", "description", []), None, 10)


def test_query_syntax():
    known = {"title", "names"}
    read = lambda q: routing.read_syntax(q, known)[1:]
    assert read('boats "old sea" title:red') == (["boats"], ["old sea"], [("title", "red")])
    assert read('title: "blue boat" x') == (["x"], [], [("title", "blue boat")])
    assert read("maker:  Doe rest") == (["rest"], [], [("names", "Doe")])
    assert read('color:"a b" c') == (['color:"a', 'b"', "c"], [], []) and read("color: red") == (["color:", "red"], [], [])
    assert read('an "open quote') == (["an", '"open', "quote"], [], []) and read("title:") == (["title:"], [], []) and read(": x") == ([":", "x"], [], [])
    assert read("“curly” title:“q r”") == ([], ["curly"], [("title", "q r")])
    assert read('10:30 a9title:x ""') == (["10:30", "a9"], [""], [("title", "x")])
    assert read("") == ([], [], [])


def test_spelling(spark):
    vocab = spark.createDataFrame([("portrait", 9), ("portraits", 5), ("port", 9), ("rare", 1)], "term string, records long")
    words = spark.createDataFrame([("portriat",), ("port",), ("rarre",), ("po",)], "word string")
    assert {r.word: r.correction for r in fulltext.spellings(words, vocab).collect()} == {"portriat": "portrait"}


@pytest.mark.parametrize("values", [[5, 1, 4, 4, 2, 9, 9, 7, 3, 8], [7], [-3, -1, -2], [10**9, *range(500)], [3] * 40, [-(1 << 63), (1 << 63) - 1, 0, 5], [1 << 40, 1 << 41, (1 << 41) + 1, -(1 << 40)]])
def test_percentiles(spark, values):
    row = profile.index_percentiles(spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v long"), "k", "v").first()
    s = sorted(values)
    assert (row.p50, row.p90, row.p99) == tuple(float(s[min(len(s) - 1, int(len(s) * f))]) for f in (0.5, 0.9, 0.99))
    assert (row.least, row.most, row.mean, row.n) == (s[0], s[-1], abs(sum(s)) // len(s) * (1 if sum(s) > 0 else -1), len(s))


def test_percentiles_put_few_counts_in_order(spark):
    """Sizes that spread over many powers of two: the rows of each key's windows stay below the counts of a round."""
    rnd = random.Random(2)
    values = {k: [int(rnd.expovariate(1e-9)) for _ in range(4000)] for k in ("a", None)}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    found = {r.k: r for r in profile.index_percentiles(rows, "k", "v").collect()}
    for k, vs in values.items():
        s = sorted(vs)
        assert (found[k].p50, found[k].p90, found[k].p99) == tuple(float(s[int(len(s) * f)]) for f in (0.5, 0.9, 0.99))
    spread = (max(map(max, values.values())) - min(map(min, values.values()))).bit_length()
    assert spread > 2 * profile.DIGIT and (1 << profile.DIGIT) + 1 <= 65_536
    assert profile.index_percentiles(rows.limit(0), "k", "v").count() == 0


def test_directory_roles(spark):
    levels = {"year": [str(1850 + i) for i in range(30)], "year_mostly": [*map(str, range(1900, 1910)), "new", "old", "odd"], "uuid": [f"{i:08x}-1111-2222-3333-444455556666" for i in range(9)], "noise": ["new folder", "untitled", "Temp 3"], "identifier": [f"A_{i:04d}" for i in range(1000, 1009)], "category": ["boats", "towns", "maps"], "constant": ["all"], "unclear": ["a", "b", "1"]}
    for role, names in levels.items():
        rows = spark.createDataFrame([(i, f"{n}/x.jpg") for i, n in enumerate(names * 2)] + [(99, "top.jpg")], "pos int, key string")
        row = profile.directory_signals(rows).first()
        assert (row.role, row.meaningful, row.names) == (role, role in ("year", "year_mostly", "category"), len(names)), role
    assert profile.directory_signals(spark.createDataFrame([(0, "a/b.jpg"), (1, "c.jpg"), (2, "d.jpg")], "pos int, key string")).count() == 0


def jpeg(width, height, exif=b""):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif if exif else b""
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9)


def test_image_headers(spark):
    entry = lambda tag, kind, count, value: struct.pack("<HHII", tag, kind, count, value)
    dated = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry(306, 2, 20, 26) + bytes(4) + b"2001:02:03 04:05:06\0"
    no_place = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry(34853, 4, 1, 26) + bytes(4) + struct.pack("<H", 0)
    placed = no_place[:26] + struct.pack("<H", 2) + entry(2, 5, 3, 0) + entry(4, 5, 3, 0)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 30, 20, 8, 6)
    assert image_header(jpeg(640, 480, dated)) == (640, 480, "RGB", "2001:02:03 04:05:06", False)
    assert image_header(jpeg(10, 20, no_place))[4] is False and image_header(jpeg(10, 20, placed))[4] is True
    assert image_header(png)[:3] == (30, 20, "RGBA") and image_header(b"GIF89a" + struct.pack("<HH", 5, 6))[:2] == (5, 6)
    for broken in (b"", b"PK\3\4", jpeg(1, 1)[:9], png[:18], jpeg(9, 9, dated)[:40]):
        assert image_header(broken)[0] is None
    assert is_image_content(b"\xff\xd8\xff\xe0") and is_image_content(b"", "image/webp") and not is_image_content(b"<html>", "text/html")
    rows = [("a", jpeg(640, 480, dated)), ("b", jpeg(100, 50)), ("c", b"broken"), ("d", None)]
    stats = profile.image_stats(profile.image_headers(spark.createDataFrame(rows, "key string, head binary"))).first()
    assert (stats.sampled, stats.broken, stats.dated, stats.located, stats.width_p50, stats.megapixels, stats.modes) == (4, 2, 1, 0, 640.0, 0.3, "RGB=2")


def test_what_follows_from_a_profile(spark):
    fields = profile.with_file_names(profile.file_fields(20, 12, 0, [{"depth": 0, "names": 4, "role": "year", "meaningful": True}, {"depth": 1, "names": 1, "role": "constant", "meaningful": False}]))
    found = profile.capabilities(fields)
    assert found["facets"] == ["capture_date", "folder_level_1"] and list(found["unavailable"]) == ["geo_map"] and fields[-1]["name"] == "filename"
    assert [x["id"] for x in profile.decisions(3, 0)] == ["include_orphans", "data_residency"]
    row = spark.range(1).select(*(c.alias(k) for k, c in profile.sizing(F.lit(20_481), F.lit(0), "siglip", stored=F.lit(2_676_000.0)).items())).first()
    assert abs(row.copy_bytes - 7.87e9) / 7.87e9 < 0.05
    assert spark.range(1).select(profile.sizing(F.lit(1000), F.lit(0))["copy_bytes"]).first()[0] == 390_000_000
    assert profile.group_column(["a", "Record_ID", "item_id"]) == "Record_ID"


def test_active_seconds(spark):
    rows = [(1, "2024-01-01 23:50:00", "done", 500.0), (2, "2024-01-01 23:59:00.9", "done", 1.0), (3, "2024-01-02 00:05:00", "failed", 1.0), (4, "2024-01-02 08:00:00", "done", 1.0), (5, "2024-01-02 08:15:00", "skipped", 1.0), (6, "2024-01-02 08:40:00", "done", 1.0), (7, "2024-01-02 08:29:00", "pending", 1.0)]
    state = spark.createDataFrame(rows, "id long, t string, status string, elapsed_ms double").selectExpr("id", "CAST(id AS string) AS key", "1048576L AS size_bytes", "status", "'e' AS error", "elapsed_ms", "to_timestamp(t) AS updated_at")
    assert ingest.active_seconds(state).first().active_s == pytest.approx(540 + 360 + 900 + 0.5)  # pending rows bridge no pause
    row = ingest.rates(state).first()
    assert (row.started_at, row.finished_at, row.active_s, row.items_per_s) == ("2024-01-01T23:49:59Z", None, 1800.5, 0.0)
    assert ingest.rates(state.where("status <> 'pending'")).first().finished_at == "2024-01-02T08:40:00Z"
    assert ingest.active_seconds(state.limit(0)).first().active_s == 0 and ingest.rates(state.limit(0)).first().items_per_s is None
    assert [r.key for r in ingest.failed_files(state).collect()] == ["3"]


def test_related_sources(spark):
    cols = "record_id string, source_id string, source string, link_type string, image_id string, url string, title string, thumbnail string, rights string, rights_url string, counts string"
    related = spark.createDataFrame([("r", "s2", "web", "page", None, "u", "t", None, None, None, None), ("r", "s1", "album", "photo", None, "u", None, "x.jpg", "CC", "l", '{"views": 3}'), ("r", "s3", "album", "photo", "i", "u", "t", "", None, None, "broken")], cols)
    tags = spark.createDataFrame([("s1", 1, "b"), ("s1", 0, "a")], "source_id string, position int, tag string")
    rows = browse.related_described(related, tags).orderBy("place").collect()
    assert [(r.id, r.has_thumbnail, r.tags) for r in rows] == [("s3", False, []), ("s1", True, ["a", "b"]), ("s2", False, [])]
    assert (rows[1].rights.name, rows[1].counts, rows[0].rights, rows[2].counts) == ("CC", {"views": 3}, None, {})
    assert [(r.source, r.ids) for r in browse.related_by_source(browse.related_described(related, tags)).orderBy("turn").collect()] == [("album", ["s3", "s1"]), ("web", ["s2"])]
    fields = spark.createDataFrame([("r", 2, "B", "y"), ("r", 1, "A", "x")], "record_id string, position int, label string, value string")
    facets = spark.createDataFrame([("r", "topic", "z"), ("r", "topic", "a")], "record_id string, facet string, value string")
    row = browse.record_details(related.select("record_id"), fields, facets, related, tags).first()
    assert [f.label for f in row.fields] == ["A", "B"] and row.facets == {"topic": ["a", "z"]} and len(row.related) == 3
    with pytest.raises(ValueError, match="colour"):
        browse.matching_records(facets, {"colour": ["red"]})
    with pytest.raises(ValueError, match="keeps no"):
        browse.matching_records(None, {"topic": ["a"]})
    assert browse.matching_records(None, {"topic": [" "]}) is None
    with pytest.raises(ValueError):
        browse.facet_values(facets, "colour", 5)


def test_rate_limit(spark):
    events = spark.createDataFrame([(1, "v", 0.0), (2, "v", 10.0), (3, "v", 61.0), (4, "w", 10.0)], "event_id long, visitor string, ts double")
    rows = {r.event_id: (r.admitted, r.wait_s) for r in limits.limited(events, 1).collect()}
    assert rows == {1: (True, 0), 2: (False, 51), 3: (True, 0), 4: (True, 0)}
    assert all(r.admitted for r in limits.limited(events, 0).collect())


def test_rate_limit_stream(spark, tmp_path):
    schema = "event_id long, visitor string, ts double"
    spark.createDataFrame([(i, "v", float(i)) for i in range(5)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.limited_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2)
    run = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    for _ in range(60):  # timeouts of its states keep the stream going
        if run.awaitTermination(1) or spark.table("limited").count() == 5:
            break
    run.stop()
    assert [r.admitted for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, False, False]


def test_file_sources(spark, tmp_path):
    assert sources.is_parquet("https://h/x.PARQUET?y=1") and not sources.is_parquet("/data/parquet-x")
    assert not sources.is_parquet("/photos/parquet-floors") and sources.is_parquet("data/x?y.parquet")
    for name in ("a/1.jpg", "a/Thumbs.db", ".hidden/3.jpg", "node_modules/4.jpg", "a/.cache/5.jpg", "b c.txt"):
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 10)
    rows = {r.key: (r.size, r.is_image, r.is_junk) for r in sources.open_source(spark, str(tmp_path / "files")).collect()}
    assert rows["a/1.jpg"] == (10, True, False) and rows["a/Thumbs.db"][2]
    assert set(rows) == {"a/1.jpg", "a/Thumbs.db", "b c.txt"}
    heads = {r.key: bytes(r.content) for r in sources.source(spark, str(tmp_path / "files")).contents(4).collect()}
    assert heads["a/1.jpg"] == b"xxxx"
    pages = spark.createDataFrame([("d1", b"one\x0ctwo"), ("d2", None), ("d3", b"!")], "id string, content binary")

    def split():
        def run(content):
            if content == b"!":
                raise ValueError("broken")
            return content.split(b"\x0c") if content else []

        return run

    rows = {r.item_id: (r.page, r.n_pages, r.error) for r in sources.document_pages(pages, split).collect()}
    assert rows == {"d1_1": (1, 2, None), "d1_2": (2, 2, None), "d3": (None, None, "pages: ValueError: broken")}
    kinds = spark.createDataFrame([(b"\x89PNG", "text/html"), (b"<html", "text/html; charset=x"), (None, None)], "content binary, content_type string")
    assert [(r.is_image_content, r.note) for r in sources.with_content_kind(kinds).collect()] == [(True, None), (False, "returns text/html, not image data"), (False, "returns an unknown type, not image data")]
    manifest = spark.createDataFrame([("https://h/a%20b.jpg", "12"), ("plain.png", None)], "URL string, Bytes string")
    assert {r.key: r.size for r in sources.manifest_files(manifest).collect()} == {"a b.jpg": 12, "plain.png": 0}
    with pytest.raises(ValueError):
        sources.manifest_files(spark.createDataFrame([(1,)], "n int"))


def test_collection_files(spark, items, tmp_path):
    folder = str(tmp_path / "collection")
    assert sources.write_collection(items.limit(0), folder, "hash", 2) is None
    with pytest.raises(FileNotFoundError):
        sources.read_collection(spark, folder)
    sources.write_collection(items, folder, "hash", 2, groups={"g2": "West", "g1": "East"})
    info, back = sources.read_collection(spark, folder, 2, "hash")
    assert info["model"] == "hash" and back.count() == 5 and [g["label"] for g in info["groups"]] == ["West", "East"]
    assert [r.item_id for r in back.orderBy("shard", "pos").collect()] == ["i2", "i3", "i4", "i0", "i1"]
    with pytest.raises(ValueError, match="not other"):
        sources.read_collection(spark, folder, model="other")
    with pytest.raises(ValueError):
        sources.write_collection(items, folder, "other", 2)
    with pytest.raises(ValueError):
        sources.read_collection(spark, folder, 3)
    items.where("group_id = 'g1'").drop("group_id").write.mode("append").parquet(f"{folder}/items/group_id=g1")
    with pytest.raises(ValueError, match="descriptor"):
        sources.read_collection(spark, folder)
    (tmp_path / "c.csv").write_text('id,url\n1,"a, ""b"""\n2,\n')
    assert [(r.id, r.url) for r in sources.catalog_csv(spark, str(tmp_path / "c.csv")).orderBy("row").collect()] == [("1", 'a, "b"'), ("2", None)]


def test_ingest_stream(spark, tmp_path):
    from vitrine.streaming import ingest as stream

    folder = tmp_path / "in"
    folder.mkdir()
    for name, size in (("a.jpg", 3), ("b.png", 4), ("c.txt", 3), ("large.jpg", 99)):
        (folder / name).write_bytes(b"x" * size)

    def factory():
        def encode(contents):
            if any(len(c) == 4 for c in contents):
                raise ValueError("broken")
            return [[float(len(c))] for c in contents]

        return encode

    one_by_one = encoders.Encoder("lengths", 1, factory, factory)

    def run(model=one_by_one):
        stream.start(stream.files_stream(spark, str(folder), settled=0), str(folder), str(tmp_path / "log"), str(tmp_path / "check"), model, 50).awaitTermination(180)
        return {r.key: r.status for r in spark.read.parquet(str(tmp_path / "log")).collect()}

    assert run() == {"a.jpg": "done", "b.png": "failed", "large.jpg": "skipped"}
    (folder / "d.jpg").write_bytes(b"xx")
    assert run() == {"a.jpg": "done", "b.png": "failed", "large.jpg": "skipped", "d.jpg": "done"}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    with pytest.raises(ValueError, match="lengths"):
        run(encoders.hashing(8))


def test_encoders(spark):
    from vitrine.streaming import ingest as stream

    assert encoders.encoder("HASH").dimensions == 64
    with pytest.raises(ValueError, match="'hash'"):
        encoders.encoder("other")
    models = [{"key": "a", "name": "A1"}, {"key": "b", "name": "B1"}]
    assert encoders.chosen(models, "B1")["key"] == "b" and encoders.chosen(models, default="b")["key"] == "b" and encoders.chosen(models)["key"] == "a" and encoders.chosen([]) is None
    with pytest.raises(ValueError):
        encoders.chosen(models, "C")
    files = spark.createDataFrame([(str(i), str(i), 1, bytes([i])) for i in range(70)], "id string, key string, size_bytes long, content binary").coalesce(1)
    def make():
        def encode(contents):
            if bytes([40]) in contents:
                raise ValueError("broken")
            return encoders.hashed(contents, 4)

        return encode

    rows = stream.encoded(files, encoders.Encoder("x", 4, make, make)).collect()
    assert {int(r.id) for r in rows if r.status == "failed"} == {40} and all(len(r.embedding) == 4 for r in rows if r.status == "done")
