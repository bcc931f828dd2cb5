"""Listings, reads and the ingest stream on folders as cameras, desktops and interrupted copies leave them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from vitrine.functions import encoders
from vitrine.functions.columns import url_key
from vitrine.operators import profile
from vitrine.sources import files as sources
from vitrine.sources import listing, stores, uploads
from vitrine.sources.state import StateTable
from vitrine.streaming import ingest as stream

NAMES = ["_DSC0001.jpg", "DSC0002.jpg", "100%.jpg", "a%41.jpg", "aA.jpg", "a b+c.png", "ü/ß.jpg", ".DS_Store", "._x.jpg", "Thumbs.db", "_sub/.hidden.jpg", "deep/er/est/x.tif", ".git/config.jpg", "node_modules/y.jpg", ".thumbs/z.jpg", "notes.txt"]
PRUNED = {".git/config.jpg", "node_modules/y.jpg", ".thumbs/z.jpg"}


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "card"
    for i, name in enumerate(NAMES):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(bytes([i]) * (i + 1))
    os.symlink(top / "gone.jpg", top / "dangling.jpg")
    os.symlink(top, top / "deep" / "loop")
    return top


def test_all_names_are_listed(spark, folder):
    rows = {r.key: r for r in sources.folder_files(spark, str(folder)).collect()}
    assert set(rows) == set(NAMES) - PRUNED | {"dangling.jpg"}
    bad = rows["dangling.jpg"]
    assert bad.size is None and bad.error.startswith("FileNotFoundError") and bad.ext == "" and not bad.is_image
    assert all(r.error is None and r["size"] == NAMES.index(r.key) + 1 for r in rows.values() if r.key != "dangling.jpg")
    assert rows["_DSC0001.jpg"].is_image and rows["100%.jpg"].is_image and rows[".DS_Store"].is_junk and rows["._x.jpg"].is_junk and rows["Thumbs.db"].is_junk
    assert len({r.id for r in rows.values()}) == len(rows)
    assert rows["ü/ß.jpg"].absolute_key == f"{folder}/ü/ß.jpg"


def test_a_folder_that_cannot_be_opened_is_a_row(spark, tmp_path):
    rows = sources.folder_files(spark, str(tmp_path / "none")).collect()
    assert [(r.key, r["size"]) for r in rows] == [("", None)] and "FileNotFoundError" in rows[0].error


def test_scan_of_a_messy_folder(spark, folder):
    found = sources.folder_files(spark, str(folder)).withColumn("pos", F.monotonically_increasing_id())
    totals = profile.scan_totals(profile.classified(found)).first()
    assert (totals.files, totals.images, totals.unreadable, totals.others) == (14, 9, 1, 4)
    issues = {(r.kind, r.name): r.files for r in profile.scan_issues(found).collect()}
    assert issues == {("junk_file", ".ds_store"): 1, ("junk_file", "._x.jpg"): 1, ("junk_file", "thumbs.db"): 1, ("unreadable", ""): 1, ("non_image", "txt"): 1, ("tiny_image", ""): 9}


def test_filters_reach_the_walk(spark, folder):
    found = sources.listed(spark, str(folder))
    some = found.where("key LIKE 'deep/%' AND size > 2 AND size <= 12")
    assert [r.key for r in some.collect()] == ["deep/er/est/x.tif"]
    wanted = listing.Wanted()
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual, StringEndsWith, StringStartsWith

    assert wanted.take(StringStartsWith(("key",), "deep/")) and wanted.take(GreaterThan(("size",), 2)) and wanted.take(LessThanOrEqual(("size",), 12)) and not wanted.take(StringEndsWith(("key",), "f"))
    assert wanted.folder("deep") and wanted.folder("deep/er") and not wanted.folder("ü") and (wanted.least, wanted.most) == (3, 12)
    assert [r.key for r in found.where("key = 'aA.jpg'").collect()] == ["aA.jpg"]
    assert found.where("error IS NOT NULL").count() == 1


def test_a_tree_is_shared_among_tasks(folder, monkeypatch):
    store, wanted = stores.opened(str(folder)), listing.Wanted()
    whole = sorted(e.key for e in listing.walked(store, listing.Folders([""], []), wanted))
    for looked in (1, 2, 256):
        monkeypatch.setattr(listing, "LOOKED_INTO", looked)
        parts = listing.shared(store, wanted)
        assert sorted(e.key for p in parts for e in listing.walked(store, p, wanted)) == whole


COUNTING = """
import os
from vitrine.sources.stores import MountedFolder

class Counting(MountedFolder):
    def __init__(self, uri):
        super().__init__(uri.removeprefix("counting:"))

    def read(self, key, limit=None):
        data = super().read(key, limit)
        with open(os.path.join(self.root, "notes.txt"), "a") as notes:
            notes.write(f"{key} {len(data)}\\n")
        return data
"""


def test_a_new_kind_reads_only_what_is_wanted(spark, folder, tmp_path):
    """Another kind of store, which notes how many bytes were read of each file."""
    (tmp_path / "counting_store.py").write_text(COUNTING)
    spark.sparkContext.addPyFile(str(tmp_path / "counting_store.py"))
    (folder / "notes.txt").write_text("")
    (folder / "big.jpg").write_bytes(b"x" * 1_000_000)
    with pytest.raises(ValueError, match="counting"):
        stores.opened(f"counting:{folder}")
    stores.register("counting", "counting_store:Counting")
    try:
        read = sources.FolderSource(spark, f"counting:{folder}").contents(5)
        got = {r.key: bytes(r.content) for r in read.where("key <> 'notes.txt'").collect()}
    finally:
        del stores.KINDS["counting"]
    assert got["big.jpg"] == b"xxxxx" and got["100%.jpg"] == b"\2\2\2" and "dangling.jpg" not in got
    notes = dict(line.rsplit(" ", 1) for line in (folder / "notes.txt").read_text().splitlines())
    assert notes["big.jpg"] == "5" and max(map(int, notes.values())) == 5
    with pytest.raises(ValueError, match="module"):
        stores.register("x", "nothing")


def test_an_object_store_has_the_same_listing(folder):
    """Arrow's local file system stands in for a bucket."""
    (folder / "dangling.jpg").unlink()
    (folder / "deep" / "loop").unlink()
    own = listing.walked(stores.opened(f"file://{folder}", "vitrine.sources.stores:ObjectStore"), listing.Folders([""], []), listing.Wanted())
    assert {(e.key, e.size) for e in own} == {(n, i + 1) for i, n in enumerate(NAMES) if n not in PRUNED}
    assert stores.opened(f"file://{folder}", "vitrine.sources.stores:ObjectStore").read("notes.txt", 3) == bytes([15]) * 3


def test_a_registered_source(spark):
    class Fixed:
        kind, uri = "fixed", "fixed:1"

        def __init__(self, spark, uri, fetch_via):
            self.spark = spark

        def files(self):
            return sources.described(self.spark.createDataFrame([("a.jpg", 1)], "key string, size long"))

    sources.register_source(lambda uri: uri.startswith("fixed:"), Fixed)
    try:
        assert [r.key for r in sources.open_source(spark, "fixed:1").collect()] == ["a.jpg"]
        assert isinstance(sources.source(spark, "/x"), sources.FolderSource)
    finally:
        sources._kinds.clear()


def test_manifests_with_malformed_urls(spark, folder, tmp_path):
    urls = ["https://h/100%.jpg", "https://h/a%2", "https://h//a%20b+c.png?x=%", "100%.jpg", "https://h/%zz%41", "https://h", None]
    keys = spark.createDataFrame([(u,) for u in urls], "u string").select(url_key(F.col("u")).alias("k")).collect()
    assert [r.k for r in keys] == ["100%.jpg", "a%2", "a b+c.png", "100%.jpg", "%zzA", "", None]
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame([("https://h/100%25.jpg", "3"), ("https://h/gone.jpg", "x"), ("https://h/_DSC0001.jpg", None)], "url string, size string").write.parquet(path)
    manifest = sources.source(spark, path, str(folder))
    assert {r.key: r["size"] for r in manifest.files().collect()} == {"100%.jpg": 3, "gone.jpg": 0, "_DSC0001.jpg": 0}
    assert {r.key: bytes(r.content) for r in manifest.contents().collect()} == {"100%.jpg": b"\2\2\2", "_DSC0001.jpg": b"\0"}


def _lengths():
    """What makes an encoder that stumbles over three bytes."""

    def factory():
        def encode(contents):
            if any(len(c) == 3 for c in contents):
                raise ValueError("broken")
            return [[float(len(c))] for c in contents]

        return encode

    return encoders.Encoder("lengths", 1, factory, factory)


def test_the_stream_survives_odd_names(spark, folder, tmp_path):
    model = _lengths()

    def run():
        stream.start(stream.files_stream(spark, str(folder), settled=0), str(folder), str(tmp_path / "log"), str(tmp_path / "check"), model, 11, per_write=4).awaitTermination(300)
        rows = spark.read.parquet(str(tmp_path / "log")).collect()
        assert len({r.key for r in rows}) == len(rows)
        return {r.key: (r.status, r.error) for r in rows}

    found = run()
    assert set(found) == {"_DSC0001.jpg", "DSC0002.jpg", "100%.jpg", "a%41.jpg", "aA.jpg", "a b+c.png", "ü/ß.jpg", "_sub/.hidden.jpg", "deep/er/est/x.tif"}
    assert found["100%.jpg"] == ("failed", "encode: ValueError: broken") and found["deep/er/est/x.tif"][0] == "skipped"
    assert all(s == "done" for k, (s, _) in found.items() if k not in ("100%.jpg", "deep/er/est/x.tif"))
    late = folder / "moved.jpg"
    late.write_bytes(b"1234")
    os.utime(late, (1, 1))  # an old file that was moved here
    assert run() == found | {"moved.jpg": ("done", None)}


def test_the_stream_keeps_a_state_table(spark, folder, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), 4)
    for _ in range(2):  # the second run finds nothing to do
        stream.start(stream.files_stream(spark, str(folder), settled=0), str(folder), table, str(tmp_path / "check"), _lengths(), 11).awaitTermination(300)
    rows = {r.key: r for r in table.current().collect()}
    assert len(rows) == 9 and rows["100%.jpg"].status == "failed" and rows["deep/er/est/x.tif"].status == "skipped" and rows["_DSC0001.jpg"].embedding == [1.0]
    assert len(list((tmp_path / "state" / "snapshots").iterdir())) == 1
    with pytest.raises(ValueError, match="begun with"):
        stream.claimed(spark, table, encoders.hashing(8))


def test_one_broken_file_fails_alone(spark):
    files = spark.createDataFrame([(str(i), str(i), 1, b"x" * (3 if i == 17 else 1), "fetch: gone" if i == 5 else None) for i in range(32)], "id string, key string, size_bytes long, content binary, fetch_error string").coalesce(1)
    rows = {int(r.id): r for r in stream.encoded(files, _lengths()).collect()}
    assert len(rows) == 32 and {i for i, r in rows.items() if r.status == "failed"} == {5, 17}
    assert rows[5].error == "fetch: gone" and rows[17].error == "encode: ValueError: broken"


def test_uploads_are_checked_before_they_are_decoded(spark):
    import base64
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 30, 20, 8, 6) + bytes(40)
    wide = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 300, 20, 8, 6)
    text = lambda b: base64.b64encode(b).decode()
    rows = [(1, text(png)), (2, "data:image/png;base64," + text(png)[:40] + "\n" + text(png)[40:]), (3, text(wide)), (4, "!!! no"), (5, ""), (6, None), (7, text(b"x" * 90)), (8, text(b"plain text")), (None, text(png))]
    found = {r.n: r for r in uploads.uploaded(spark.createDataFrame(rows, "n long, data string"), "n", most_bytes=80, most_pixels=1000).collect()}
    assert len(found) == len(rows) and {k: r.error for k, r in found.items()} == {1: None, 2: None, 3: "over 1000 pixels", 4: "not base64", 5: "empty", 6: "empty", 7: "over 80 bytes", 8: "not a known image", None: None}
    assert bytes(found[2].content) == png and (found[None].width, found[None].height) == (30, 20) and found[3].content is None
