"""Profiling of files, folders, images and metadata columns, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.columns import IDENTIFIER, OBJECT_KEYS, PLACEHOLDER, UUID, YEAR, extension, is_image, is_junk, name_template, stored_pixels, template_meaning
from vitrine.functions.images import image_header
from vitrine.session import shared_folder

TINY_BYTES = 10_240
MIB = 1 << 20
#: Catalog files, and sizes below which they hold nothing; others need TEXT_BYTES.
CATALOG_EXTENSIONS = ["csv", "tsv", "xlsx", "xls", "json", "xml", "parquet"]
CATALOG_BYTES = {"xlsx": 2048, "xls": 2048, "parquet": 256}
TEXT_BYTES = 64
#: Fixed values of the rules below: rows and names that are looked at, and shares.
TYPE_ROWS, LENGTH_ROWS, DIRECTORY_NAMES, MOST_FACETS = 500, 5000, 400, 200
#: Vector widths, images a second by model and device, and what a stored image takes.
VECTOR_DIMS = {"clip": 512, "siglip": 768, "siglip2": 768, "imagebind": 1024}
ENCODE_RATE = {"clip": {"cuda": 300.0, "mps": 168.0, "cpu": 87.0}, **dict.fromkeys(("siglip", "siglip2", "imagebind"), {"cuda": 100.0, "mps": 54.0, "cpu": 22.0})}
BYTES_PER_PIXEL, BYTES_PER_IMAGE, STATE_BYTES = 0.145, 390_000, 5_700
DECODE_S_PER_MEGAPIXEL, DECODERS, BASE_MEMORY, REGION_BYTES = 0.005, 4, 400 * MIB, 100 * MIB
#: Bits by which values are told apart in a round, when the one at a place is sought.
DIGIT = 15
#: Slices of a column in which its first rows are sought side by side.
SLICES = 64

ROLES = {
    "year": "years", "year_mostly": "mostly years", "category": "categories", "identifier": "identifiers", "uuid": "UUIDs",
    "noise": "placeholder folder names", "constant": "a fixed prefix", "unclear": "no clear pattern",
}


def _selected(counted: DataFrame, targets: DataFrame, bits: int) -> DataFrame:
    """``key``, ``name`` and ``v``: for each target (key, name, place) the value at that place of its key's values (key, v, n) in order.

    Values are told apart by their leading bits first, DIGIT more each round: a
    round counts, for each key, the values that still may be at a place by
    their next bits, so what is put in order is 2^DIGIT counts (and one),
    however values are distributed.
    """
    found = targets.select(F.col("key").alias("k"), "name", "place", F.lit(None).cast("long").alias("head"), F.lit(0).cast("long").alias("before"))
    shift, above = max(0, bits - DIGIT), None
    while True:
        at = F.call_function("shiftright", F.col("v"), F.lit(shift))
        if above is None:
            rows = counted.withColumn("head", F.lit(None).cast("long"))
        else:
            heads = found.select("k", "head").distinct()
            rows = counted.join(heads, F.col("key").eqNullSafe(F.col("k")) & (F.call_function("shiftright", F.col("v"), F.lit(above)) == F.col("head"))).drop("k")
        sums = rows.groupBy("key", "head", at.alias("at")).agg(F.sum("n").alias("m"))
        sums = sums.withColumn("upto", F.sum("m").over(Window.partitionBy("key", "head").orderBy("at"))).withColumnRenamed("head", "of")
        met = found.join(sums, F.col("k").eqNullSafe(F.col("key")) & F.col("head").eqNullSafe(F.col("of")))
        there = (F.col("before") + F.col("upto") > F.col("place")) & (F.col("before") + F.col("upto") - F.col("m") <= F.col("place"))
        found = met.where(there).select("k", "name", "place", F.col("at").alias("head"), (F.col("before") + F.col("upto") - F.col("m")).alias("before"))
        if not shift:
            return found.select(F.col("k").alias("key"), "name", F.col("head").alias("v"))
        shift, above = max(0, shift - DIGIT), shift


def index_percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Percentiles by place for each key, exactly, and size, extremes and mean (cut towards zero) of its whole numbers.

    Values are counted once, and that is written; no key's values are gathered.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    v = F.col(value).cast("long")
    counted = rows.where(v.isNotNull()).groupBy(F.col(key).alias("key"), v.alias("v")).agg(F.count("*").alias("n")).checkpoint()
    ends = counted.agg(F.min("v").alias("least"), F.max("v").alias("most")).first()
    bits = 0 if ends["least"] is None else (ends["most"] - ends["least"]).bit_length()
    stats = counted.groupBy("key").agg(F.sum("n").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v").cast("decimal(20,0)") * F.col("n")).alias("s"))
    place = lambda share: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(share)))
    targets = stats.select("key", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), place(s).alias("place")) for n, s in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))))).alias("t")).select("key", "t.*")
    found = _selected(counted, targets, bits)
    wide = found.groupBy("key").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).cast("double").alias(n) for n in ("p50", "p90", "p99")))
    out = stats.join(wide.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")))
    mean = F.try_divide(F.col("s"), F.col("total").cast("decimal(20,0)"))
    return out.select(F.col("key").alias(key), F.col("total").alias("n"), "least", "most", F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean)).cast("long").alias("mean"), "p50", "p90", "p99")


# --- files -------------------------------------------------------------------


def classified(files: DataFrame) -> DataFrame:
    """Files (key, size) with extension and kind: unreadable, junk, image or other, the first that fits."""
    kind = F.when(F.col("size").isNull(), "unreadable").when(is_junk(F.col("key")), "junk").when(is_image(F.col("key")), "image").otherwise("other")
    return files.withColumn("ext", extension(F.col("key"))).withColumn("kind", kind)


def scan_totals(files: DataFrame) -> DataFrame:
    """One row: files, images, bytes of images, unreadable and other files of what ``classified`` gives."""
    image, bad = F.col("kind") == "image", F.col("kind") == "unreadable"
    return files.agg(
        F.count("*").alias("files"), F.count_if(image).alias("images"), F.coalesce(F.sum(F.when(image, F.col("size"))), F.lit(0).cast("long")).alias("bytes"), F.count_if(bad).alias("unreadable"), F.count_if(~image & ~bad).alias("others"),
        F.count_if(image & (F.col("size") < TINY_BYTES)).alias("tiny"),
    )


def extension_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"), F.count_if(F.col("size") < TINY_BYTES).alias("tiny"))


def scan_issues(files: DataFrame) -> DataFrame:
    """``kind``, ``name``, ``files`` and ``note`` of what is wrong with files (with pos): the five commonest junk names, unreadable files, the six commonest other extensions, tiny images."""
    rows = classified(files).withColumn("base", F.lower(F.element_at(F.split("key", "/"), -1)))
    name = F.when(F.col("kind") == "junk", F.col("base")).when(F.col("kind") == "other", F.when(F.col("ext") == "", "no extension").otherwise(F.col("ext"))).otherwise("")
    issue = F.when(F.col("kind") == "junk", "junk_file").when(F.col("kind") == "unreadable", "unreadable").when(F.col("kind") == "other", "non_image").when(F.col("size") < TINY_BYTES, "tiny_image")
    found = rows.select(issue.alias("issue"), name.alias("name"), "pos").where("issue IS NOT NULL").groupBy("issue", "name").agg(F.count("*").alias("files"), F.min("pos").alias("first"))
    # names are few: one row for each junk name and extension
    turn = F.row_number().over(Window.partitionBy("issue").orderBy(F.desc("files"), "first"))
    most = F.when(F.col("issue") == "junk_file", 5).when(F.col("issue") == "non_image", 6).otherwise(1)
    note = (
        F.when(F.col("issue") == "junk_file", F.concat(F.lit("system file "), "name"))
        .when(F.col("issue") == "unreadable", "could not be read (permissions or damage)")
        .when(F.col("issue") == "non_image", F.concat(F.lit("."), "name", F.lit(" files are not images")))
        .otherwise("under 10 KB, possibly broken or placeholder images")
    )
    return found.withColumn("turn", turn).where(F.col("turn") <= 6).where(F.col("turn") <= most).select(F.col("issue").alias("kind"), "name", "files", note.alias("note"))


def catalog_candidates(files: DataFrame, most: int = 10) -> DataFrame:
    """Files (key, size, pos) that may describe the images, the first ones, with ``looks_empty`` and a note."""
    sizes = F.create_map(*(F.lit(x) for kv in CATALOG_BYTES.items() for x in kv))
    rows = classified(files).where((F.col("kind") == "other") & F.col("ext").isin(CATALOG_EXTENSIONS)).orderBy("pos").limit(most)
    least = F.coalesce(F.try_element_at(sizes, F.col("ext")), F.lit(TEXT_BYTES))
    note = F.when(F.col("size") == 0, "The file is empty.").when(F.col("size") < least, F.concat(F.lit("Only "), F.col("size").cast("string"), F.lit(" bytes, too small to hold any real content."))).otherwise("May describe the images. It is not used yet.")
    return rows.select("key", "size", (F.col("size") < least).alias("looks_empty"), note.alias("note"))


def folder_bytes(files: DataFrame) -> DataFrame:
    """``folder`` (the first of a key) and ``bytes``, and a row ``total``."""
    folder = F.when(F.col("key").contains("/"), F.substring_index("key", "/", 1)).otherwise("")
    return files.select(folder.alias("folder"), "size").rollup("folder").agg(F.sum("size").alias("bytes"), F.grouping("folder").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("folder")).alias("folder"), "bytes")


def name_patterns(names: DataFrame, most: int = 6) -> DataFrame:
    """The commonest name templates (name, pos), their share, first example and meaning."""
    found = names.groupBy(name_template(F.col("name")).alias("template")).agg(F.count("*").alias("files"), F.min("pos").alias("first"), F.min_by("name", "pos").alias("example"))
    total = names.agg(F.count("*").alias("total"))  # one row
    top = found.orderBy(F.desc("files"), "first").limit(most).crossJoin(F.broadcast(total))
    return top.select("template", "files", F.round(F.col("files") / F.col("total"), 4).alias("share"), "example", template_meaning(F.col("template"), F.col("example")).alias("meaning"))


def directory_signals(files: DataFrame, levels: int = 3) -> DataFrame:
    """For each level of folders that half of the files (key, pos) have: distinct names, role, whether it means something, the four commonest names.

    Roles come from the first ``DIRECTORY_NAMES`` names, as they come.
    """
    parts = F.split("key", "/")
    folders = F.slice(parts, F.lit(1), F.least(F.lit(levels), F.size(parts) - 1))
    names = files.select("pos", F.posexplode(folders).alias("depth", "name")).groupBy("depth", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    total = files.agg(F.count("*").alias("total"))  # one row
    counts = names.groupBy("depth").agg(F.sum("n").alias("files"), F.count("*").alias("names"))
    heads = lambda n, *order: names.withColumn("r", F.row_number().over(Window.partitionBy("depth").orderBy(*order))).where(F.col("r") <= n)
    share = lambda test: F.avg(test.cast("double"))
    name = F.col("name")
    shares = heads(DIRECTORY_NAMES, "first", "name").groupBy("depth").agg(
        share(name.rlike(f"^{YEAR}s?$")).alias("year"), share(name.rlike(UUID)).alias("uuid"), share(name.rlike(PLACEHOLDER)).alias("noise"), share(name.rlike(IDENTIFIER)).alias("identifier"), share((F.length(name) > 2) & ~name.rlike(r"^\d+$")).alias("wordy")
    )
    examples = heads(4, F.desc("n"), "first", "name").groupBy("depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "|").alias("examples"))
    role = (
        F.when(F.col("names") < 2, "constant")
        .when(F.col("year") > 0.95, "year").when(F.col("year") > 0.6, "year_mostly").when(F.col("uuid") > 0.8, "uuid").when(F.col("noise") > 0.5, "noise").when(F.col("identifier") > 0.8, "identifier").when(F.col("wordy") > 0.7, "category")
        .otherwise("unclear")
    )
    out = counts.crossJoin(F.broadcast(total)).where(F.col("files") >= 0.5 * F.col("total")).join(shares, "depth").join(examples, "depth").withColumn("role", role)
    return out.select("depth", "files", "names", "role", F.col("role").isin("year", "year_mostly", "category").alias("meaningful"), "examples")


# --- columns -----------------------------------------------------------------


def group_column(columns: list[str]) -> str | None:
    """The first column that names an object."""
    return next((c for c in columns if c.lower() in OBJECT_KEYS), None)


def field_profile(table: DataFrame, columns: list[str], group: str | None = None, order: str | None = None) -> DataFrame:
    """For each column its coverage, distinct values, type, first values, mean length and note, and whether it makes a facet or search text.

    Type and mean length follow the first values by ``order`` (any, without it).
    One pass melts the columns into rows and counts values, so a column of any
    number of values is spread over tasks; first values are a bounded top of each column.
    """
    kinds = dict(table.dtypes)
    plain = {c: "bool" if kinds[c] == "boolean" else "date" if kinds[c].startswith(("date", "timestamp")) else "number" if kinds[c] != "string" else "string" for c in columns}
    place = F.col(order) if order else F.monotonically_increasing_id()
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    melted = table.select(place.alias("at"), F.explode(cells).alias("x")).select("at", "x.*").where("v IS NOT NULL AND v <> ''")
    total = table.agg(F.count("*").alias("total"))  # one row
    values = melted.groupBy("column", "v").agg(F.count("*").alias("n"))
    stats = values.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"), F.min("v").alias("only"))
    # the first rows of each of a column's slices hold its own first rows
    ranked = melted.withColumn("slice", F.pmod(F.xxhash64("at"), F.lit(SLICES)))
    for keys in (["column", "slice"], ["column"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("r") <= LENGTH_ROWS)
    heads = ranked.groupBy("column").agg(
        F.avg(F.length("v")).alias("mean_length"), F.bool_and(F.when(F.col("r") <= TYPE_ROWS, F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([ T]|$)"))).alias("dates"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", F.substring("v", 1, 60).alias("v"))))), lambda x: x["v"]), "|").alias("samples"),
    )
    known = table.sparkSession.createDataFrame(list(plain.items()), "column string, plain string")
    out = known.join(stats, "column", "left").join(heads, "column", "left").crossJoin(F.broadcast(total)).fillna({"filled": 0, "distinct_values": 0, "mean_length": 0.0, "samples": ""})
    kind = F.when(F.col("filled") == 0, "string").when((F.col("plain") == "string") & F.col("dates"), "date").otherwise(F.col("plain"))
    own, many = F.col("column") == F.lit(group or ""), F.col("distinct_values")
    covered = F.round(F.try_divide("filled", F.greatest("total", F.lit(1))), 4)
    ranged = kind.isin("number", "date")
    facet = F.when(own, False).when(ranged & (many != 1), True).otherwise(kind.isin("string", "bool") & (many > 1) & (many <= F.greatest(F.lit(50.0), F.col("total") * 0.01)) & (covered > 0.5))
    search = (kind == "string") & (many > 1) & ~own & (F.col("mean_length") > 12)
    note = (
        F.when(own, "Identifies the object. Used to group results, not to filter or search.")
        .when(many == 1, F.concat(F.lit("Only one value ("), F.substring("only", 1, 40), F.lit("), so filtering by it is pointless.")))
        .when(ranged, F.concat(F.lit("A "), kind, F.lit(" field, usable as a range filter.")))
        .when(many > F.col("total") * 0.5, "Nearly unique per row. Good for search, not for filtering.")
        .otherwise("")
    )
    return out.select("column", "filled", covered.alias("coverage"), F.col("distinct_values"), F.round("mean_length", 4).alias("mean_length"), kind.alias("type"), "samples", facet.alias("facetable"), search.alias("searchable"), note.alias("note"))


def items_per_object(rows: DataFrame, key: str) -> DataFrame:
    """Mean, median and greatest size of groups, rows without group (null, empty or 0), and whether to collapse them."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    named = F.col(key).isNotNull() & ~F.col(key).cast("string").isin("", "0")
    counted = sizes.where(named).groupBy("n").agg(F.count("*").alias("m"))  # a row a size
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("m")
    stats = counted.agg(F.sum("m").alias("objects"), F.round(mean, 2).alias("mean"), F.percentile("n", 0.5, F.col("m")).alias("median"), F.max("n").alias("most"), (mean > 1.3).alias("many"))
    orphans = sizes.agg(F.coalesce(F.sum(F.when(~named | F.col(key).isNull(), F.col("n"))), F.lit(0).cast("long")).alias("orphans"))
    return stats.crossJoin(orphans).withColumn("collapse", F.col("many") | (F.col("most") > 10)).drop("many")


# --- images ------------------------------------------------------------------


def image_headers(files: DataFrame) -> DataFrame:
    """``key``, ``width``, ``height``, ``mode``, ``taken`` and ``located`` from the first bytes of files (key, head); nulls where they can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [image_header(x.as_py() or b"") for x in batch.column(1)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["key", "width", "height", "mode", "taken", "located"])

    return files.select("key", "head").mapInArrow(run, "key string, width int, height int, mode string, taken string, located boolean")


def image_stats(headers: DataFrame) -> DataFrame:
    """One row of a sample's headers: read and broken ones, percentiles of width and height, megapixels, stored pixels, modes, and shares with a date and a place."""
    good = headers.where("width IS NOT NULL")
    sides = good.select(F.explode(F.array(F.struct(F.lit("width").alias("side"), F.col("width").alias("v")), F.struct(F.lit("height").alias("side"), F.col("height").alias("v")))).alias("x")).select("x.*")
    places = index_percentiles(sides, "side", "v")
    wide = places.agg(*(F.max(F.when(F.col("side") == s, F.col(p))).alias(f"{s}_{p}") for s in ("width", "height") for p in ("p50", "p90", "p99")))
    stats = headers.agg(
        F.count("*").alias("sampled"), F.count_if(F.col("width").isNull()).alias("broken"), F.bround(F.avg(stored_pixels(F.col("width"), F.col("height")))).alias("stored_pixels"), F.count_if(F.col("taken").isNotNull()).alias("dated"), F.count_if("located").alias("located")
    )
    modes = good.groupBy("mode").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("mode", F.lit("="), F.col("n").cast("string")))), ",").alias("modes"))  # a row a mode
    out = stats.crossJoin(wide).crossJoin(modes)
    return out.withColumn("megapixels", F.bround(F.col("width_p50") * F.col("height_p50") / 1e6, 1))


# --- what follows ------------------------------------------------------------


def sizing(images: Column, bytes_: Column, model: str = "siglip", device: str = "cpu", megapixels: Column | None = None, stored: Column | None = None, bandwidth: float = 0.0) -> dict[str, Column]:
    """Bytes of vectors, copies, state and memory, and seconds to encode, and to transfer within a region and, if its bandwidth is known, from where the files are."""
    vectors = images * VECTOR_DIMS.get(model, VECTOR_DIMS["siglip"]) * 4
    decode = images * (megapixels if megapixels is not None else F.lit(0.0)) * DECODE_S_PER_MEGAPIXEL / DECODERS
    compute = images / ENCODE_RATE.get(model, ENCODE_RATE["siglip"])[device] + decode
    each = F.coalesce(F.nullif(stored, F.lit(0.0)) * BYTES_PER_PIXEL, F.lit(float(BYTES_PER_IMAGE))) if stored is not None else F.lit(float(BYTES_PER_IMAGE))
    out = {
        "vector_bytes": vectors.cast("long"),
        "memory_bytes": (vectors + BASE_MEMORY).cast("long"),
        "copy_bytes": F.bround(images * each).cast("long"),
        "state_bytes": (images * STATE_BYTES).cast("long"),
        "compute_s": F.bround(compute, 1),
        "in_region_s": F.bround(F.greatest(bytes_ / float(REGION_BYTES), compute), 1),
    }
    if bandwidth > 0:
        out |= {"transfer_s": F.bround(bytes_ / bandwidth, 1), "mib_per_s": F.lit(round(bandwidth / MIB, 1)), "estimated_s": F.bround(F.greatest(bytes_ / bandwidth, compute), 1)}
    return out


def file_fields(sampled: int, dated: int, located: int, levels: list) -> list[dict]:
    """Fields that files themselves give: a date and a place if over a twentieth of the sample has them, and folder levels that mean something (rows of ``directory_signals``)."""
    enough = lambda n: n / max(1, sampled) > 0.05
    out = [
        {"name": "capture_date", "available": enough(dated), "facetable": enough(dated), "searchable": False, "note": "When each picture was taken, not the date of the object." if enough(dated) else f"Only {dated} of {sampled} sampled images carry a date."},
        {"name": "location", "available": enough(located), "facetable": enough(located), "searchable": False, "note": "Where each picture was taken, not the object's origin." if enough(located) else "No location field, and the images carry no place."},
    ]
    return out + [{"name": f"folder_level_{r['depth'] + 1}", "available": True, "facetable": r["names"] <= MOST_FACETS, "searchable": False, "note": f"Folder level {r['depth'] + 1} looks like {ROLES[r['role']]}."} for r in levels if r["meaningful"]]


def with_file_names(fields: list[dict]) -> list[dict]:
    """File names are searched if no field is."""
    if any(f["searchable"] for f in fields):
        return fields
    return [*fields, {"name": "filename", "available": True, "facetable": False, "searchable": True, "note": "No catalog titles. Text search falls back to file names."}]


def capabilities(fields: list[dict]) -> dict:
    """What a collection with these fields can do, its facets, and why it can't do the rest."""
    called = {"capture_date": "date_range", "location": "geo_map"}
    return {
        "available": ["text_search", "image_search", "visual_similarity"],
        "facets": [f["name"] for f in fields if f["available"] and f["facetable"]],
        "unavailable": {called.get(f["name"], f["name"]): f["note"] for f in fields if not f["available"]},
    }


def decisions(orphans: int, excluded: int) -> list[dict]:
    """What the owner has to decide before an ingest: images without record, files that aren't images, where data may be."""
    out = []
    if orphans:
        out.append({"id": "include_orphans", "question": f"{orphans:,} images have no catalog record. Index them too?", "options": ["yes", "no"], "recommended": "yes"})
    if excluded:
        out.append({"id": "exclude_junk", "question": f"Found {excluded:,} files that are not images. Leave them out?", "options": ["yes", "no"], "recommended": "yes"})
    return [*out, {"id": "data_residency", "question": "May this collection be stored in the cloud?", "options": ["cloud", "local", "unknown"], "recommended": "local"}]


def systematic_sample(rows: DataFrame, count: int) -> DataFrame:
    """Every n-th row by place (``pos`` from 0), the first ``count`` of them."""
    total = rows.count()
    step = max(1, total // count) if count else 1
    return rows.where(F.col("pos") % step == 0).orderBy("pos").limit(count)
