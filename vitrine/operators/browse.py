"""Counts, masks, filters, joins and item detail of a collection.

``items`` has item_id, pos, group_id, object_id, record_id (null if uncataloged)
and embedding; ``facets`` has record_id, facet and value; ``fields`` has
record_id, position, label and value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.columns import url_quoted, url_segment, years

#: Facets that records may be filtered by; dates go by years.
FACETS = ("object_type", "place", "culture", "topic", "name")

#: The most that a caller may ask for, by parameter.
LIMITS = {"limit": 200, "page": 1000, "sample": 200, "similar": 100, "values": 200, "query_chars": 500}


def checked(name: str, value: int, least: int = 1) -> int:
    if not least <= value <= LIMITS[name]:
        raise ValueError(f"{name} is from {least} to {LIMITS[name]}")
    return value


def wanted_groups(text: str | None, known: list[str]) -> list[str] | None:
    """Groups of a comma list, each once, in its order; None if it asks for none; unknown names are an error."""
    names = list(dict.fromkeys(n for n in (p.strip() for p in (text or "").split(",")) if n))
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"no such group: {', '.join(unknown)}")
    return names or None


def masked(items: DataFrame, groups: list[str] | None = None, cataloged_only: bool = False, records: DataFrame | None = None) -> DataFrame:
    """Items of any of the groups, with a record, and with one of ``records``; what is None restricts nothing."""
    if groups is not None:
        items = items.where(F.col("group_id").isin(groups))
    if cataloged_only:
        items = items.where("record_id IS NOT NULL")
    if records is not None:
        items = items.join(records.select("record_id"), "record_id", "left_semi")
    return items


def objects_in(items: DataFrame, groups: list[str] | None = None, cataloged_only: bool = False, records: DataFrame | None = None) -> DataFrame:
    """``object_id`` of objects with some item of the groups, with a record, and with one of ``records``."""
    return masked(items, groups, cataloged_only, records).select("object_id").distinct()


def shown_in_order(ranked: DataFrame, items: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Those of ``ranked`` (object_id, rank) that are shown in the groups, ranked anew in their order."""
    kept = ranked.join(objects_in(items, groups), "object_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("rank")))  # a channel's depth of rows at most


def objects(items: DataFrame) -> DataFrame:
    """Each object's number of images, first place and members in order."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",")
    return items.groupBy("object_id").agg(F.count("*").alias("image_count"), F.min("pos").alias("first_pos"), members.alias("members"))


def group_summary(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Images and objects of each group, those without any included; an object of two groups counts in both."""
    found = items.groupBy("group_id").agg(F.count("*").alias("images"), F.count_distinct("object_id").alias("objects"))
    none = F.lit(0).cast("long")
    return groups.join(found, "group_id", "left").select("group_id", F.coalesce("images", none).alias("images"), F.coalesce("objects", none).alias("objects"))


def group_counts(items: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched objects in each group, groups without any left out."""
    return items.join(matched.select("object_id"), "object_id", "left_semi").groupBy("group_id").agg(F.count_distinct("object_id").alias("objects"))


def collection_info(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("images"), F.count_distinct("object_id").alias("objects"), F.count_if(F.col("record_id").isNull()).alias("uncataloged"), F.count_distinct("group_id").alias("groups"))


def object_count(items: DataFrame, offset: int, limit: int) -> DataFrame:
    n = F.count_distinct("object_id")
    return items.agg(n.alias("objects"), (F.lit(offset + limit) < n).alias("has_more"))


def presented(results: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """A page of results (object_id, item_id, score) with its objects' titles and numbers of images in the whole collection."""
    page = results.join(items.select("item_id", "group_id", "record_id"), "item_id").join(records.select("record_id", "title"), "record_id", "left")
    counts = items.join(results.select("object_id").distinct(), "object_id", "left_semi").groupBy("object_id").agg(F.count("*").alias("image_count"))
    return page.join(counts, "object_id").select("object_id", "item_id", "group_id", "title", "image_count", "score")


def with_records(items: DataFrame, records: DataFrame) -> DataFrame:
    return items.join(records, "record_id", "left")


def item_metadata(items: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """``item_id`` and ``metadata``: the named columns of items with their records, as a map without those that are null."""
    entries = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    return with_records(items, records).select("item_id", F.map_filter(entries, lambda _, v: v.isNotNull()).alias("metadata"))


def assistant_rows(results: DataFrame, groups: DataFrame, site: str) -> DataFrame:
    """A page of results as an assistant gets it: the group's label, similarity to three places, and links with the quoted id."""
    named = results.join(groups.select("group_id", "label"), "group_id", "left")
    link = url_quoted(F.col("item_id"))
    return named.select(
        F.col("item_id").alias("id"), "object_id", "title", F.coalesce("label", "group_id").alias("group"), F.greatest(F.coalesce("image_count", F.lit(1)), F.lit(1)).alias("images"), F.round("similarity", 3).alias("similarity"),
        F.concat(F.lit(f"{site}/#/item/"), link).alias("page"), F.concat(F.lit(f"{site}/images/"), link, F.lit("?size=thumbnail")).alias("thumbnail"),
    )


def license_text(name: Column, url: Column) -> Column:
    """Name and link of a license, what there is of them; null if neither."""
    return F.nullif(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(url, F.lit(""))), F.lit(""))


def client_rows(results: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Results with entries of their metadata map as columns: {name: key}."""
    return results.select("item_id", "score", *(F.try_element_at("metadata", F.lit(key)).alias(name) for name, key in fields.items()))


def segment_lookup(links: DataFrame, known: DataFrame, n: int, missing: str) -> DataFrame:
    """``links`` (link) with the value that ``known`` (row, url, value) gives for the n-th segment of the link; of a segment's rows the last counts."""
    table = known.where("url IS NOT NULL AND value IS NOT NULL").select(url_segment(F.col("url"), n).alias("segment"), "row", "value").where("segment IS NOT NULL")
    last = table.groupBy("segment").agg(F.max_by("value", "row").alias("value"))
    return links.withColumn("segment", url_segment(F.col("link"), n)).join(last, "segment", "left").select("link", "segment", F.when(F.col("segment").isNotNull(), F.coalesce("value", F.lit(missing))).alias("value"))


def without_records(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items whose record is named but missing."""
    return items.where("record_id IS NOT NULL").join(records, "record_id", "left_anti")


def fields_in_order(fields: DataFrame) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "value"))), lambda x: F.concat(x["label"], F.lit("="), x["value"]))
    return fields.groupBy("record_id").agg(F.count("*").alias("n_fields"), F.array_join(rows, "|").alias("fields"))


def related_described(related: DataFrame, tags: DataFrame) -> DataFrame:
    """Photos and pages of other sources that show a record, in order of source, those of one image first, and id.

    ``related`` has record_id, source_id, source, link_type, image_id, url, title,
    thumbnail, rights, rights_url and counts (JSON of numbers); ``tags`` source_id, position and tag.
    """
    own = tags.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "tag"))), lambda t: t["tag"]).alias("tags"))
    rights = F.when(F.coalesce("rights", F.lit("")) != "", F.struct(F.col("rights").alias("name"), F.col("rights_url").alias("url")))
    counts = F.coalesce(F.from_json("counts", "map<string,long>"), F.expr("map()").cast("map<string,bigint>"))
    rows = related.join(own, "source_id", "left").select(
        "record_id", F.col("source_id").alias("id"), "source", "link_type", "image_id", "url", "title", (F.coalesce("thumbnail", F.lit("")) != "").alias("has_thumbnail"), rights.alias("rights"), counts.alias("counts"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    place = F.row_number().over(Window.partitionBy("record_id").orderBy("source", F.col("image_id").isNull(), "id"))
    return rows.withColumn("place", place)


def related_by_source(described: DataFrame) -> DataFrame:
    """Each record's entries by source, sources in the order in which they come first."""
    rows = described.groupBy("record_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"), F.min("place").alias("first"))
    return rows.select("record_id", "source", F.row_number().over(Window.partitionBy("record_id").orderBy("first")).alias("turn"), "ids")


def record_details(records: DataFrame, fields: DataFrame, facets: DataFrame, related: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """``record_id``, ``fields`` in order, ``facets`` (a map of sorted values) and ``related`` of some records."""
    wanted = records.select("record_id").distinct()
    of = lambda df: df.join(wanted, "record_id", "left_semi")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "value"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))
    values = of(facets).groupBy("record_id", "facet").agg(F.array_sort(F.collect_list("value")).alias("values"))
    out = wanted.join(of(fields).groupBy("record_id").agg(rows.alias("fields")), "record_id", "left")
    out = out.join(values.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facet", "values")))).alias("facets")), "record_id", "left")
    if related is not None:
        entries = related_described(of(related), tags if tags is not None else related.select("source_id").limit(0).selectExpr("source_id", "0 AS position", "'' AS tag"))
        whole = F.struct("place", *(c for c in entries.columns if c not in ("record_id", "place")))
        out = out.join(entries.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("place", F.to_json(whole).alias("entry")))).alias("related")), "record_id", "left")
    return out


def facet_lists(facets: DataFrame) -> DataFrame:
    """Each record's distinct values of each facet, sorted."""
    return facets.groupBy("record_id", "facet").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"))


def with_years(facets: DataFrame) -> DataFrame:
    low, high = years(F.col("value"))
    return facets.where("facet = 'date'").select("record_id", "value", low.alias("y_lo"), high.alias("y_hi"))


def _given(facets: DataFrame | None) -> DataFrame:
    if facets is None:
        raise ValueError("this collection keeps no catalog categories to filter by")
    return facets


def matching_records(facets: DataFrame | None, wanted: dict[str, list[str]], year_from: int | None = None, year_to: int | None = None) -> DataFrame | None:
    """Records that have some wanted value of every wanted facet, case apart, and a date that meets the years; None if nothing is asked.

    One pass: hits carry their facet's number, and records with all numbers stay.
    """
    asked = {f: [v.strip().lower() for v in vs if v.strip()] for f, vs in wanted.items()}
    asked = {f: vs for f, vs in asked.items() if vs}
    dated = year_from is not None or year_to is not None
    if not asked and not dated:
        return None
    if year_from is not None and year_to is not None and year_from > year_to:
        raise ValueError("the first year comes after the last")
    if unknown := sorted(set(asked) - set(FACETS)):
        raise ValueError(f"no catalog category named {', '.join(unknown)}")
    facets = _given(facets)
    tests: list[Column] = [(F.col("facet") == f) & F.lower("value").isin(vs) for f, vs in asked.items()]
    if dated:
        low, high = years(F.col("value"))
        meets = (F.col("facet") == "date") & (low <= (year_to if year_to is not None else 9999)) & (high >= (year_from if year_from is not None else 0))
        tests.append(meets)
    any_of = reduce(lambda a, b: a | b, tests)
    if not asked:
        return facets.where(any_of).select("record_id").distinct()
    names = [*asked, *(["date"] if dated else [])]
    found = facets.where(F.col("facet").isin(names)).where(any_of).groupBy("record_id").agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, t in enumerate(tests)))
    return found.where(reduce(lambda a, b: a & b, (F.col(f"t{i}") for i in range(len(tests))))).select("record_id")


def facet_values(facets: DataFrame | None, facet: str, limit: int, contains: str | None = None) -> DataFrame:
    """The values that most records have, by count, then value. ``%`` and ``_`` in ``contains`` stand for anything."""
    if facet not in (*FACETS, "date"):
        raise ValueError(f"no catalog category named {facet}")
    rows = _given(facets).where(F.col("facet") == facet)
    checked("values", limit)
    if contains is not None:
        rows = rows.where(F.lower("value").like(f"%{contains.lower()}%"))
    return rows.groupBy("value").agg(F.count_distinct("record_id").alias("records")).orderBy(F.desc("records"), "value").limit(limit)


def shards_in_order(shards: list[DataFrame], groups: list[str]) -> DataFrame:
    """Shards one behind another in the order of the groups, with a place in the whole: (group's number, place in it)."""
    parts = [s.select(F.lit(i).alias("shard"), "pos", "item_id").withColumn("group_id", F.lit(g)) for i, (g, s) in enumerate(zip(groups, shards, strict=True))]
    return reduce(DataFrame.unionByName, parts)
