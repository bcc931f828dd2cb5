"""What kind of query a text is, for a table of queries: spelling, catalog numbers, dates and catalog terms, by joins.

``queries`` has query_id and query. Vocabulary (term, records), gazetteer (key,
term, field, record_count) and shapes (shape) may be of any size: queries'
words are exploded and joined with them.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.columns import fold, is_query_date, shape, words
from vitrine.operators import fulltext
from vitrine.session import kept

#: Words that ask for nothing, names of fields in queries, and the fields that they stand for.
STOP_WORDS = "a an and are as at be by for from in into is it its of on or that the this to with".split()
FIELDS = {
    "title": "title", "name": "names", "person": "names", "maker": "names", "place": "places", "topic": "topics", "subject": "topics",
    "type": "object_types", "object": "object_types", "date": "dates", "year": "dates", "id": "identifiers", "number": "identifiers",
}
#: Weights of the visual and the keyword channel by kind of query, for a term that is part of a query, and by mode.
ROUTES = {
    "identifier": (0.0, 1.0), "field": (0.0, 1.0), "phrase": (0.0, 1.0), "name": (0.3, 1.0), "date": (0.3, 1.0),
    "place": (1.0, 1.0), "topic": (1.0, 1.0), "object_type": (1.0, 1.0), "description": (1.0, 0.3),
}
PARTIAL = (1.0, 1.0)
MODES = {"visual": (1.0, 0.0), "keyword": (0.0, 1.0), "hybrid": (1.0, 1.0)}

#: Signs that count as a straight quote.
_QUOTES = str.maketrans(dict.fromkeys("“”„‟″＂", '"'))
_SYNTAX = "query string, plain array<string>, phrases array<string>, fields array<struct<field:string,value:string>>"
_MATCH = "struct<term:string,field:string,record_count:long>"


def _name_before(text: str) -> str:
    """The ASCII letters at a text's end."""
    return text[len(text.rstrip(string.ascii_letters)) :]


def _value_at(text: str, at: int) -> int:
    """Where a field's value that begins at ``at`` ends: behind the closing quote, or at the next space; -1 if there is none."""
    if at >= len(text):
        return -1
    closing = text.find('"', at + 1) if text[at] == '"' else -1
    return closing + 1 if closing >= 0 else at + len(text[at:].split(maxsplit=1)[0])


def read_syntax(query: str, known: set[str]) -> tuple[str, list[str], list[str], list[tuple[str, str]]]:
    """The query with straight quotes; its plain words, quoted phrases and values of known fields.

    Read from the left: a colon behind letters gives what follows to the field
    of that name, a quote begins a phrase if it is closed. What names no field
    is plain, its value included.
    """
    query = query.strip().translate(_QUOTES)
    plain, phrases, fields = "", [], []
    at = 0
    while at < len(query):
        sign = query[at]
        if sign == '"' and (closing := query.find('"', at + 1)) >= 0:
            phrases.append(query[at + 1 : closing])
            at = closing + 1
            continue
        if sign == ":" and (name := _name_before(plain)):
            begin = at + 1 + len(query[at + 1 :]) - len(query[at + 1 :].lstrip())
            end = _value_at(query, begin)
            if end > 0:
                column = FIELDS.get(name.lower())
                if column in known:
                    fields.append((column, query[begin:end].strip('"')))
                    plain = plain[: -len(name)]
                else:
                    plain += query[at:end]
                at = end
                continue
        plain += sign
        at += 1
    return query, plain.split(), phrases, fields


def parsed(queries: DataFrame, known: list[str]) -> DataFrame:
    """``query_id``, ``query``, ``plain``, ``phrases`` and ``fields`` of each query."""
    names = set(known)

    @F.pandas_udf(f"struct<{_SYNTAX.replace(' ', ':', 1).replace(', plain ', ',plain:').replace(', phrases ', ',phrases:').replace(', fields ', ',fields:')}>")
    def syntax(texts: pd.Series) -> pd.DataFrame:
        rows = [read_syntax(t or "", names) for t in texts]
        return pd.DataFrame({"query": [r[0] for r in rows], "plain": [r[1] for r in rows], "phrases": [r[2] for r in rows], "fields": [[{"field": f, "value": v} for f, v in r[3]] for r in rows]})

    return queries.select("query_id", syntax("query").alias("s")).select("query_id", "s.*")


def spelled(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``queries`` with their plain words corrected, and ``corrected`` (the whole query so, or null)."""
    each = queries.select("query_id", F.posexplode("plain").alias("at", "word")).withColumn("folded", fold(F.col("word")))
    fixes = fulltext.spellings(each.select(F.col("folded").alias("word")), vocab)
    fixed = each.join(_sorted(fixes.withColumnRenamed("word", "folded")), "folded", "left").withColumn("now", F.coalesce("correction", "word"))
    lists = fixed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "now"))).alias("w"), F.bool_or(F.col("now") != F.col("word")).alias("changed"))
    out = queries.join(_sorted(lists), "query_id", "left")
    # words stand between blanks, so a space on either side finds whole ones
    padded = F.concat(F.lit(" "), F.regexp_replace("query", r"\s+", " "), F.lit(" "))

    def swapped(text: Column, w: Column) -> Column:
        at = F.instr(text, F.concat(F.lit(" "), w["word"], F.lit(" ")))
        new = F.concat(F.substring(text, F.lit(1), at), w["now"], F.substring(text, at + 1 + F.length(w["word"]), F.length(text)))
        return F.when((w["word"] != w["now"]) & (at > 0), new).otherwise(text)

    whole = F.trim(F.aggregate("w", padded, swapped))
    plain = F.coalesce(F.transform("w", lambda x: x["now"]), F.col("plain"))
    return out.select("query_id", "query", plain.alias("plain"), "phrases", "fields", F.when(F.col("changed"), whole).alias("corrected"))


def _sorted(table: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted, and the other with it: sizes of files say little of their rows, and nothing of what these are exploded to, which no driver may have to hold."""
    return table.hint("merge")


def _best(left: DataFrame, gazetteer: DataFrame, order: list[Column]) -> DataFrame:
    """Of the gazetteer's entries that the rows of ``left`` (query_id, key and more) name, each query's first in ``order``, as ``found``."""
    entry = F.struct("term", "field", "record_count").alias("found")
    return left.join(_sorted(gazetteer), "key").groupBy("query_id").agg(F.min(F.struct(*order, entry)).alias("best")).select("query_id", "best.found")


def containing(asked: DataFrame, gazetteer: DataFrame, names_only: bool = False) -> DataFrame:
    """``query_id`` and ``found``: the commonest term whose words include all of ``asked`` (query_id, words), in their order.

    With ``names_only`` it is a name that begins or ends with the first of them.
    """
    parts = F.split("key", " ")
    spread = gazetteer.select("key", "term", "field", "record_count", parts.alias("parts"), F.explode(F.array_distinct(parts)).alias("word"))
    wanted = asked.select("query_id", "words", F.explode(F.array_distinct("words")).alias("word"))
    met = wanted.join(_sorted(spread), "word").groupBy("query_id", "key").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("words", "parts", "term", "field", "record_count")))
    # the place behind each word in turn, -1 once there is none
    place = lambda at, w: F.when(at >= 0, F.array_position(F.slice("parts", at + 1, F.size("parts")), w).cast("int")).otherwise(0)
    walked = F.aggregate("words", F.lit(0), lambda at, w: F.when(place(at, w) > 0, at + place(at, w)).otherwise(-1))
    fits = (F.col("n") == F.size(F.array_distinct("words"))) & (walked > 0)
    if names_only:
        first = F.get("words", F.lit(0))
        fits &= (F.col("field") == "name") & ((F.element_at("parts", 1) == first) | (F.element_at("parts", -1) == first))
    order = F.struct(F.col("record_count"), (-F.length("key")).alias("short"), F.col("key"))
    best = F.max_by(F.struct("term", "field", "record_count"), order)
    return met.where(fits).groupBy("query_id").agg(best.alias("found"))


def word_forms(word: Column) -> Column:
    """A word's other number, as catalogs may have it."""
    end = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    forms = F.array(F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), F.when(word.endswith("es"), end(2)), F.when(word.endswith("s"), end(1)))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def things(asked: DataFrame, vocab: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``query_id`` and ``found``: the topic or kind of object that another form of the single word of ``asked`` names."""
    forms = asked.select("query_id", F.posexplode(word_forms(F.get("words", F.lit(0)))).alias("at", "key"))
    used = forms.join(_sorted(vocab.select(F.col("term").alias("key"))), "key", "left_semi")
    return _best(used, gazetteer.where("field IN ('topic', 'object_type')"), [F.col("at")])


def mostly_names(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of ``asked`` whose single word at least half of the records that use it use in names."""
    wanted = asked.select("query_id", "words", F.get("words", F.lit(0)).alias("term"))
    hits = tokens.join(_sorted(wanted.select("term").distinct()), "term", "left_semi").groupBy("term", "record_id").agg(F.bool_or(F.col("field") == "names").alias("named"))
    counts = hits.groupBy("term").agg(F.count("*").alias("n"), F.count_if("named").alias("named"))
    return wanted.join(_sorted(counts.where("2 * named >= n")), "term").select("query_id", "words")


def sub_phrases(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``query_id`` and ``found``: the longest run of two or more words, but not all, that is a term; the first of that length."""
    n = F.size("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct((-k).alias("size"), i.alias("at"), F.array_join(F.slice("words", i + 1, k), " ").alias("key")))))
    each = asked.where(n > 2).select("query_id", F.explode(runs).alias("r")).select("query_id", "r.*")
    return _best(each, gazetteer, [F.col("size"), F.col("at")])


def gazetteer_matches(queries: DataFrame, gazetteer: DataFrame, vocab: DataFrame, tokens: DataFrame, has_names: bool = True) -> DataFrame:
    """``query_id``, ``term``, ``field``, ``record_count`` and ``whole``: the catalog term that a query (query_id, text) is, is part of or contains."""
    # each text is read once, and texts of the same words are one
    given = kept(queries.select("text").distinct().select("text", F.array_join(words(F.col("text")), " ").alias("asked")))
    own = given.select("asked").where("asked <> ''").distinct().select(F.col("asked").alias("query_id"), F.split("asked", " ").alias("all"))
    stop = F.array(*map(F.lit, STOP_WORDS))
    content = F.filter("all", lambda w: ~F.array_contains(stop, w))
    own = own.select("query_id", "all", F.when(F.size(content) > 0, content).otherwise(F.col("all")).alias("words"))
    keys = F.array_distinct(F.array(F.array_join("all", " "), F.array_join("words", " ")))
    exact = _best(own.select("query_id", F.posexplode(keys).alias("at", "key")), gazetteer, [F.col("at")]).withColumnRenamed("found", "exact")
    single, several = own.where(F.size("words") == 1), own.where(F.size("words") > 1)
    sides = {"thing": things(single, vocab, gazetteer), "inside": containing(several, gazetteer), "part": sub_phrases(several, gazetteer)}
    if has_names:
        sides["named"] = containing(mostly_names(single, tokens), gazetteer, names_only=True)
    out = own.join(_sorted(exact), "query_id", "left")
    for name, side in sides.items():
        out = out.join(_sorted(side.withColumnRenamed("found", name)), "query_id", "left")
    if not has_names:
        out = out.withColumn("named", F.lit(None).cast(_MATCH))
    thing = F.coalesce("exact", "thing")
    of_one = F.when(thing.isNull() | (F.col("named")["record_count"] > thing["record_count"]), F.coalesce(F.col("named"), thing)).otherwise(thing)
    whole = F.when(F.size("words") == 1, of_one).otherwise(F.coalesce("exact", "inside"))
    out = out.withColumn("whole_", whole).select(F.col("query_id").alias("asked"), F.coalesce("whole_", "part").alias("found"), F.col("whole_").isNotNull().alias("whole")).where("found IS NOT NULL")
    return queries.select("query_id", "text").join(_sorted(given.join(_sorted(out), "asked")), "text").select("query_id", "found.*", "whole")


def _weights(kind: Column, whole: Column, mode: str) -> tuple[Column, Column]:
    if mode in MODES:
        return tuple(F.lit(w) for w in MODES[mode])
    table = F.create_map(*(x for k, (a, b) in ROUTES.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))))
    own = F.when(~F.coalesce(whole, F.lit(True)), F.array(*map(F.lit, PARTIAL))).otherwise(F.coalesce(F.try_element_at(table, kind), F.array(*map(F.lit, ROUTES["description"]))))
    return own[0], own[1]


def routed(queries: DataFrame, tokens: DataFrame, vocab: DataFrame, gazetteer: DataFrame, shapes: DataFrame, fields: list[str], correct: bool = True, mode: str = "auto") -> DataFrame:
    """``query_id``, ``query``, ``plain``, ``phrases``, ``fields``, ``corrected``, ``text`` (for an encoder), ``kind``, ``term``, ``field``, ``record_count``, ``whole``, ``visual`` and ``keyword`` (weights) of each query."""
    # queries of the same text are one, called by it
    given = queries.select("query_id", F.coalesce("query", F.lit("")).alias("given"))
    rows = kept(parsed(given.select(F.col("given").alias("query_id"), F.col("given").alias("query")).distinct(), fields))
    rows = spelled(rows, vocab) if correct else rows.withColumn("corrected", F.lit(None).cast("string"))
    text = F.concat_ws(" ", F.concat("plain", "phrases", F.transform("fields", lambda x: x["value"])))
    lone = (F.size("plain") == 1) & (F.size("phrases") == 0) & (F.size("fields") == 0)
    rows = rows.withColumns({"text": text, "word": F.when(lone, F.get("plain", F.lit(0)))})
    numbered = F.when(F.col("word").rlike(r"\d"), shape(F.col("word"))) if "identifiers" in fields else F.lit(None).cast("string")
    known = shapes.select(F.col("shape").alias("own_shape"), F.lit(True).alias("known")).distinct()
    rows = rows.withColumn("own_shape", numbered).join(known, "own_shape", "left")
    open_ = rows.where((F.size("phrases") == 0) & (F.size("fields") == 0)).select("query_id", F.array_join("plain", " ").alias("text"))
    found = gazetteer_matches(open_, gazetteer, vocab, tokens, "names" in fields)
    rows = rows.join(_sorted(found.withColumnRenamed("field", "term_field")), "query_id", "left")
    exact = F.when(is_query_date(F.col("word")), "date").when(F.col("known"), "identifier")
    kind = F.coalesce(exact, F.when(F.size("fields") > 0, "field").when(F.size("phrases") > 0, "phrase").otherwise(F.coalesce("term_field", F.lit("description"))))
    rows = rows.withColumn("kind", kind)
    none = exact.isNotNull()
    of_term = lambda c: F.when(~none, F.col(c))
    field = F.when(F.col("kind") == "field", F.get("fields", F.lit(0))["field"]).otherwise(of_term("term_field"))
    rows = rows.select("query_id", "query", "plain", "phrases", "fields", "corrected", "text", "kind", of_term("term").alias("term"), field.alias("field"), of_term("record_count").alias("record_count"), of_term("whole").alias("whole"))
    visual, keyword = _weights(F.col("kind"), F.col("whole"), mode)
    rows = rows.select("*", visual.alias("visual"), keyword.alias("keyword")).withColumnRenamed("query_id", "given")
    return given.join(_sorted(rows), "given").drop("given")
