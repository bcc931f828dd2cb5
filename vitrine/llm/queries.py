"""The queries of the text-preparation operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, decontaminate, importance, language, licenses, lzprints, maintext, minhash, oracles, quality, ring, substrings, urls, veccodes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Where this machine has the public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = F.coalesce(quality.remainder("doc_id", 3) != 1, F.lit(False))
    model = quality.fit(documents, table(spark, sf_dir, "labels").where(learned))
    return quality.scored(documents, model).select(
        "doc_id",
        (quality.remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SHARDS = 24
URL_RULES: list[urls.Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES).drop("component")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("page", F.struct("page_id", "url"))
    return maintext.extracted(pages, "page").select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.where(F.coalesce(quality.remainder("doc_id", 4) != 2, F.lit(False))))
    found = language.identified(documents, model)
    return found.select("doc_id", (quality.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_lzprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    documents = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return ring.placed(documents, SHARDS).select("row.*", F.lit("rows").alias("law"), "shard", "slot", "grown_shard")


def op13_veccodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = veccodes.compressed(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_html": op3_html,
    "op4_substrings": op4_substrings,
    "op5_licenses": op5_licenses,
    "op6_language": op6_language,
    "op7_lzprints": op7_lzprints,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_urls": op10_urls,
    "op11_importance": op11_importance,
    "op12_sharding": op12_sharding,
    "op13_veccodes": op13_veccodes,
}
ORACLE_SQL: dict[str, str] = {
    "op2_minhash": oracles.NEAR_DUPLICATES,
    "op4_substrings": oracles.REPEATS,
    "op9_decontaminate": oracles.CONTAMINATION,
    "op10_urls": oracles.URLS,
    "op13_veccodes": oracles.VECTOR_CODES,
}
