"""Documents to training ids: quality, near duplicates, repeated passages, benchmark leaks, BPE.

Each stage works on all that the one before kept. All but the last return the
columns of ``documents``.

Decisions belong to rows, not to ids. Quality and leaks judge each row's own
text. For near duplicates and repeated passages, rows of one id with different
texts are documents one after another, rows of one id and text are one
document (all stay or none), and rows without id are documents behind all
others; near duplicates among these go, too, equal ones but for one row.

Ids are whole numbers. Null texts count as empty ones and stay null. Columns
beyond those of ``documents`` come along, whatever they are called; the last
stage returns its own. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, decontaminate, minhash, quality, substrings
from vitrine.llm.checkpoints import removed, saved, shared_folder
from vitrine.llm.queries import table, word_vocabulary

#: Percent of shingles in common from which documents are near duplicates.
NEAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a half or more stay."""
    return quality.passed(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        kept = minhash.near_duplicates(docs, percent=NEAR).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    # ids do not tell documents apart: a number for each id and text, in the order of ids, written before it is used
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", tag.alias("tag"))
    numbers = rows.select(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).distinct().orderBy(F.col("of_id").asc_nulls_last(), "of_tag")
    numbers = saved(numbers.withColumn("number", F.monotonically_increasing_id()))
    numbered = rows.join(numbers, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tag") == F.col("of_tag"))).select("row", "doc_id", "text", "number")
    kept = minhash.near_duplicates(numbered, "number", percent=NEAR).where("kept").select("number").distinct()
    left = numbered.join(kept, "number", "left_semi")
    equal = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(~equal).select("row.*").unionAll(left.where(equal).dropDuplicates(["text"]).select("row.*"))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier go; texts without any stay as they are, texts of nothing else go."""
    rows = substrings.drop_repeats(docs, whole=True).where("n_removed = 0 OR kept_text <> ''")
    cut = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*(F.when(F.col("n_removed") > 0, cut[c]).otherwise(F.col("row")[c]).alias(c) if c in cut else F.col("row")[c].alias(c) for c in docs.columns))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go: rows of one text, whatever their ids, share the verdict."""
    digest = F.sha2("text", 256)
    found = decontaminate.contamination(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"), "digest")
    hit = found.where("n_hit > 0").select("digest").distinct()
    return docs.select(F.struct("*").alias("row"), digest.alias("digest")).join(hit, "digest", "left_anti").select("row.*")


def as_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of them and of what they decode to."""
    return bpe.round_trip(docs, word_vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("repeated_passages", no_repeats),
    ("benchmark_leaks", no_leaks),
    ("bpe", as_ids),
]

#: The classifier and the tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}-{name}")
        docs = spark.read.parquet(f"{top}/{i}-{name}")
        if i:  # what a stage has read isn't needed any more; the last one's rows are the result
            removed(spark, f"{top}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
