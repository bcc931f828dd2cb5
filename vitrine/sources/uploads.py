"""Images that come as base64 text, checked before anything is decoded: size by the text's length, pixels by the header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.profile import image_headers

#: The most that is taken of one upload, and first bytes that a header is looked for in.
MOST_BYTES, MOST_PIXELS, HEAD_BYTES = 10 << 20, 50_000_000, 128 << 10


def uploaded(rows: DataFrame, id_col: str = "id", data_col: str = "data", most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``id_col`` (told apart by it), ``content``, ``width``, ``height`` and ``error``, a row for each row.

    ``data_col`` is base64, with or without ``data:…;base64,`` before it. What
    is null or empty, too large, no base64, no image that is known, or has too
    many pixels has an error in place of its content. Rows of one id must hold one upload.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{data_col}`"), F.lit("")), r"^data:[^,]*;base64,", ""), r"\s", "")
    size = F.floor(F.length(F.rtrim(text, F.lit("="))) * 3 / 4)
    given = rows.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{id_col}`").alias("id"), size.alias("size"), F.when(size <= most_bytes, F.try_to_binary(text, F.lit("base64"))).alias("content"))
    heads = image_headers(given.where("content IS NOT NULL AND size > 0").select("key", F.substring("content", 1, HEAD_BYTES).alias("head")).dropDuplicates(["key"])).select(F.col("key").alias("of"), "width", "height")
    met = given.join(heads, F.col("key").eqNullSafe(F.col("of")), "left")
    pixels = F.col("width").cast("long") * F.col("height")
    error = (
        F.when(F.col("size") == 0, "empty")
        .when(F.col("size") > most_bytes, f"over {most_bytes} bytes")
        .when(F.col("content").isNull(), "not base64")
        .when(pixels.isNull() | (pixels <= 0), "not a known image")
        .when(pixels > most_pixels, f"over {most_pixels} pixels")
    )
    fine = error.isNull()
    return met.select(F.col("id").alias(id_col), F.when(fine, F.col("content")).alias("content"), F.when(fine, F.col("width")).alias("width"), F.when(fine, F.col("height")).alias("height"), error.alias("error"))
