"""Variants of known findings: signatures against files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = "[a-z]{8,}"


def keyword_match(files: DataFrame, signatures: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, score: the share of a signature's keywords in a file.

    Keywords meet in an equality join; the signatures' side is small and is
    broadcast by Spark below its threshold.
    """
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0)))).alias("w"))
    keys = words(signatures, "item_id")
    total = keys.groupBy("item_id").agg(F.count("*").alias("total"))
    found = words(files, "doc_id").join(keys, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("found"))
    out = found.join(total, "item_id").where((F.col("found") >= 2) & (F.col("found") >= F.col("total") * share))
    return out.select("doc_id", "item_id", F.round(F.col("found") / F.col("total"), 4).alias("score"))
