"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.shared import BROADCAST_BYTES, made, release, shared_dir, small, written
from auditspark.shipping import ship

__all__ = ["BROADCAST_BYTES", "ascii_lower", "few_rows", "fields_of", "fold", "made", "packed", "quoted", "release", "sampled", "shared_dir", "ship", "small", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """The column of this very name, also where it has dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **named) -> DataFrame:
    """The rows of ``docs`` as one struct next to columns of our own, so that no
    name of theirs can clash with one of ours."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in named.items()])


def fields_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of rows that ``packed`` made."""
    return rows.select("row.*") if docs.columns else docs


def few_rows(batches, rows: int = 256):
    """Arrow batches cut into small ones, so that what is made of their texts in
    Python stays small next to the batch itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def fold(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def sampled(df: DataFrame, key: str, bound: int, n: int | None = None) -> DataFrame:
    """About ``bound`` rows of ``df`` (of ``n``) chosen by a hash of ``key``; all
    rows when there are no more than that.  Used only to fit models."""
    n = df.count() if n is None else n
    if n <= bound:
        return df
    cut = int(bound / n * (1 << 30))
    return df.where(F.expr(f"pmod(xxhash64({key}, 'fit'), {1 << 30})") < cut)
