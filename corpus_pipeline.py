"""Corpus cleaning: five stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditspark.llm import decontaminate, exact, packing, simhash, toxicity
from auditspark.llm.common import made, release, shared_dir, ship, table


# Every stage judges each row by its own text: a null text counts as empty, a null or
# repeated doc_id is no reason to drop a clean row, texts of any length are read
# whole, an empty table stays empty, and other columns stay whatever their names.


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the fitted toxicity grammar does not reject.  A null or empty text
    has no evidence and stays; repeats share one decision."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id (null
    only if there is no other), of full repeats one."""
    ship(spark)
    return exact.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest doc_id (null only
    if there is no other), ties by a hash of the text, of full repeats one.  All
    texts without a word are one component."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows with their sequence and place; an empty text is one
    piece, repeats are packed one by one."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Toxicity, SimHash and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again.  What a stage has put into the shared
    folder besides goes once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = made()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        release(spark, before)
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
