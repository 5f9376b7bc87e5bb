"""Sinks: raw feed records, SARIF documents, ledgers, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions.text import sarif_level


def route(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "manual-verification").otherwise("internal-review")


def raw_feed_json(findings: DataFrame) -> DataFrame:
    """One JSON record per finding, with its reproduction nested."""
    nested = F.struct(F.col("log_tail").alias("log"), F.col("route"))
    flat = [c for c in findings.columns if c not in ("log_tail", "route")]
    return findings.select(F.to_json(F.struct(*flat, nested.alias("reproduction"))).alias("value"))


def write_raw_feed(findings: DataFrame, path: str) -> None:
    raw_feed_json(findings).write.mode("append").text(path)


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF run per target (rules once per id, results with a level)."""
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.col("doc_id").cast("string").alias("uri"))
    runs = findings.groupBy("target").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), F.collect_list(result).alias("results"))
    return runs.select("target", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.struct("rules", "results").alias("run"))).alias("value"))


def append_ledger(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a ledger, one folder per day."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a ledger; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_snapshot(rows: DataFrame, folder: str, version: int) -> str:
    """A new snapshot folder of a table; readers take the highest version."""
    path = f"{folder}/v={version}"
    rows.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    all_ = spark.read.parquet(folder)
    newest = all_.agg(F.max("v")).first()[0]
    return all_.where(F.col("v") == newest).drop("v")
