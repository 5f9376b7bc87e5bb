"""Labelled manifests and target lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BUDGET = 200_000


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Units (path, language, labels) and unit labels of a corpus manifest."""
    raw = spark.read.option("multiLine", True).json(path)
    root = F.col("root") if "root" in raw.columns else F.lit(None).cast("string")
    units = raw.select(F.col("name").alias("corpus"), root.alias("root"), F.explode_outer("units").alias("u")).select("corpus", F.concat_ws("/", "root", "u.path").alias("path"), "u.language", F.col("u.vulnerabilities").alias("labels"))
    return units, units.select("path", F.explode("labels").alias("category"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Calibration cases: name, target, category, language, expect_confirmed."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("cases").alias("c")).select("c.name", "c.target", "c.category", "c.language", F.coalesce("c.expect_confirmed", F.lit(True)).alias("expect_confirmed"))


def manifest_problems(labels: DataFrame, files: DataFrame, least_chars: int = 40) -> DataFrame:
    """doc_id and problem: missing file, duplicate, unknown label, short text."""
    missing = labels.join(files.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("missing file").alias("problem"))
    double = labels.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("duplicate").alias("problem"))
    unknown = labels.where(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).select("doc_id", F.lit("unknown label").alias("problem"))
    short = files.where(F.col("n_chars") < least_chars).join(labels.select("doc_id"), "doc_id").select("doc_id", F.lit("short text").alias("problem"))
    return missing.unionByName(double).unionByName(unknown).unionByName(short)


def parse_targets(rows: DataFrame, spec: str) -> DataFrame:
    """`target|budget`: `max` is no limit (0), no or a bad number the default."""
    raw = F.trim(F.split_part(F.col(spec), F.lit("|"), F.lit(2)))
    budget = F.when(F.lower(raw) == "max", F.lit(0).cast("long")).otherwise(F.coalesce(raw.try_cast("long"), F.lit(DEFAULT_BUDGET).cast("long")))
    return rows.withColumn("target", F.trim(F.split_part(F.col(spec), F.lit("|"), F.lit(1)))).withColumn("budget", budget)
