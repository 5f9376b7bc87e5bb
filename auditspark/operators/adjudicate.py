"""Adjudication over vote tables and evidence memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble_apply(findings: DataFrame, votes: DataFrame, key: str) -> DataFrame:
    """``status`` and ``adjusted`` after a review: uphold raises, downgrade
    lowers, overturn rejects; no vote changes nothing."""
    out = findings.join(votes.select(key, "verdict"), key, "left")
    c = F.col("confidence")
    adjusted = F.when(F.col("verdict") == "uphold", F.least(F.lit(0.99), c + 0.05)).when(F.col("verdict") == "downgrade", F.greatest(F.lit(0.05), c * 0.65)).when(F.col("verdict") == "overturn", F.lit(0.05)).otherwise(c)
    return out.withColumn("status", F.when(F.col("verdict") == "overturn", "REJECTED").otherwise("POTENTIAL")).withColumn("adjusted", F.round(adjusted, 4))


def validate_judge(votes: DataFrame, least: float = 0.9) -> DataFrame:
    """``problem`` of each judge's row; null if it can be used."""
    problem = (
        F.when(~F.coalesce(F.col("decision").isin("keep", "reject"), F.lit(False)), "decision")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence")
        .when((F.col("confidence") >= least) & (F.coalesce("cited", F.lit(0)) == 0), "evidence")
    )
    return votes.withColumn("problem", problem)


def panel_decide(first: Column, second: Column, machine: Column) -> Column:
    """Decision of two judges and a machine check (null: no result).

    The first judge's keep settles it; two rejects reject; disagreement asks the
    machine, else escalates; one reject alone never drops; no judge keeps."""
    return (
        F.when(first == "keep", "keep")
        .when((first == "reject") & (second == "reject"), "reject")
        .when((first == "reject") & (second == "keep"), F.when(machine, "keep").when(~machine, "reject").otherwise("escalate"))
        .when(first == "reject", "escalate")
        .when(second == "keep", "keep")
        .when(second == "reject", "escalate")
        .otherwise("keep")
    )


def machine_tier(findings: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Reproduced confirms, disproved rejects, no result falls through."""
    out = findings.join(results.select(key, "reproduced"), key, "left")
    status = F.when(F.col("reproduced"), "CONFIRMED").when(~F.col("reproduced"), "REJECTED").otherwise("POTENTIAL")
    adjusted = F.when(F.col("reproduced"), F.greatest(F.lit(0.9), F.col("confidence"))).when(~F.col("reproduced"), F.lit(0.05)).otherwise(F.col("confidence"))
    return out.withColumn("status", status).withColumn("adjusted", adjusted)


def apply_memory(findings: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """Earlier verdicts: confirmed re-attaches, rejected and overturned reject."""
    out = findings.join(memory.select(key, "verdict"), key, "left")
    status = F.when(F.col("verdict") == "confirmed", "CONFIRMED").when(F.col("verdict").isin("rejected", "overturned"), "REJECTED").otherwise("POTENTIAL")
    return out.withColumn("status", status).withColumn("note", F.when(F.col("verdict").isNotNull(), F.concat(F.lit("memory: "), F.col("verdict"))))


def parse_vote(raw: Column) -> Column:
    """(verdict, confidence) of a judge's answer: the first JSON object in it that
    has a ``decision``.  A decision other than keep or reject gives no verdict; a
    confidence is cut to 0 to 1, and 0 where it is no number."""
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\{[^{}]*\"decision\"[^{}]*\})", 1)
    decision = F.lower(F.trim(F.get_json_object(found, "$.decision")))
    number = F.get_json_object(found, "$.confidence").try_cast("double")
    return F.struct(F.when(decision.isin("keep", "reject"), decision).alias("verdict"), F.least(F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
