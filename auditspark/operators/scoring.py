"""Risk, money and error classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def risk_score() -> Column:
    """From the columns of a file summary."""
    add = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return (
        F.least("external_calls", F.lit(8)) * 1.5
        + add(F.col("moves_value"), 3.0)
        + add(F.col("reads_oracle"), 4.0)
        + add(F.col("behind_proxy"), 2.0)
        + add(F.col("has_assembly"), 3.0)
        + add(F.col("functions") >= 8, 2.0)
        + add(F.col("state_vars") >= 6, 1.0)
    )


def economic_estimate(findings: DataFrame, model: dict[str, tuple[float, float]], cap: float = 1e9) -> DataFrame:
    """``cost`` and ``profit`` by category; ``measured`` overrides the profit, up to ``cap``."""
    cost = F.create_map(*[F.lit(x) for k, v in model.items() for x in (k, v[0])])
    profit = F.create_map(*[F.lit(x) for k, v in model.items() for x in (k, v[1])])
    kind = F.lower("category")
    return findings.withColumn("cost", F.coalesce(cost[kind], F.lit(0.0))).withColumn("profit", F.when(F.col("measured").isNotNull(), F.least("measured", F.lit(cap))).otherwise(F.coalesce(profit[kind], F.lit(0.0))))


def researcher_payout(bounty: Column, share: float = 0.1, cap: float = 50_000.0) -> Column:
    return F.when(bounty <= 0, F.lit(0.0)).otherwise(F.least(F.round(bounty * share, 6), F.lit(cap)))


def scan_estimate(chunks: DataFrame, input_rate: float, output_rate: float, tokens_in: int, tokens_out: int, calls: int, seconds: float = 6.0) -> DataFrame:
    """``cost`` (rates per million tokens, output included) and ``seconds``."""
    cost = F.col("chunks") * tokens_in / 1e6 * input_rate + F.col("chunks") * tokens_out / 1e6 * output_rate
    return chunks.withColumn("cost", F.round(cost, 6)).withColumn("seconds", F.col("chunks") * calls * seconds)


def classify_error(name: Column, message: Column) -> Column:
    """What a batch loop does after an error: abort, retry, skip, continue."""
    m, n = F.lower(message), F.lower(name)
    return F.when(F.contains(m, F.lit("cost ceiling")), "abort").when(m.rlike("timed out|timeout|unreachable|temporarily|rate limit|connection"), "retry").when(n.rlike("timeout|connection|oserror"), "retry").when(F.contains(m, F.lit("scope denied")), "skip").otherwise("continue")
