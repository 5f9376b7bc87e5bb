"""Ledgers: prices, costs, budgets, ceilings, rates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def price_calls(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """``cost`` of each call: the rate of its exact model, else of the first
    listed model that is a prefix of it, else 0.

    Only distinct model names meet the prefix comparison; which side is broadcast
    is left to the sizes that Spark sees.
    """
    models = calls.select("model").distinct()
    exact = models.join(rates, "model").select("model", "input", "output", F.lit(-1).alias("ord"))
    p = rates.select(F.col("model").alias("prefix"), "ord", "input", "output")
    prefix = models.join(p, F.col("model").startswith(F.col("prefix"))).select("model", "input", "output", "ord")
    best = exact.unionByName(prefix).groupBy("model").agg(F.min_by(F.struct("input", "output"), "ord").alias("rate"))
    out = calls.join(best, "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("rate.input", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("rate.output", F.lit(0.0))) / 1e6
    return out.withColumn("cost", F.round(cost, 6)).drop("rate")


def cost_by(calls: DataFrame, role: str, cost: str) -> DataFrame:
    """Cost and calls per role, with a total row."""
    return calls.rollup(role).agg(F.sum(F.col(cost).cast(MONEY)).cast("double").alias("cost"), F.count("*").alias("calls"))


def budget_state(calls: DataFrame, now: Column, limits: dict[str, float], ts: str = "ts", cost: str = "cost", warn: float = 0.8) -> DataFrame:
    """Spend over all time, the UTC day and the last 30 days, with a state each:
    exhausted from the limit on, warning from ``warn`` of it on."""
    money = F.col(cost).cast(MONEY)
    spent = calls.select(
        F.sum(money).alias("global"), F.sum(F.when(F.to_date(ts) == F.to_date(now), money)).alias("day"), F.sum(F.when(F.col(ts) > now - F.expr("INTERVAL 30 DAYS"), money)).alias("month")
    )
    rows = spent.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(h), F.lit(0)).cast("double").alias("spent"), F.lit(float(limits[h])).alias("limit")) for h in ("global", "day", "month")])).alias("r")).select("r.*")
    state = F.when(F.col("limit") <= 0, "ok").when(F.col("spent") >= F.col("limit"), "exhausted").when(F.col("spent") >= warn * F.col("limit"), "warning").otherwise("ok")
    return rows.withColumn("state", state)


def cost_ceiling(calls: DataFrame, key: str, order: list[str], cost: str, ceiling: float) -> DataFrame:
    """Calls until the running total of a key passes the ceiling; the call that
    crosses it is recorded, later ones are not."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("_b", F.coalesce(F.sum(F.col(cost).cast(MONEY)).over(before), F.lit(0))).where(F.col("_b") <= ceiling).drop("_b")


def rate_limited(rows: DataFrame, key: str, ts: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """``sent``: events of the key in the window that ends with this one."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("sent", F.count("*").over(w)).withColumn("limited", F.col("sent") >= most)


def min_interval(rows: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """Seconds since the key's event before."""
    w = Window.partitionBy(key).orderBy(*order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn("gap", (at - F.lag(at).over(w)) / 1e6)


def first_per_key(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def retention(rows: DataFrame, now: Column, days: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and those older than ``days``."""
    old = F.col(ts) < now - F.expr(f"INTERVAL {days} DAYS")
    return rows.where(~old), rows.where(old)
