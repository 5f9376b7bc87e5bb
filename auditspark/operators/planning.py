"""Analysis plans: shares of a ranking that spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators.graph import _written


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rank`` from 0 in a total order, without a task that sees all rows.

    Rows are dealt by ranges, sorted within them and written; a row's rank is
    its place in its range plus the sizes of the ranges before.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = _written(placed.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")


def keep_fraction(rows: DataFrame, order: list[Column], fraction: float) -> DataFrame:
    """The first n - floor(n * (1 - fraction)) rows of an order."""
    ranked = global_rank(rows, order, "_rank")
    n = ranked.count()
    return ranked.where(F.col("_rank") < n - int(n * round(1 - fraction, 6))).drop("_rank")


def adaptive_plan(risks: DataFrame, remembered: DataFrame, dirty: DataFrame, key: str, fraction: float, boost: float = 2.5) -> DataFrame:
    """Risk plus a boost for remembered files, of the dirty ones, cut to a budget."""
    known = remembered.select(key).distinct().withColumn("_m", F.lit(boost))
    out = risks.join(dirty.select(key), key, "left_semi").join(known, key, "left")
    out = out.withColumn("risk", F.col("risk") + F.coalesce("_m", F.lit(0.0))).drop("_m")
    return keep_fraction(out, [F.desc("risk"), F.asc(key)], fraction)
