"""Values along an order within keys, where a key may hold any share of the rows.

A window over a key puts the key into one task.  Here rows are dealt by ranges of
(key, order) and written, so a hot key lies in many parts; windows run within a part,
and what a part needs of the parts before is one row.  At most the first key of a part
goes on from an earlier one, so these rows are as many as there are parts and are
broadcast.

A null key is a key.  Rows of one key with equal places keep some order among each
other; names that begin with ``_at_`` must not be columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.shared import written

_PART = "_at_part"


def _dealt(rows: DataFrame, keys: list[str], order: str, into: str | None = None) -> DataFrame:
    placed = rows.repartitionByRange(*keys, order).withColumn(_PART, F.spark_partition_id())
    if into is None:
        return written(placed, "ranges")
    placed.write.mode("overwrite").parquet(into)
    return rows.sparkSession.read.schema(placed.schema).parquet(into)


def _with_earlier(placed: DataFrame, keys: list[str], of_part: Column, earlier) -> DataFrame:
    """``_at_earlier`` for each row: what ``earlier`` makes of the values of the key's parts before."""
    parts = placed.groupBy(*keys, _PART).agg(of_part.alias("_at_value"))
    carried = parts.withColumn("_at_earlier", earlier(F.col("_at_value"), Window.partitionBy(*keys).orderBy(_PART))).where("_at_earlier IS NOT NULL")
    names = {k: f"_at_key{i}" for i, k in enumerate(keys)}
    carried = F.broadcast(carried.select(F.col(_PART).alias("_at_of"), "_at_earlier", *[F.col(k).alias(n) for k, n in names.items()]))
    same = F.col(_PART) == F.col("_at_of")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return placed.join(carried, same, "left").drop("_at_of", *names.values())


def with_previous(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "previous", into: str | None = None) -> DataFrame:
    """``name``: the value of the row before in the key; null for its first row.  The
    dealt rows lie in ``into`` (the caller's to remove) or among the intermediate tables."""
    placed = _dealt(rows, keys, order, into)
    last = F.max_by(F.struct(F.col(value).alias("v")), order)
    found = _with_earlier(placed, keys, last, lambda c, w: F.lag(c).over(w))
    within = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(_PART, *keys).orderBy(order))
    return found.withColumn(name, F.coalesce(within, F.col("_at_earlier"))["v"]).drop(_PART, "_at_earlier")


def with_sum_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "before") -> DataFrame:
    """``name``: the sum of the values of the rows before in the key; 0 for its first
    row.  Null values count as 0."""
    placed = _dealt(rows.withColumn("_at_n", F.coalesce(F.col(value), F.lit(0))), keys, order)
    before = (Window.unboundedPreceding, -1)
    found = _with_earlier(placed, keys, F.sum("_at_n"), lambda c, w: F.sum(c).over(w.rowsBetween(*before)))
    within = F.sum("_at_n").over(Window.partitionBy(_PART, *keys).orderBy(order).rowsBetween(*before))
    zero = F.lit(0)
    return found.withColumn(name, F.coalesce(within, zero) + F.coalesce(F.col("_at_earlier"), zero)).drop(_PART, "_at_earlier", "_at_n")
