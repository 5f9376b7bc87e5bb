"""Scoring of findings against labels, and gates on the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def match_labels(findings: DataFrame, labels: DataFrame, unit: str = "doc_id") -> DataFrame:
    """``tp``: whether the unit carries the finding's category."""
    marked = labels.select(unit, "category").distinct().withColumn("_l", F.lit(True))
    return findings.join(marked, [unit, "category"], "left").withColumn("tp", F.col("_l").isNotNull()).drop("_l")


def missed_labels(findings: DataFrame, labels: DataFrame, unit: str = "doc_id") -> DataFrame:
    return labels.select(unit, "category").distinct().join(findings.select(unit, "category"), [unit, "category"], "left_anti")


def clean_hits(findings: DataFrame, units: DataFrame, labels: DataFrame, unit: str = "doc_id") -> DataFrame:
    """Findings on units without any label."""
    clean = units.select(unit).join(labels.select(unit), unit, "left_anti")
    return findings.join(clean, unit, "left_semi")


def _measures(rows: DataFrame) -> DataFrame:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("positives") - F.col("fn"), F.col("positives"))
    out = rows.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4))
    return out.withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))


def bench_scores(findings: DataFrame, units: DataFrame, labels: DataFrame, unit: str = "doc_id") -> DataFrame:
    """tp and fp of findings, fn of labels; overall, per language, per category.

    Findings and labels are counted by (unit, category) and joined once, so each is
    read once; one grouping-sets aggregate gives all scopes.
    """
    found = findings.groupBy(unit, "category").agg(F.count("*").alias("n"))
    truth = labels.groupBy(unit, "category").agg(F.count("*").alias("positives"))
    both = found.join(truth, [unit, "category"], "full_outer").join(units.select(unit, "language"), unit)
    n, known = F.coalesce("n", F.lit(0)), F.col("positives").isNotNull()
    rows = both.select("language", "category", F.when(known, n).otherwise(0).alias("tp"), F.when(known, 0).otherwise(n).alias("fp"), F.coalesce("positives", F.lit(0)).alias("positives"), F.when(F.col("n").isNull(), F.col("positives")).otherwise(0).alias("fn"))
    sets = rows.groupingSets([[], [F.col("language")], [F.col("category")]], F.col("language"), F.col("category"))
    return _measures(sets.agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "positives", "fn")]))


def bench_weighted(findings: DataFrame, units: DataFrame, labels: DataFrame, unit: str = "doc_id") -> DataFrame:
    """Confidence sums; a label is detected as strongly as its best finding."""
    conf = F.col("confidence").cast("decimal(10,4)")
    known = match_labels(findings.join(units.select(unit), unit, "left_semi"), labels, unit)
    w = known.agg(F.sum(F.when(F.col("tp"), conf).otherwise(0)).alias("weighted_tp"), F.sum(F.when(F.col("tp"), 0).otherwise(conf)).alias("weighted_fp"))
    best = findings.groupBy(unit, "category").agg(F.max(conf).alias("best"))
    strength = labels.join(units.select(unit), unit, "left_semi").join(best, [unit, "category"], "left").agg(F.sum(F.coalesce("best", F.lit(0))).alias("detected"), F.count("*").alias("positives"))
    out = w.crossJoin(strength)  # one row each
    p, r = ratio(F.col("weighted_tp"), F.col("weighted_tp") + F.col("weighted_fp")), ratio(F.col("detected"), F.col("positives"))
    return out.select(*[F.col(c).cast("double").alias(c) for c in ("weighted_tp", "weighted_fp", "detected")], (F.col("positives") - F.col("detected")).cast("double").alias("weighted_fn"), F.round(p.cast("double"), 4).alias("weighted_precision"), F.round(r.cast("double"), 4).alias("weighted_recall"))


def confusion_matrix(rows: DataFrame, expected: Column, outcome: Column) -> DataFrame:
    c = rows.agg(*[F.count_if(x).alias(n) for n, x in (("tp", expected & outcome), ("fp", ~expected & outcome), ("fn", expected & ~outcome), ("tn", ~expected & ~outcome))])
    return c.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4))


def label_map_recall(findings: DataFrame, labels: DataFrame, bridge: DataFrame, unit: str = "doc_id") -> DataFrame:
    """Per label kind: how many are hit by any of the detector categories mapped to it."""
    wanted = labels.select(unit, F.col("category").alias("label")).join(F.broadcast(bridge), "label", "left")  # the bridge is a fixed table
    seen = findings.select(unit, F.col("category").alias("detector")).distinct().withColumn("_hit", F.lit(True))
    each = wanted.join(seen, [unit, "detector"], "left").groupBy(unit, "label").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("hit"))
    return each.groupBy("label").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def report_diff(before: DataFrame, now: DataFrame, key: list[str], slack: float = 0.0) -> DataFrame:
    """Per scope: metric deltas and whether a metric fell by more than ``slack``."""
    b = before.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(m).alias(f"_{m}") for m in ("precision", "recall", "f1")])
    same = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    j = now.join(b, same, "left")
    d = {m: F.round(F.col(m) - F.coalesce(F.col(f"_{m}"), F.lit(0.0)), 4) for m in ("precision", "recall", "f1")}
    return j.select(*key, *[x.alias(f"{m}_delta") for m, x in d.items()], ((d["precision"] < -slack) | (d["recall"] < -slack)).alias("regressed"))


def new_rows(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    return now.select(*key).distinct().join(before.select(*key), key, "left_anti")


def gate(scores: DataFrame, precision: float, recall: float, most_fp: int) -> DataFrame:
    """Whether each scope's scores meet the limits."""
    return scores.withColumn("passed", (F.col("precision") >= precision) & (F.col("recall") >= recall) & (F.col("fp") <= most_fp))
