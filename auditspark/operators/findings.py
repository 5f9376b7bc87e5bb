"""Findings: identity, deduplication, corroboration, ranking, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.text import severity_rank


def dedupe_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which must be total)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def consensus(rows: DataFrame, key: list[str], engine: str = "engine", confidence: str = "confidence", weak_engine: str = "heuristic") -> DataFrame:
    """Raise findings that two or more engines share, lower lone weak ones.

    ``sources`` (engines of the group), ``corroborated`` and ``adjusted``.  The
    engines of a group are gathered by an aggregate, which combines before its
    shuffle, and joined back; all members of a group are treated alike.
    """
    sources = rows.groupBy(*key).agg(F.array_sort(F.collect_set(engine)).alias("sources"))
    return _adjusted(rows.join(sources, key), engine, confidence, weak_engine)


def _adjusted(out: DataFrame, engine: str, confidence: str, weak_engine: str) -> DataFrame:
    many = F.size("sources") >= 2
    lone = ~many & (F.col(engine) == weak_engine) & (F.col(confidence) < 0.55)
    adjusted = F.when(many, F.least(F.lit(0.99), F.col(confidence) + 0.15)).when(lone, F.greatest(F.lit(0.05), F.col(confidence) - 0.05)).otherwise(F.col(confidence))
    return out.withColumn("corroborated", many).withColumn("adjusted", F.round(adjusted, 4))


def consensus_in_rows(rows: DataFrame, weak_engine: str = "heuristic") -> DataFrame:
    """``consensus`` by (doc_id, category) over ``found_rules``: all findings of a
    document stand in one row, so its engines are looked up there, without a shuffle."""
    r = rows.select("doc_id", "target", "language", "found", F.explode("found").alias("r"))
    engines = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["category"] == F.col("r.category")), lambda x: x["engine"])))
    r = r.select("doc_id", "target", "language", "r.*", engines.alias("sources"))
    return _adjusted(r, "engine", "confidence", weak_engine)


def dedupe_first_in_rows(rows: DataFrame, stage) -> DataFrame:
    """``dedupe_first`` by (doc_id, category) over ``found_rules``, by ``stage`` (of an
    engine column) and rule_id, without a shuffle."""
    r = rows.select("doc_id", "target", "language", "found", F.explode("found").alias("r"))
    order = lambda x: F.struct(stage(x["engine"]).alias("stage"), x["rule_id"].alias("rule"))
    beaten = F.exists("found", lambda x: (x["category"] == F.col("r.category")) & (order(x) < order(F.col("r"))))
    return r.where(~beaten).select("doc_id", "target", "language", "r.*")


def rank_findings(rows: DataFrame, tie: str = "fingerprint") -> DataFrame:
    return rows.orderBy(severity_rank(F.col("severity")).desc(), F.desc("confidence"), F.asc(tie))


def severity_at_least(rows: DataFrame, least: str) -> DataFrame:
    return rows.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def filter_findings(rows: DataFrame, status: str | None = None, target_like: str | None = None, severity: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("severity", severity)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.where(F.col("target").cast("string").like(target_like)) if target_like else rows


def upsert(stored: DataFrame, batch: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Stored findings after a batch: new keys come in; for known ones the last
    sighting and severity are the batch's, first sighting and status stay, and a
    paid amount is never lost.  Both sides have one row per key."""
    s, b = stored.alias("s"), batch.alias("b")
    old = F.col(f"s.{key}").isNotNull()
    return s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer").select(
        F.coalesce(f"s.{key}", f"b.{key}").alias(key),
        F.coalesce("b.target", "s.target").alias("target"),
        F.when(old, F.col("s.status")).otherwise(F.col("b.status")).alias("status"),
        F.coalesce("b.severity", "s.severity").alias("severity"),
        F.coalesce(F.when(F.col("b.paid") != 0, F.col("b.paid")), F.col("s.paid"), F.col("b.paid")).alias("paid"),
        F.when(old, F.col("s.seen")).otherwise(F.col("b.seen")).alias("first_seen"),
        F.coalesce("b.seen", "s.seen").alias("last_seen"),
    )


def newest_of(batch: DataFrame, key: str = "fingerprint") -> DataFrame:
    """One row per key of a batch: its latest sighting, with ``first_seen`` the earliest."""
    others = [c for c in batch.columns if c not in (key, "seen")]
    rows = batch.groupBy(key).agg(F.max(F.struct("seen", *others)).alias("r"), F.min("seen").alias("first_seen"))
    return rows.select(key, *[F.col("r")[c].alias(c) for c in others], F.col("r.seen").alias("seen"), "first_seen")


def upsert_store(stored: DataFrame | None, batch: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``upsert`` into a stored snapshot (None: an empty one) of a batch that may
    repeat keys.  The first sighting is the earliest of the store and the batch."""
    new = newest_of(batch, key)
    store = new.limit(0).withColumn("last_seen", F.col("seen")) if stored is None else stored.withColumn("seen", F.col("first_seen"))
    out = upsert(store, new.drop("first_seen"), key)
    first = new.select(F.col(key).alias("k"), F.col("first_seen").alias("f"))
    return out.join(first, F.col(key) == F.col("k"), "left").withColumn("first_seen", F.least("first_seen", F.coalesce("f", "first_seen"))).drop("k", "f")


def resolve_prefix(prefixes: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """``prefix``, ``state`` (unique, ambiguous, missing) and the ``key`` if unique.

    Prefixes have one fixed length, so the match is an equality join on the
    keys' own prefix, not a comparison of all pairs.
    """
    by = keys.select("key", F.left("key", F.lit(length)).alias("_p")).groupBy("_p").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    out = prefixes.join(by, prefixes["prefix"] == by["_p"], "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("unique")
    return out.select("prefix", state.alias("state"), F.when(F.col("n") == 1, F.col("key")).alias("key"))


def status_changes(rows: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Rows where the status differs from the one before, with ``old_status``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("old_status", F.lag(status).over(w)).where(~F.col("old_status").eqNullSafe(F.col(status)))


def summary(rows: DataFrame) -> DataFrame:
    """Counts and paid sum: total, by status, by severity."""
    sets = rows.groupingSets([[], [F.col("status")], [F.col("severity")]], F.col("status"), F.col("severity"))
    return sets.agg(F.count("*").alias("n"), F.sum("paid").cast("double").alias("paid"))
