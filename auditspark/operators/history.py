"""Version history: sections, function diffs, timelines, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_split(lines: DataFrame, heading: Column) -> DataFrame:
    """``section``: number of headings at or above each line."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(heading.cast("int")).over(w))


def full_diff(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """``change`` per key: added, removed, changed or same, by collapsed value."""
    b, n = before.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_inb")), now.select(*key, F.col(value).alias("_n"), F.lit(True).alias("_inn"))
    out = b.join(n, key, "full_outer")
    change = F.when(F.col("_inb").isNull(), "added").when(F.col("_inn").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_n")), "changed").otherwise("same")
    return out.select(*key, change.alias("change"))


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Status of each path (path, hash): added, deleted, modified, renamed, same.
    A deleted and an added path with one hash are a rename."""
    d = full_diff(before, now, ["path"], "hash")
    gone = d.where("change = 'removed'").join(before, "path").groupBy("hash").agg(F.min("path").alias("from"))
    came = d.where("change = 'added'").join(now, "path").join(gone, "hash", "left")
    new = came.select("path", F.when(F.col("from").isNotNull(), "renamed").otherwise("added").alias("change"), "from")
    moved = new.where("change = 'renamed'").select(F.col("from").alias("path"))
    old = d.where("change <> 'added'").join(moved, "path", "left_anti").select("path", F.when(F.col("change") == "removed", "deleted").when(F.col("change") == "changed", "modified").otherwise("same").alias("change"), F.lit(None).cast("string").alias("from"))
    return new.unionByName(old)


def verdict_timeline(rows: DataFrame) -> DataFrame:
    """``verdict`` of each finding at each version.

    Input: finding, version (orders), in_place, elsewhere, touched.  The state
    before is the row before of the finding; where nothing is vulnerable now or
    before, the last verdict is carried.
    """
    w = Window.partitionBy("finding").orderBy("version")
    prev, prev_else = F.lag("in_place").over(w), F.lag("elsewhere").over(w)
    r = rows.withColumn("_p", prev).withColumn("_pe", prev_else)
    now, other, p, pe = F.col("in_place"), F.col("elsewhere"), F.col("_p"), F.col("_pe")
    own = (
        F.when(p.isNull(), "STILL OPEN")
        .when(now & p & F.col("touched"), "BAND-AID")
        .when(now & p, "STILL OPEN")
        .when(now, "REGRESSED")
        .when(other & p, "BAND-AID")
        .when(p, "FIXED")
        .when(other & ~pe, "REGRESSED")
        .when(other, "BAND-AID")
        .when(pe, "FIXED")
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("_v", own).withColumn("verdict", F.last("_v", ignorenulls=True).over(upto)).select("finding", "version", "verdict")


def verdict_pivot(timeline: DataFrame) -> DataFrame:
    """Counts of each verdict per version."""
    kinds = ["FIXED", "BAND-AID", "STILL OPEN", "REGRESSED"]
    names = [k.lower().replace("-", "_").replace(" ", "_") for k in kinds]
    return timeline.groupBy("version").agg(*[F.count_if(F.col("verdict") == k).alias(n) for k, n in zip(kinds, names, strict=True)])


def version_key(tag: Column) -> Column:
    """Array that orders tags naturally: numbers before words, numbers by value."""
    chunks = F.filter(F.regexp_extract_all(F.lower(tag), F.lit("[0-9]{1,9}|[a-z]+"), F.lit(0)), lambda x: x != "")
    return F.transform(chunks, lambda x: F.struct((~x.rlike("^[0-9]")).alias("is_text"), F.coalesce(x.try_cast("int"), F.lit(0)).alias("number"), F.when(x.rlike("^[0-9]"), "").otherwise(x).alias("word")))


def change_multiset(before: DataFrame, now: DataFrame, key: list[str], item: str) -> DataFrame:
    """Statements added and removed with multiplicity: ``change``, ``times``."""
    b = before.groupBy(*key, item).agg(F.count("*").alias("_b"))
    n = now.groupBy(*key, item).agg(F.count("*").alias("_n"))
    d = b.join(n, [*key, item], "full_outer").withColumn("d", F.coalesce("_n", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    return d.where("d <> 0").select(*key, item, F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), F.abs("d").alias("times"))


def redive_sync(timeline: DataFrame, severity: DataFrame, queued: DataFrame) -> DataFrame:
    """New queue items: band-aids and regressions of any version, and open ones
    of high severity at the latest; those already queued (also resolved ones)
    are not queued again."""
    last = timeline.groupBy("finding").agg(F.max_by("verdict", "version").alias("verdict"))
    seen = timeline.where(F.col("verdict").isin("BAND-AID", "REGRESSED")).select("finding", F.col("verdict").alias("reason")).distinct()
    grave = severity.where(F.col("severity").isin("HIGH", "CRITICAL")).select("finding")
    left = last.where("verdict = 'STILL OPEN'").join(grave, "finding", "left_semi").select("finding", F.col("verdict").alias("reason"))
    return seen.unionByName(left).join(queued.select("finding", "reason"), ["finding", "reason"], "left_anti")


def current_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The newest status of each item."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def stale_claims(events: DataFrame, key: str, ts: str, kind: str, now: Column, days: int = 14) -> DataFrame:
    """Items whose newest status is a claim that is older than ``days``."""
    last = events.groupBy(key).agg(F.max_by(kind, F.struct(ts, "event_id")).alias("status"), F.max(F.when(F.col(kind) == "click", F.col(ts))).alias("claimed"))
    return last.where((F.col("status") == "click") & (F.col("claimed") < now - F.expr(f"INTERVAL {days} DAYS"))).select(key, "claimed")


def chunk_greedy(parts: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """``chunk`` of each part: parts are added in order until ``most`` is passed.

    The sum restarts at each cut, so it is a fold over the parts of one file
    (bounded by the file's size), not a window.
    """
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("ps"))
    start = F.expr("named_struct('chunk', 0L, 'held', 0L, 'out', cast(array() as array<struct<part:bigint,chunk:bigint>>))")

    def step(s, p):
        n = p[size].cast("long")
        full = (s["held"] > 0) & (s["held"] + n > most)
        chunk = s["chunk"] + full.cast("long")
        return F.struct(chunk.alias("chunk"), (F.when(full, F.lit(0).cast("long")).otherwise(s["held"]) + n).alias("held"), F.array_append(s["out"], F.struct(p[order].cast("long").alias("part"), chunk.alias("chunk"))).alias("out"))

    folded = lists.select(key, F.aggregate("ps", start, step, lambda s: s["out"]).alias("o"))
    return folded.select(key, F.explode("o").alias("o")).select(key, F.col("o.part").alias(order), F.col("o.chunk").alias("chunk"))


# Outcomes of a resolved item.
OUTCOMES = ("fixed", "accepted_risk", "still_open")


def redive_claim(events: DataFrame, claims: DataFrame, order: list[str]) -> DataFrame:
    """id, by, result of every claim: claimed, already resolved, or unknown.

    ``events``: id, status and the columns of ``order``; the newest status counts.
    Rows with the result ``claimed`` are the events to append.
    """
    now = current_status(events, "id", order, "status")
    result = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "resolved", "already resolved").otherwise("claimed")
    return claims.join(now, "id", "left").select("id", "by", result.alias("result"))


def redive_resolve(events: DataFrame, resolutions: DataFrame, order: list[str]) -> DataFrame:
    """id, by, result, outcome of every resolution: resolved, bad outcome (none of
    ``OUTCOMES``), or unknown.  An item may be resolved again with a new outcome."""
    now = current_status(events, "id", order, "status")
    good = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    result = F.when(F.col("status").isNull(), "unknown").when(~good, "bad outcome").otherwise("resolved")
    return resolutions.join(now, "id", "left").select("id", "by", result.alias("result"), F.when(result == "resolved", F.col("outcome")).alias("outcome"))
