"""Ledger queries: events as calls (user as scan, type as role, value as cost)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditspark.operators import ledger
from auditspark.shared import shared_dir
from auditspark.plans.base import query
from auditspark.sources import feeds

_MAX = "(SELECT max(ts) FROM events)"
# List prices per million tokens.
RATES = (("signup", 0, 0.14, 0.28), ("purch", 1, 5.0, 15.0), ("purchase", 2, 0.59, 0.79), ("cl", 3, 0.15, 0.6), ("click", 4, 1.1, 4.4))


def _rates(spark):
    return spark.createDataFrame(RATES, "model string, ord int, input double, output double")


@query(
    "price_calls",
    f"""WITH r(model, ord, i, o) AS (VALUES {", ".join(f"('{m}', {n}, {a}, {b})" for m, n, a, b in RATES)}), c AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || '-x' END AS model, user_id AS tin, user_id * 2 AS tout FROM events)
    SELECT event_id, round((tin * coalesce(e.i, p.i, 0.0) + tout * coalesce(e.o, p.o, 0.0)) / 1e6, 6) AS cost FROM c LEFT JOIN r e ON e.model = c.model
    LEFT JOIN (SELECT m.model, arg_min(r.i, r.ord) AS i, arg_min(r.o, r.ord) AS o FROM (SELECT DISTINCT model FROM c) m JOIN r ON starts_with(m.model, r.model) GROUP BY 1) p ON p.model = c.model""",
)
def price_calls(t):
    model = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("-x")))
    calls = t.events.select("event_id", model.alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"))
    return ledger.price_calls(calls, _rates(t.spark)).select("event_id", "cost")


@query("cost_by_role", "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost, count(*) AS calls FROM events GROUP BY ROLLUP(event_type)")
def cost_by_role(t):
    return ledger.cost_by(t.events, "event_type", "value")


@query("cost_totals", "SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost, count(*) AS calls FROM events GROUP BY ROLLUP(user_id)")
def cost_totals(t):
    return ledger.cost_by(t.events, "user_id", "value")


@query(
    "budget_state",
    f"""WITH s AS (SELECT CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS g, CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (CAST(ts AS DATE) = CAST({_MAX} AS DATE)) AS DOUBLE) AS d, CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (ts > {_MAX} - INTERVAL 30 DAY) AS DOUBLE) AS m FROM events),
    r AS (SELECT 'global' AS horizon, g AS spent, 1e9 AS lim FROM s UNION ALL SELECT 'day', coalesce(d, 0), 1000.0 FROM s UNION ALL SELECT 'month', m, 300000.0 FROM s)
    SELECT horizon, spent, lim AS "limit", CASE WHEN spent >= lim THEN 'exhausted' WHEN spent >= 0.8 * lim THEN 'warning' ELSE 'ok' END AS state FROM r""",
)
def budget_state(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0])
    return ledger.budget_state(t.events, now, {"global": 1e9, "day": 1000.0, "month": 300000.0}, cost="value")


@query("cost_ceiling", "SELECT event_id FROM (SELECT event_id, coalesce(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b <= 500")
def cost_ceiling(t):
    return ledger.cost_ceiling(t.events, "user_id", ["ts", "event_id"], "value", 500).select("event_id")


@query("rate_limited", "SELECT event_id, sent, sent >= 3 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS sent FROM events)")
def rate_limited(t):
    """Three or more events of a user within an hour."""
    return ledger.rate_limited(t.events, "user_id", "ts", 3, 3600).select("event_id", "sent", "limited")


@query("min_interval", "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events")
def min_interval(t):
    return ledger.min_interval(t.events, "user_id", ["ts", "event_id"], "ts").select("event_id", "gap")


@query("host_budget", "SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) ORDER BY page_id) AS n FROM pages) WHERE n <= 5")
def host_budget(t):
    from auditspark.functions.text import hostname_of

    return ledger.first_per_key(t.pages.withColumn("host", hostname_of(F.col("url"))), "host", ["page_id"], 5).select("page_id")


@query("retention", f"SELECT event_type, count_if(ts >= {_MAX} - INTERVAL 10 DAY) AS kept, count_if(ts < {_MAX} - INTERVAL 10 DAY) AS deleted FROM events GROUP BY 1")
def retention(t):
    """Rows kept and deleted by a limit of ten days."""
    kept, old = ledger.retention(t.events, F.lit(t.events.agg(F.max("ts")).first()[0]), 10)
    both = kept.withColumn("k", F.lit(1)).unionByName(old.withColumn("k", F.lit(0)))
    return both.groupBy("event_type").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("deleted"))


@query("append_ledger", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost FROM events GROUP BY 1, 2")
def append_ledger(t):
    """Events appended to a ledger in two runs, and what each day's folder holds then."""
    at = f"{shared_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for part in (0, 1):
        feeds.append_ledger(rows.where(F.col("event_id") % 2 == part), at)
    stored = feeds.read_ledger(t.spark, at, "event_id long, event_type string, value double, day date")
    return stored.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(ledger.MONEY)).cast("double").alias("cost"))


@query("read_ledger", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL")
def read_ledger(t):
    """Fields of JSON lines, written as text and read back; malformed ones are dropped."""
    at = f"{shared_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    t.events.select(line.alias("value")).write.text(at)
    stored = feeds.read_ledger(t.spark, at, "event_id long, props struct<k: long>")
    return stored.select("event_id", F.col("props.k").alias("k")).where("k IS NOT NULL")


@query(
    "fleet_merge",
    "SELECT user_id, min(ts) AS started, max(ts) AS finished, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost, count(*) AS calls, arg_min(event_type, event_id) AS first_type, count_if(event_type = 'error') AS errors FROM events GROUP BY 1",
)
def fleet_merge(t):
    return t.events.groupBy("user_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("finished"), F.sum(F.col("value").cast(ledger.MONEY)).cast("double").alias("cost"), F.count("*").alias("calls"), F.min_by("event_type", "event_id").alias("first_type"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


@query("fleet_health", "SELECT bool_and(bad) AS failed, count_if(bad) AS bad_users, count(*) AS users FROM (SELECT user_id, count_if(event_type = 'error') * 4 > count(*) AS bad FROM events GROUP BY 1)")
def fleet_health(t):
    u = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") * 4 > F.count("*")).alias("bad"))
    return u.agg(F.bool_and("bad").alias("failed"), F.count_if("bad").alias("bad_users"), F.count("*").alias("users"))
