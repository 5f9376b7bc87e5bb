"""Streams over the events table, run once, against batch oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditspark.functions.text import trigger_id
from auditspark.operators.findings import upsert_store
from auditspark.plans.base import query
from auditspark.shared import shared_dir
from auditspark.streaming import jobs, store


def _events(t):
    schema = t.events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    # A pattern names the table whether it is one file or a folder of files.
    return jobs.read_events(t.spark, f"{t.folder}/event[s].parquet", schema)


def _run(t, stream, mode="append"):
    at = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_once(stream, f"{at}/out", f"{at}/checkpoint", mode)
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("deployment_stream", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def deployment_stream(t):
    watch = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return _run(t, jobs.deployment_stream(_events(t), watch, "user_id", F.col("event_type") == "purchase").select("event_id", "user_id"))


@query("upgrade_stream", "SELECT user_id, event_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events WHERE event_type IN ('click', 'view')) WHERE old IS NOT NULL AND old <> event_type")
def upgrade_stream(t):
    e = _events(t).where(F.col("event_type").isin("click", "view"))
    at = f"{shared_dir(t.spark)}/upgrades-{uuid.uuid4().hex}"
    jobs.upgrade_stream(e, "user_id", "event_type", "event_id", at, f"{at}/checkpoint", buckets=16).awaitTermination()
    kind = dict(t.events.dtypes)
    return t.spark.read.schema(f"user_id {kind['user_id']}, event_id {kind['event_id']}, old string, new string").parquet(f"{at}/changes").select("user_id", "event_id", "old", "new")


@query("trigger_queue_stream", "SELECT DISTINCT left(sha256(CAST(user_id AS VARCHAR) || event_type), 16) AS trigger_id FROM events")
def trigger_queue_stream(t):
    e = _events(t).withColumn("trigger_id", trigger_id(F.col("user_id"), F.col("event_type")))
    return _run(t, jobs.trigger_queue(e, keep="60 days").select("trigger_id"))


@query(
    "drain_triggers",
    """SELECT left(sha256(CAST(user_id AS VARCHAR) || event_type), 16) AS trigger_id, CASE event_type WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'completed' END AS status,
    CASE WHEN event_type NOT IN ('signup', 'error') THEN length(event_type) END AS findings FROM events WHERE value > 20 AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type""",
)
def drain_triggers(t):
    """Every trigger handled once, over two runs on one cursor; those without a
    target are skipped, and errors stay with their trigger."""
    at = f"{shared_dir(t.spark)}/drain-{uuid.uuid4().hex}"

    def work(target: str) -> int:
        if target == "error":
            raise ValueError(target)
        return len(target)

    target = F.when(F.col("event_type") != "signup", F.col("event_type"))
    e = _events(t).where("value > 20 AND user_id IS NOT NULL AND event_type IS NOT NULL").select(trigger_id(F.col("user_id"), F.col("event_type")).alias("trigger_id"), target.alias("target"), "ts")
    for _ in range(2):
        jobs.drain(e, f"{at}/done", f"{at}/checkpoint", jobs.each(work, "target"), ts="ts", keep="60 days").awaitTermination()
    return t.spark.read.parquet(f"{at}/done").select("trigger_id", "status", "findings")


@query("budget_stream", "SELECT CAST(day AS TIMESTAMP) AS day, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS spent FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY 1")
def budget_stream(t):
    """Spend per day, the open day too: the stream updates a store."""
    at = f"{shared_dir(t.spark)}/budget-{uuid.uuid4().hex}"
    store.latest_stream(jobs.spend_by_day(_events(t), "value"), ["day"], f"{at}/store", f"{at}/checkpoint", buckets=16).awaitTermination()
    return store.read(t.spark, f"{at}/store").select(F.col("day").cast("timestamp_ntz").alias("day"), F.col("spent").cast("double").alias("spent"))


@query("rate_stream", "SELECT user_id, CAST(w AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT user_id, unnest(list_transform(range(0, 6), lambda k: time_bucket(INTERVAL 600 SECOND, ts) - to_seconds(k * 600))) AS w FROM events) GROUP BY 1, 2")
def rate_stream(t):
    """Events per user in hour-long windows that slide by ten minutes."""
    at = f"{shared_dir(t.spark)}/rate-{uuid.uuid4().hex}"
    r = jobs.rate_stream(_events(t), "user_id", 3600)
    store.latest_stream(r, ["user_id", "window"], f"{at}/store", f"{at}/checkpoint", buckets=16).awaitTermination()
    return store.read(t.spark, f"{at}/store").select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


@query("findings_stream", "SELECT event_id AS fingerprint, user_id AS target, event_type AS status FROM events")
def findings_stream(t):
    """Upserts of a stream into a bucketed store; what is read back holds every finding."""
    at = f"{shared_dir(t.spark)}/findings-{uuid.uuid4().hex}"
    e = _events(t).select(F.col("event_id").alias("fingerprint"), F.col("user_id").alias("target"), F.col("event_type").alias("status"), F.lit("LOW").alias("severity"), F.col("value").cast("decimal(18,6)").alias("paid"), F.col("ts").alias("seen"))
    store.upsert_stream(e, at + "/store", at + "/checkpoint", upsert_store, buckets=16).awaitTermination()
    return store.read(t.spark, at + "/store").select("fingerprint", "target", "status")
