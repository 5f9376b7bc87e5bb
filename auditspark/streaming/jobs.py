"""Structured Streaming jobs over event tables.

Sources are folders that new files arrive in.  The checkpoint of a query is its
cursor: a restart goes on where it stopped and replays nothing.  Times are cast
to TIMESTAMP; late rows are those behind a watermark of one hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators.order import with_previous
from auditspark.shared import make_folder, remove_folder
from auditspark.streaming import store

LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, schema: str, ts: str = "ts", pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def deployment_stream(events: DataFrame, watchlist: DataFrame, key: str, created: Column) -> DataFrame:
    """Events of watched keys that create something: a stream-static join."""
    return events.where(created).join(watchlist.select(key).distinct(), key, "left_semi")


def trigger_queue(events: DataFrame, trigger: str = "trigger_id", ts: str = "ts", keep: str = LATE) -> DataFrame:
    """One row per trigger while its state is kept."""
    return events.withWatermark(ts, keep).dropDuplicatesWithinWatermark([trigger])


def changes(sightings: DataFrame, last: DataFrame | None, into: str | None = None) -> DataFrame:
    """Sightings (k, at, v) whose value is not that of the key's sighting before, with
    ``old``.  ``last`` holds the sighting known of each key; what is not after it is old
    news.  A key may have any number of sightings: see ``operators.order``."""
    if last is not None:
        known = last.select(F.col("k").alias("_k"), F.col("at").alias("_at"))
        new = sightings.join(known, F.col("k").eqNullSafe(F.col("_k")), "left").where("_at IS NULL OR at > _at")
        sightings = new.select("k", "at", "v", F.lit(False).alias("known")).unionByName(last.select("k", "at", "v", F.lit(True).alias("known")))
    else:
        sightings = sightings.withColumn("known", F.lit(False))
    found = with_previous(sightings, ["k"], "at", "v", "old", into)
    return found.where("NOT known AND old <> v").select("k", "at", "old", "v")


def upgrade_stream(events: DataFrame, key: str, value: str, order: str, at: str, checkpoint: str, buckets: int = store.BUCKETS):
    """A row (key, order, old, new) in ``at/changes`` when a key's value changes; the
    first sighting is silent.

    The last sighting of each key is a row of a bucketed store, so no executor holds
    state, and a batch reads the buckets of its keys only.  Rows of one batch are taken
    in their order, of equal places the smallest value; rows at or before a place known
    of their key, and those without value or place, are no sightings.
    """
    spark = events.sparkSession

    def newest(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
        both = rows if stored is None else stored.select("k", "at", "v").unionByName(rows)
        return both.groupBy("k").agg(F.max("at").alias("at"), F.max_by("v", "at").alias("v"))

    def batch(df: DataFrame, number: int) -> None:
        rows = df.select(F.col(key).alias("k"), F.col(order).alias("at"), F.col(value).alias("v")).where("at IS NOT NULL AND v IS NOT NULL")
        rows = rows.groupBy("k", "at").agg(F.min("v").alias("v")).persist()
        ranges = f"{at}/ranges/batch={number}"
        found = changes(rows, store.met(rows, number, f"{at}/last", "k", buckets), ranges)
        found.select(F.col("k").alias(key), F.col("at").alias(order), "old", F.col("v").alias("new")).write.mode("overwrite").parquet(f"{at}/changes/batch={number}")
        store.upsert_batch(newest(None, rows), number, f"{at}/last", newest, "k", buckets)
        rows.unpersist()
        remove_folder(spark, ranges)

    make_folder(spark, f"{at}/changes")
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(events: DataFrame, end: Column, at: str, checkpoint: str, ts: str = "ts", delay: str = LATE):
    """The rows that an aggregate with this watermark leaves out go to ``at/late``.

    ``end`` is the time at which a row's window closes.  A batch's watermark is the
    greatest time of the batches before it, less the delay, in milliseconds; each batch
    writes the greatest time known after it.  The rows are the aggregate's own as long as
    both streams meet the same arrivals in the same batches.  A row without a time is
    never late.
    """
    spark = events.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        mark = spark.read.schema("mark long").parquet(f"{at}/marks/number={number - 1}").first()["mark"] if number else None
        df = df.persist()
        limit = F.timestamp_millis(F.lit(mark).cast("long")) - F.expr(f"INTERVAL {delay}")
        df.where(end <= limit).write.mode("overwrite").parquet(f"{at}/late/batch={number}")
        df.agg(F.greatest(F.max(F.unix_millis(F.col(ts))), F.lit(mark).cast("long")).alias("mark")).write.mode("overwrite").parquet(f"{at}/marks/number={number}")
        df.unpersist()

    make_folder(spark, f"{at}/late")
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spend_by_day(events: DataFrame, cost: str, ts: str = "ts") -> DataFrame:
    """Spend per tumbling day, final once the watermark passes; in update mode with
    ``store.latest_stream``, the open days are there too."""
    return events.withWatermark(ts, LATE).groupBy(F.window(ts, "1 day")).agg(F.sum(F.col(cost).cast("decimal(18,6)")).alias("spent")).select(F.col("window.start").alias("day"), "spent")


def rate_stream(events: DataFrame, key: str, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Events per key in sliding windows."""
    slide = max(1, seconds // 6)
    return events.withWatermark(ts, LATE).groupBy(key, F.window(ts, f"{seconds} seconds", f"{slide} seconds")).count()


def drain(queue: DataFrame, done_path: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], key: str = "trigger_id", ts: str | None = None, keep: str = LATE):
    """Handle every trigger once.

    The keys met before are state of the stream, so that no batch reads what earlier
    ones wrote.  With ``ts``, the time of a sighting, a key's state ends once the
    watermark is ``keep`` past its first sighting, and a later sighting is a new trigger;
    without it, keys stay for good.  A batch whose triggers were taken but not finished
    runs again as a whole after a restart and overwrites the results of its number.
    """

    def batch(df: DataFrame, number: int) -> None:
        handle(df).write.mode("overwrite").parquet(f"{done_path}/batch={number}")

    once = trigger_queue(queue, key, ts, keep) if ts else queue.dropDuplicates([key])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each(work: Callable[[str], int], target: str, key: str = "trigger_id") -> Callable[[DataFrame], DataFrame]:
    """A handler for ``drain`` that works on one trigger's target at a time: key,
    status, findings, reason.  A trigger without a target is skipped; an error is
    the result of its own trigger and stops no other."""

    def one(at: str | None) -> tuple[str, int | None, str | None]:
        if at is None:
            return "skipped", None, "no target"
        try:
            return "completed", work(at), None
        except Exception as e:  # noqa: BLE001 - what a target breaks is recorded with it
            return "error", None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(x) for x in b.column(target).to_pylist()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], [key, "status", "findings", "reason"])

    return lambda df: df.select(key, target).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, status string, findings long, reason string")


def findings_stream(findings: DataFrame, target: str, checkpoint: str, upsert: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Upsert batches into numbered snapshots of a store; a replay rewrites the
    snapshot of its own number from the one before.  The first batch goes through
    the same upsert, with None for the store.  Each batch writes all rows; see
    ``store.upsert_stream`` for one that writes only what a batch touches."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        stored = spark.read.parquet(f"{target}/v={number - 1}") if number else None
        upsert(stored, df).write.mode("overwrite").parquet(f"{target}/v={number}")

    return findings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
