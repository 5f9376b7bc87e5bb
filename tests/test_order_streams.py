"""Values along an order, streams whose state ends, and differences of builds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditspark.operators.order import with_previous, with_sum_before
from auditspark.streaming import jobs, store


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _keyed(seed=3, n=600):
    """Distinct places; one key holds most rows, one is null, some values are null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in rng.sample(range(10 * n), n)]


def test_previous_and_sum_before(many_parts):
    rows = _keyed()
    df = many_parts.createDataFrame(rows, "k string, at long, v int")
    want_previous, want_sum, last, total = {}, {}, {}, defaultdict(int)
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want_previous[at], want_sum[at] = last.get(k), total[k]
        last[k], total[k] = v, total[k] + (v or 0)
    out = with_previous(df, ["k"], "at", "v")
    assert out.columns == ["k", "at", "v", "previous"]
    assert {r["at"]: r["previous"] for r in out.collect()} == want_previous
    assert {r["at"]: r["before"] for r in with_sum_before(df, ["k"], "at", "v").collect()} == want_sum
    assert with_previous(df.limit(0), ["k"], "at", "v").count() == 0 and with_sum_before(df.limit(0), ["k"], "at", "v").count() == 0


def test_a_hot_key_is_dealt_over_parts(many_parts, tmp_path):
    df = many_parts.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), (F.col("id") % 3).alias("v"))
    assert with_previous(df, ["k"], "at", "v", into=str(tmp_path / "r")).where("at > 0 AND previous <> (at - 1) % 3").count() == 0
    sizes = [r["count"] for r in many_parts.read.parquet(str(tmp_path / "r")).groupBy("_at_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_upgrades_of_many_batches(many_parts, tmp_path):
    """Against a loop: repeats, late places, null values, a hot key, a run without new rows."""
    rng, at = random.Random(5), str(tmp_path)
    last, want = {}, []
    for number in range(4):
        batch = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), number * 40 + rng.randrange(60), rng.choice(["x", "y", None])) for _ in range(80)]
        many_parts.createDataFrame(batch, "k string, n long, v string").coalesce(1).write.mode("append").parquet(f"{at}/in")
        seen = {}
        for k, n, v in batch:
            if v is not None and (k not in last or n > last[k][0]):
                seen[k, n] = min(v, seen.get((k, n), v))
        for (k, n), v in sorted(seen.items(), key=lambda r: r[0][1]):
            if k in last and last[k][1] != v:
                want.append((k, n, last[k][1], v))
            last[k] = (n, v)
        for _ in range(2):
            stream = many_parts.readStream.schema("k string, n long, v string").parquet(f"{at}/in")
            jobs.upgrade_stream(stream, "k", "v", "n", f"{at}/out", f"{at}/checkpoint", buckets=4).awaitTermination()
    got = [tuple(r) for r in many_parts.read.parquet(f"{at}/out/changes").select("k", "n", "old", "new").collect()]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 40
    assert not list((tmp_path / "out" / "ranges").iterdir())


def _days(spark, at, days, per_day=20):
    """One file a batch: events of one day each."""
    for d in days:
        df = spark.range(per_day).select((F.col("id") % 4).alias("user"), (F.timestamp_seconds(F.lit(d * 86400) + F.col("id") * 60)).alias("ts"), F.concat(F.lit(f"{d}-"), F.col("id") % 5).alias("trigger_id"), F.lit(1.5).alias("value"))
        df.coalesce(1).write.mode("append").parquet(f"{at}/in")
        yield d, spark.readStream.schema(df.schema).parquet(f"{at}/in")


def _state(query):
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_windows_leave_the_state_and_stay_in_the_store(spark, tmp_path):
    at, states = str(tmp_path), []
    for _, stream in _days(spark, at, range(1, 8)):
        states.append(_state(store.latest_stream(jobs.spend_by_day(stream, "value"), ["day"], f"{at}/store", f"{at}/checkpoint", buckets=4)))
    assert max(states) <= 2
    got = {r["day"].day: float(r["spent"]) for r in store.read(spark, f"{at}/store").collect()}
    assert got == dict.fromkeys(range(2, 9), 30.0)  # the epoch is day 0, 1970-01-01


def test_late_rows_go_aside(spark, tmp_path):
    at = str(tmp_path)
    for _, stream in _days(spark, at, [3, 5, 4, 5, 1]):
        end = F.window("ts", "1 day")["end"]
        jobs.late_rows(stream, end, f"{at}/aside", f"{at}/c1").awaitTermination()
        store.latest_stream(jobs.spend_by_day(stream, "value"), ["day"], f"{at}/store", f"{at}/c2", buckets=4).awaitTermination()
    late = {r["day"]: r["count"] for r in spark.read.parquet(f"{at}/aside/late").groupBy(F.dayofmonth("ts").alias("day")).count().collect()}
    spent = {r["day"].day: float(r["spent"]) for r in store.read(spark, f"{at}/store").collect()}
    # Day 4 (the 5th) closes an hour after its end; the greatest time is 19 minutes into day 5 (the 6th), so it is still open.
    assert late == {2: 20} and spent == {4: 30.0, 5: 30.0, 6: 60.0}


def test_drained_keys_leave_the_state(spark, tmp_path):
    at, states = str(tmp_path), []
    for d, stream in _days(spark, at, [1, 2, 3, 4, 5, 6, 6]):
        states.append(_state(jobs.drain(stream, f"{at}/done", f"{at}/checkpoint", lambda df: df.select("trigger_id"), ts="ts", keep="1 day")))
    assert max(states) <= 15
    done = [r["trigger_id"] for r in spark.read.parquet(f"{at}/done").collect()]
    assert sorted(done) == sorted(f"{d}-{i}" for d in range(1, 7) for i in range(5))


def test_route_diff_of_builds(spark):
    from auditspark.operators.web import route_diff

    rng = random.Random(9)
    rows = [(h, b, f"/r{rng.randrange(12)}") for h in ("x", "y", "z") for b in rng.sample(range(20), 6) for _ in range(rng.randrange(1, 9))]
    rows += [("y", 30, None), ("y", 31, "/back"), (None, 1, "/n"), ("x", None, "/n"), *rows[:5]]
    builds = defaultdict(lambda: defaultdict(set))
    for h, b, r in rows:
        if h is not None and b is not None:
            builds[h][b] |= {r} - {None}
    want = {}
    for h, of in builds.items():
        order = sorted(of)
        for b, n in zip(order, order[1:]):
            if of[b] != of[n]:
                want[h, n] = (sorted(of[n] - of[b]), sorted(of[b] - of[n]))
    got = {(r["host"], r["build"]): (r["added"], r["removed"]) for r in route_diff(spark.createDataFrame(rows, "host string, build int, route string")).collect()}
    assert got == want and ("y", 30) in got


def test_recent_events_rank_before_the_shuffle(spark):
    """Each task keeps its newest rows of a type, so that a type's task gets few."""
    from auditspark.plans.registry import QUERIES

    plan = QUERIES["recent_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
