"""The bucketed store of streams, and reading audit reports."""

import os

from pyspark.sql import functions as F

from auditspark.operators import ingest
from auditspark.operators.findings import upsert_store
from auditspark.streaming import store

SCHEMA = "fingerprint long, target long, status string, severity string, paid decimal(18,6), seen timestamp"


def _batch(spark, keys, status):
    return spark.createDataFrame([(k, k % 7, status, "LOW", None, None) for k in keys], SCHEMA).withColumn("seen", F.lit("2024-01-02").cast("timestamp")).withColumn("paid", F.lit(0).cast("decimal(18,6)"))


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    at = str(tmp_path / "s")
    store.upsert_batch(_batch(spark, range(20_000), "new"), 0, at, upsert_store, "fingerprint", 64)
    store.upsert_batch(_batch(spark, [5], "open"), 1, at, upsert_store, "fingerprint", 64)
    store.upsert_batch(_batch(spark, [], "x"), 2, at, upsert_store, "fingerprint", 64)
    store.upsert_batch(_batch(spark, [30_000, 5], "closed"), 3, at, upsert_store, "fingerprint", 64)
    first, second, last = (_bytes(f"{at}/data/batch={n}") for n in (0, 1, 3))
    assert second < first / 30 and last < first / 20 and not os.path.exists(f"{at}/data/batch=2")
    rows = {r["fingerprint"]: r for r in store.read(spark, at).collect()}
    whole = upsert_store(upsert_store(upsert_store(None, _batch(spark, range(20_000), "new")), _batch(spark, [5], "open")), _batch(spark, [30_000, 5], "closed"))
    assert {k: (r["status"], r["last_seen"]) for k, r in rows.items()} == {r["fingerprint"]: (r["status"], r["last_seen"]) for r in whole.collect()}
    assert len(rows) == 20_001 == store.read(spark, at).count()


def test_a_replay_and_compaction(spark, tmp_path):
    at = str(tmp_path / "s")
    for n, keys in enumerate(([1, 2, 3, 4], [2], [3], [4])):
        for _ in range(2):  # each batch runs again
            store.upsert_batch(_batch(spark, keys, f"b{n}"), n, at, upsert_store, "fingerprint", 8)
    rows = lambda number=None: {r["fingerprint"] for r in store.read(spark, at, number).collect()}
    assert rows() == {1, 2, 3, 4} and store.numbers(spark, at) == [0, 1, 2, 3]
    before = _bytes(at)
    gone = store.compact(spark, at)
    assert gone >= 1 and _bytes(at) < before and store.numbers(spark, at) == [2, 3]
    assert rows() == rows(2) == {1, 2, 3, 4}
    store.upsert_batch(_batch(spark, [9], "b3"), 3, at, upsert_store, "fingerprint", 8)  # the newest batch again, from the one before
    assert rows() == {1, 2, 3, 4, 9} and store.compact(spark, at) >= 0


def test_an_empty_store(spark, tmp_path):
    at = str(tmp_path / "s")
    assert store.read(spark, at) is None and store.numbers(spark, at) == [] and store.compact(spark, at) == 0


def test_stream_of_batches(spark, tmp_path):
    for n in range(3):
        _batch(spark, range(n, 40 + n), f"b{n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        store.upsert_stream(stream, str(tmp_path / "s"), str(tmp_path / "at"), upsert_store, buckets=4).awaitTermination()
    assert sorted(r["fingerprint"] for r in store.read(spark, str(tmp_path / "s")).collect()) == list(range(42))


def test_reports_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_first-look.md").write_text("intro\nDate: 3 March 2024\nAudited by Some Firm.\n\n## [H-01] Loss in pay (High)\n\nFirst words.\n\nSecond words about `math/Sum.sol`.\n\n- a list\n\nThird `pay(`.\n\nFourth.\n")
    (tmp_path / "deep" / "b.txt").write_text("# The vault\n\nPrepared by: Other & Co\nseen on 2023/11/05 and 2023-12-01\n\nM-2: Missing check\n\nMedium. Words.\n")
    (tmp_path / "c.pdf").write_text("# no\n\n## [H-09] x (High)\n")
    reports = ingest.read_audit_reports(spark, str(tmp_path))
    facts = {r["report"].rpartition("/")[2]: (r["title"], r["auditor"], r["date"]) for r in ingest.report_facts(reports).collect()}
    assert facts == {"a_first-look.md": ("A First Look", "Some Firm", "3 March 2024"), "b.txt": ("The vault", "Other & Co", "2023/11/05")}
    found = {(r["report"].rpartition("/")[2], r["id"]): r for r in ingest.audit_ingest(reports).collect()}
    assert found.keys() == {("a_first-look.md", "H-01"), ("b.txt", "M-02")}
    h = found["a_first-look.md", "H-01"]
    assert (h["title"], h["severity"], h["description"], h["files"], h["functions"]) == ("Loss in pay", "HIGH", "First words.\n\nSecond words about `math/Sum.sol`.\n\nThird `pay(`.", ["math/Sum.sol"], ["pay"])


def test_reports_that_tell_nothing(spark):
    rows = ingest.report_facts(spark.createDataFrame([("x/y_z.md", None), ("q.md", "")], "report string, text string")).collect()
    assert {(r["report"], r["title"], r["auditor"], r["date"]) for r in rows} == {("x/y_z.md", "Y Z", None, None), ("q.md", "Q", None, None)}
