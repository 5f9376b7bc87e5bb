"""History queries: events as versions of findings, documents as two snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditspark.operators import history as hi
from auditspark.operators.planning import global_rank
from auditspark.plans.base import query
from auditspark.plans.bindings import LINES_SQL, lines

_ROWS = """(SELECT user_id AS finding, CAST(CAST(ts AS DATE) AS VARCHAR) AS version, bool_or(event_type = 'error') AS in_place, bool_or(event_type = 'purchase' AND value > 100) AS elsewhere, bool_or(event_type = 'click') AS touched FROM events GROUP BY 1, 2)"""
_TIMELINE = f"""(SELECT finding, version, last_value(v IGNORE NULLS) OVER (PARTITION BY finding ORDER BY version ROWS UNBOUNDED PRECEDING) AS verdict FROM (SELECT finding, version,
  CASE WHEN p IS NULL THEN 'STILL OPEN' WHEN in_place AND p AND touched THEN 'BAND-AID' WHEN in_place AND p THEN 'STILL OPEN' WHEN in_place THEN 'REGRESSED' WHEN elsewhere AND p THEN 'BAND-AID' WHEN p THEN 'FIXED'
  WHEN elsewhere AND NOT pe THEN 'REGRESSED' WHEN elsewhere THEN 'BAND-AID' WHEN pe THEN 'FIXED' END AS v
  FROM (SELECT *, lag(in_place) OVER w AS p, lag(elsewhere) OVER w AS pe FROM {_ROWS} WINDOW w AS (PARTITION BY finding ORDER BY version))))"""


def _timeline(t):
    rows = t.events.groupBy(F.col("user_id").alias("finding"), F.to_date("ts").cast("string").alias("version")).agg(
        F.bool_or(F.col("event_type") == "error").alias("in_place"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("elsewhere"), F.bool_or(F.col("event_type") == "click").alias("touched")
    )
    return hi.verdict_timeline(rows)


@query("verdict_timeline", f"SELECT * FROM {_TIMELINE}")
def verdict_timeline(t):
    return _timeline(t)


@query("verdict_pivot", f"SELECT version, count_if(verdict = 'FIXED') AS fixed, count_if(verdict = 'BAND-AID') AS band_aid, count_if(verdict = 'STILL OPEN') AS still_open, count_if(verdict = 'REGRESSED') AS regressed FROM {_TIMELINE} GROUP BY 1")
def verdict_pivot(t):
    return hi.verdict_pivot(_timeline(t))


@query("latest_summary", f"SELECT verdict, count(*) AS n FROM (SELECT finding, arg_max(verdict, version) AS verdict FROM {_TIMELINE} GROUP BY 1) GROUP BY 1")
def latest_summary(t):
    return _timeline(t).groupBy("finding").agg(F.max_by("verdict", "version").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


_QUEUED = "(SELECT finding, 'BAND-AID' AS reason FROM (SELECT DISTINCT user_id AS finding FROM events) WHERE finding % 3 = 0)"


@query(
    "redive_sync",
    f"""SELECT * FROM (SELECT DISTINCT finding, verdict AS reason FROM {_TIMELINE} WHERE verdict IN ('BAND-AID', 'REGRESSED') UNION ALL SELECT finding, v FROM (SELECT finding, arg_max(verdict, version) AS v FROM {_TIMELINE} GROUP BY 1) WHERE v = 'STILL OPEN' AND finding % 2 = 0) r
    WHERE NOT EXISTS (SELECT 1 FROM {_QUEUED} q WHERE q.finding = r.finding AND q.reason = r.reason)""",
)
def redive_sync(t):
    ids = t.events.select(F.col("user_id").alias("finding")).distinct()
    severity = ids.withColumn("severity", F.when(F.col("finding") % 2 == 0, "HIGH").otherwise("LOW"))
    queued = ids.where("finding % 3 = 0").withColumn("reason", F.lit("BAND-AID"))
    return hi.redive_sync(_timeline(t), severity, queued)


@query("redive_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def redive_status(t):
    """Claims and resolutions are events; the newest is the state."""
    return hi.current_status(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("unresolved", "SELECT user_id, status FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1) WHERE status NOT IN ('purchase', 'error')")
def unresolved(t):
    return hi.current_status(t.events, "user_id", ["ts", "event_id"], "event_type").where(~F.col("status").isin("purchase", "error"))


@query("stale_claims", "WITH m AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) FILTER (event_type = 'click') AS claimed FROM events GROUP BY 1) SELECT user_id, claimed FROM c, m WHERE status = 'click' AND claimed < now - INTERVAL 2 DAY")
def stale_claims(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0])
    return hi.stale_claims(t.events, "user_id", "ts", "event_type", now, 2)


@query("version_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def version_order(t):
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("version"))


@query("since_version", "SELECT event_id FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN rn END) OVER (PARTITION BY user_id) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) WHERE rn > coalesce(cut, 0)")
def since_version(t):
    """Versions after the last one tagged."""
    w = Window.partitionBy("user_id")
    r = t.events.withColumn("rn", F.row_number().over(w.orderBy("ts", "event_id")))
    r = r.withColumn("cut", F.max(F.when(F.col("event_type") == "signup", F.col("rn"))).over(w))
    return r.where(F.col("rn") > F.coalesce("cut", F.lit(0))).select("event_id")


@query("version_key", "SELECT tag, row_number() OVER (ORDER BY a, b, tag) AS place FROM (SELECT DISTINCT 'v' || CAST(user_id % 12 AS VARCHAR) || '.' || CAST(event_id % 25 AS VARCHAR) AS tag, user_id % 12 AS a, event_id % 25 AS b FROM events)")
def version_key(t):
    """Natural order: v2 before v10."""
    tags = t.events.select(F.concat(F.lit("v"), (F.col("user_id") % 12).cast("string"), F.lit("."), (F.col("event_id") % 25).cast("string")).alias("tag")).distinct()
    return global_rank(tags, [hi.version_key(F.col("tag")).asc(), F.asc("tag")], "place").select("tag", (F.col("place") + 1).alias("place"))


@query("impl_change", "SELECT event_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events WHERE event_type IN ('click', 'view')) WHERE old IS NOT NULL AND old <> event_type")
def impl_change(t):
    """Implementation switches per proxy; the first sighting is silent."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.where(F.col("event_type").isin("click", "view")).withColumn("old", F.lag("event_type").over(w))
    return e.where("old IS NOT NULL AND old <> event_type").select("event_id", "old", F.col("event_type").alias("new"))


_BEFORE = "(SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 'x' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 7 <> 0)"


@query("diff_functions", f"SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN b.h <> n.h THEN 'changed' ELSE 'same' END AS change FROM {_BEFORE} b FULL JOIN (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 1) n ON b.doc_id = n.doc_id")
def diff_functions(t):
    d = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    before = d.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 2, F.lit("x")).otherwise(F.col("h")))
    return hi.full_diff(before, d.where("doc_id % 7 <> 1"), ["doc_id"], "h")


@query("touched_functions", f"SELECT doc_id FROM documents WHERE doc_id % 7 IN (0, 1, 2)")
def touched_functions(t):
    return diff_functions(t).where("change <> 'same'").select("doc_id")


@query(
    "file_changes",
    """WITH d AS (SELECT doc_id, left(sha256(CAST(doc_id AS VARCHAR)), 24) AS h FROM documents), b AS (SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 9 = 4 THEN 'old' ELSE h END AS hash FROM d WHERE doc_id % 9 <> 0), n AS (SELECT CASE WHEN doc_id % 9 = 5 THEN 'g' ELSE 'f' END || CAST(doc_id AS VARCHAR) AS path, h AS hash FROM d WHERE doc_id % 9 <> 1)
    SELECT n.path, CASE WHEN b.path IS NULL AND r.path IS NOT NULL THEN 'renamed' WHEN b.path IS NULL THEN 'added' WHEN b.hash <> n.hash THEN 'modified' ELSE 'same' END AS change, CASE WHEN b.path IS NULL THEN r.path END AS "from" FROM n LEFT JOIN b ON b.path = n.path LEFT JOIN (SELECT * FROM b WHERE path NOT IN (SELECT path FROM n)) r ON r.hash = n.hash
    UNION ALL SELECT path, 'deleted', NULL FROM b WHERE path NOT IN (SELECT path FROM n) AND hash NOT IN (SELECT hash FROM n WHERE path NOT IN (SELECT path FROM b))""",
)
def file_changes(t):
    d = t.documents.select("doc_id", F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(24)).alias("hash"))
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    before = d.where("doc_id % 9 <> 0").select(name("f").alias("path"), F.when(F.col("doc_id") % 9 == 4, "old").otherwise(F.col("hash")).alias("hash"))
    now = d.where("doc_id % 9 <> 1").select(F.when(F.col("doc_id") % 9 == 5, name("g")).otherwise(name("f")).alias("path"), "hash")
    return hi.file_changes(before, now)


_WORDS = "(SELECT source AS fn, doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents)"


@query("change_multiset", f"SELECT fn, w, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change, abs(d) AS times FROM (SELECT fn, w, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS d FROM {_WORDS} GROUP BY 1, 2) WHERE d <> 0")
def change_multiset(t):
    """Words of even documents against those of odd ones, per source."""
    w = t.documents.select(F.col("source").alias("fn"), "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    return hi.change_multiset(w.where("doc_id % 2 = 1"), w.where("doc_id % 2 = 0"), ["fn"], "w")


@query("chunk_greedy")
def chunk_greedy(t):
    """Lines packed in order into chunks of 1000 characters (a fold; tested by brute force)."""
    parts = lines(t.documents).select("doc_id", "line", F.length("content").alias("n"))
    return hi.chunk_greedy(parts, "doc_id", "line", "n", 1000)


@query("suggest_adjacent", "SELECT DISTINCT user_id AS finding, user_id + d AS neighbour FROM events, (VALUES (-1), (1)) AS v(d) WHERE event_type = 'error' AND value > 40 AND user_id + d IN (SELECT DISTINCT user_id FROM events)")
def suggest_adjacent(t):
    """Neighbours of the units that serious findings touch."""
    ids = t.events.select("user_id").distinct()
    serious = t.events.where("event_type = 'error' AND value > 40").select("user_id").distinct()
    edges = ids.select("user_id", F.explode(F.array(F.col("user_id") - 1, F.col("user_id") + 1)).alias("neighbour"))
    known = ids.select(F.col("user_id").alias("neighbour"))
    return serious.join(edges, "user_id").join(known, "neighbour", "left_semi").select(F.col("user_id").alias("finding"), "neighbour")
