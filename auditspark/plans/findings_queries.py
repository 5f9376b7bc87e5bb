"""Findings lifecycle over orders and over rule hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions.text import sarif_level, severity_rank
from auditspark.operators import findings as fd
from auditspark.operators.rules import found_rules
from auditspark.operators.secrets import KEY_SHAPES, as_findings, secret_scan
from auditspark.plans.base import query
from auditspark.plans.bindings import FINDINGS_SQL, HITS_SQL, RANK_SQL, findings_from_orders, hits
from auditspark.sources import feeds

_RANK = RANK_SQL.format("severity")


@query("findings_summary", f"SELECT status, severity, count(*) AS n, CAST(sum(paid) AS DOUBLE) AS paid FROM {FINDINGS_SQL} GROUP BY GROUPING SETS ((), (status), (severity))")
def findings_summary(t):
    return fd.summary(findings_from_orders(t.orders))


@query("filter_findings", f"SELECT fingerprint, target, status, severity FROM {FINDINGS_SQL} WHERE status = 'new' AND severity = 'HIGH' AND CAST(target AS VARCHAR) LIKE '%1%'")
def filter_findings(t):
    return fd.filter_findings(findings_from_orders(t.orders), "new", "%1%", "HIGH").select("fingerprint", "target", "status", "severity")


@query(
    "write_findings",
    f"""WITH f AS (SELECT * FROM {FINDINGS_SQL}), s AS (SELECT * FROM f WHERE fingerprint % 3 <> 0), b AS (SELECT fingerprint, target, 'new' AS status, severity, CAST(0 AS DECIMAL(18,6)) AS paid, seen + INTERVAL 30 DAY AS seen FROM f WHERE fingerprint % 2 = 0)
    SELECT coalesce(s.fingerprint, b.fingerprint) AS fingerprint, coalesce(b.target, s.target) AS target, coalesce(s.status, b.status) AS status, coalesce(b.severity, s.severity) AS severity,
    CAST(coalesce(nullif(b.paid, 0), s.paid, b.paid) AS DOUBLE) AS paid, coalesce(s.seen, b.seen) AS first_seen, coalesce(b.seen, s.seen) AS last_seen FROM s FULL JOIN b USING (fingerprint)""",
)
def write_findings(t):
    """Upsert of a second batch: first sighting, status and payment stay."""
    f = findings_from_orders(t.orders)
    batch = f.where("fingerprint % 2 = 0").select("fingerprint", "target", F.lit("new").alias("status"), "severity", F.lit(0).cast("decimal(18,6)").alias("paid"), (F.col("seen") + F.expr("INTERVAL 30 DAYS")).alias("seen"))
    return fd.upsert(f.where("fingerprint % 3 <> 0"), batch).withColumn("paid", F.col("paid").cast("double"))


@query("resolve_prefix", "WITH k AS (SELECT sha256(coalesce(text, '')) AS key FROM documents), p AS (SELECT DISTINCT left(sha256(coalesce(text, '')), 3) AS prefix FROM documents WHERE doc_id % 5 = 0 UNION SELECT 'zzz'), n AS (SELECT left(key, 3) AS p, count(*) AS n, min(key) AS key FROM k GROUP BY 1) SELECT prefix, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS state, CASE WHEN n = 1 THEN key END AS key FROM p LEFT JOIN n ON prefix = p")
def resolve_prefix(t):
    d = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    asked = d.where("doc_id % 5 = 0").select(F.left("key", F.lit(3)).alias("prefix")).unionByName(t.spark.sql("SELECT 'zzz' AS prefix")).distinct()
    return fd.resolve_prefix(asked, d, 3)


@query("status_history", "SELECT user_id, event_id, old_status, event_type AS new_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events) WHERE old_status IS DISTINCT FROM event_type")
def status_history(t):
    return fd.status_changes(t.events, "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "old_status", F.col("event_type").alias("new_status"))


@query("dedupe_first", f"SELECT doc_id, category, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY CASE engine WHEN 'static' THEN 0 WHEN 'gitleaks' THEN 1 ELSE 2 END, rule_id) AS n FROM {HITS_SQL}) WHERE n = 1")
def dedupe_first(t):
    return fd.dedupe_first_in_rows(found_rules(t.documents), lambda e: F.when(e == "static", 0).when(e == "gitleaks", 1).otherwise(2)).select("doc_id", "category", "rule_id")


@query(
    "consensus",
    f"""WITH g AS (SELECT doc_id, category, array_to_string(list_sort(list(DISTINCT engine)), ',') AS sources, count(DISTINCT engine) AS n FROM {HITS_SQL} GROUP BY 1, 2)
    SELECT h.doc_id, h.rule_id, sources, n >= 2 AS corroborated, round(CASE WHEN n >= 2 THEN least(0.99, confidence + 0.15) WHEN engine = 'heuristic' AND confidence < 0.55 THEN greatest(0.05, confidence - 0.05) ELSE confidence END, 4) AS adjusted FROM {HITS_SQL} h JOIN g ON h.doc_id = g.doc_id AND h.category = g.category""",
)
def consensus(t):
    return fd.consensus_in_rows(found_rules(t.documents)).select("doc_id", "rule_id", F.array_join("sources", ",").alias("sources"), "corroborated", "adjusted")


_ORDER = f"{_RANK} DESC, confidence DESC, doc_id, rule_id"


@query("rank_findings", f"SELECT doc_id, rule_id, severity, confidence, row_number() OVER (ORDER BY {_ORDER}) AS place FROM {HITS_SQL} ORDER BY place LIMIT 500")
def rank_findings(t):
    """The first 500 by severity, confidence and a unique tie-break."""
    from pyspark.sql import Window

    order = [severity_rank(F.col("severity")).desc(), F.desc("confidence"), F.asc("doc_id"), F.asc("rule_id")]
    first = fd.top(hits(t.documents), order, 500)  # places are numbered after the limit, over 500 rows
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("doc_id", "rule_id", "severity", "confidence", "place")


@query("digest_topn", f"SELECT doc_id, rule_id, severity FROM {HITS_SQL} ORDER BY {_RANK} DESC, doc_id, rule_id LIMIT 25")
def digest_topn(t):
    return fd.top(hits(t.documents), [severity_rank(F.col("severity")).desc(), F.asc("doc_id"), F.asc("rule_id")], 25).select("doc_id", "rule_id", "severity")


@query("review_queue", f"SELECT doc_id, rule_id, severity, confidence FROM {HITS_SQL} WHERE {_RANK} >= 1 AND confidence < 0.85 ORDER BY {_RANK} DESC, confidence, doc_id, rule_id LIMIT 64")
def review_queue(t):
    """Not yet sure, severe enough; the least sure first within a severity."""
    h = fd.severity_at_least(hits(t.documents), "LOW").where("confidence < 0.85")
    return fd.top(h, [severity_rank(F.col("severity")).desc(), F.asc("confidence"), F.asc("doc_id"), F.asc("rule_id")], 64).select("doc_id", "rule_id", "severity", "confidence")


@query("recent_findings", f"SELECT fingerprint, seen FROM {FINDINGS_SQL} ORDER BY seen DESC, fingerprint LIMIT 1000")
def recent_findings(t):
    return fd.top(findings_from_orders(t.orders), [F.desc("seen"), F.asc("fingerprint")], 1000).select("fingerprint", "seen")


@query("recent_events", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 50")
def recent_events(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return t.events.withColumn("n", n).where("n <= 50").select("event_type", "event_id")


@query("severity_counts", f"SELECT severity, {_RANK} AS severity_rank, count(*) AS n FROM {HITS_SQL} GROUP BY 1, 2")
def severity_counts(t):
    return hits(t.documents).groupBy("severity").agg(F.count("*").alias("n")).select("severity", severity_rank(F.col("severity")).alias("severity_rank"), "n")


@query("feed_counts", f"SELECT count(DISTINCT target) AS targets, count(*) AS findings, count_if(confidence >= 0.8) AS confirmed FROM {HITS_SQL}")
def feed_counts(t):
    return hits(t.documents).agg(F.countDistinct("target").alias("targets"), F.count("*").alias("findings"), F.count_if(F.col("confidence") >= 0.8).alias("confirmed"))


@query("write_raw_feed", f"SELECT target, doc_id, rule_id, severity, CASE WHEN confidence >= 0.8 THEN 'manual-verification' ELSE 'internal-review' END AS route, right(d.text, 2000) AS log_tail FROM {HITS_SQL} h JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) d USING (doc_id)")
def write_raw_feed(t):
    """The rows of the raw feed; `feeds.raw_feed_json` turns them to records."""
    h = hits(t.documents).join(t.documents.select("doc_id", F.right(F.coalesce("text", F.lit("")), F.lit(2000)).alias("log_tail")), "doc_id")
    return h.select("target", "doc_id", "rule_id", "severity", feeds.route(F.col("confidence")).alias("route"), "log_tail")


_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END"


@query("write_sarif_rows", f"SELECT target, rule_id, {_LEVEL} AS level, count(*) AS results, min(doc_id) AS first_doc FROM {HITS_SQL} GROUP BY 1, 2, 3")
def write_sarif_rows(t):
    h = hits(t.documents).withColumn("level", sarif_level(F.col("severity")))
    return h.groupBy("target", "rule_id", "level").agg(F.count("*").alias("results"), F.min("doc_id").alias("first_doc"))


@query(
    "normalize_gitleaks",
    """SELECT doc_id, 'CRITICAL' AS severity, 'secret-leak' AS category, CAST(0.85 AS DOUBLE) AS confidence, 'generic_token on line ' || CAST(i AS VARCHAR) AS description FROM
    (SELECT doc_id, i, unnest(regexp_extract_all(ls[i], '(?:token|secret|password)\\s*[=:]\\s*.?[A-Za-z0-9]{16,}')) FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))""",
)
def normalize_gitleaks(t):
    """Hits of the token rule as findings."""
    found = secret_scan(t.documents, "doc_id", "text", tuple(x for x in KEY_SHAPES if x[0] == "generic_token"))
    return as_findings(found, "doc_id").select("doc_id", "severity", "category", "confidence", "description")


@query("merge_targets", "SELECT DISTINCT source AS target FROM documents WHERE source NOT LIKE 'src1%' UNION SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 0")
def merge_targets(t):
    """Union of target lists; commented lines are skipped."""
    a = t.documents.where("source NOT LIKE 'src1%'").select(F.col("source").alias("target"))
    return a.union(t.documents.where("doc_id % 7 = 0").select("source")).distinct()


@query("resume_targets", "SELECT source, CAST((row_number() OVER (ORDER BY source) - 1) // 5 AS INT) AS chunk FROM (SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 97 = 0)")
def resume_targets(t):
    """Targets not yet done, in chunks of five."""
    from auditspark.operators.web import resume_targets as resume

    d = t.documents
    return resume(d.select("source").distinct(), d.where("doc_id % 97 = 0").select("source"), "source", 5)


@query("dependency_rollup", f"SELECT DISTINCT p.source AS parent, h.target AS dependency, h.rule_id FROM (SELECT DISTINCT source, 'src' || CAST(doc_id % 20 AS VARCHAR) AS dep FROM documents WHERE doc_id % 11 = 0) p JOIN {HITS_SQL} h ON h.target = p.dep WHERE p.source <> h.target")
def dependency_rollup(t):
    """Findings of a dependency under its parent, itself excluded."""
    deps = t.documents.where("doc_id % 11 = 0").select(F.col("source").alias("parent"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("dependency")).distinct()
    found = hits(t.documents).select(F.col("target").alias("dependency"), "rule_id").distinct()
    return deps.join(found, "dependency").where("parent <> dependency").select("parent", "dependency", "rule_id").distinct()


@query("keep_fraction", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= n - CAST(floor(n * 0.4) AS BIGINT)")
def keep_fraction(t):
    """The top share of a plan under a tight budget (0.6)."""
    from auditspark.operators.planning import keep_fraction as keep

    return keep(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 0.6).select("doc_id")


@query("file_queue", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200")
def file_queue(t):
    return fd.top(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 200)


@query(
    "adaptive_plan",
    f"""WITH b AS (SELECT doc_id, n_chars / 1000.0 + CASE WHEN doc_id IN (SELECT doc_id FROM {HITS_SQL}) THEN 2.5 ELSE 0 END AS risk FROM documents WHERE doc_id % 3 <> 0)
    SELECT doc_id, risk FROM (SELECT *, row_number() OVER (ORDER BY risk DESC, doc_id) AS rn, count(*) OVER () AS n FROM b) WHERE rn <= n - CAST(floor(n * 0.75) AS BIGINT)""",
)
def adaptive_plan(t):
    """Risk with a boost for files with past findings; only changed files; budget cut."""
    from auditspark.operators.planning import adaptive_plan as plan

    d = t.documents.select("doc_id", (F.col("n_chars") / 1000.0).alias("risk"))
    return plan(d, hits(t.documents).select("doc_id").distinct(), t.documents.where("doc_id % 3 <> 0").select("doc_id"), "doc_id", 0.25).select("doc_id", "risk")
