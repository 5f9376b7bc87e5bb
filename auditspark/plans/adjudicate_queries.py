"""Adjudication: document labels as votes, orders as verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditspark.operators import adjudicate as ad
from auditspark.plans.base import query
from auditspark.plans.bindings import FINDINGS_SQL, HITS_SQL, RANK_SQL, findings_from_orders, hits

_VOTES = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'uphold' WHEN quality = 0 THEN 'downgrade' ELSE 'overturn' END AS verdict FROM labels)"


def _votes(t):
    return t.labels.select("doc_id", F.when(F.col("toxic") == 1, "uphold").when(F.col("quality") == 0, "downgrade").otherwise("overturn").alias("verdict"))


@query(
    "ensemble_apply",
    f"""SELECT doc_id, rule_id, CASE WHEN verdict = 'overturn' THEN 'REJECTED' ELSE 'POTENTIAL' END AS status, round(CASE verdict WHEN 'uphold' THEN least(0.99, confidence + 0.05) WHEN 'downgrade' THEN greatest(0.05, confidence * 0.65) WHEN 'overturn' THEN 0.05 ELSE confidence END, 4) AS adjusted
    FROM {HITS_SQL} LEFT JOIN {_VOTES} USING (doc_id)""",
)
def ensemble_apply(t):
    return ad.ensemble_apply(hits(t.documents), _votes(t), "doc_id").select("doc_id", "rule_id", "status", "adjusted")


@query("parse_vote", "SELECT event_id, CASE WHEN k % 4 = 0 THEN 'keep' WHEN k % 4 = 1 THEN 'reject' END AS verdict, CASE WHEN k % 4 = 3 THEN 0.0 ELSE least(k / 50.0, 1.0) END AS confidence FROM (SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def parse_vote(t):
    """Votes out of judges' answers: prose around an object, odd decisions, no object."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    said = F.when(k % 4 == 0, "Keep ").when(k % 4 == 1, "REJECT").otherwise("perhaps")
    vote = F.concat(F.lit('I think {so}: {"decision": "'), said, F.lit('", "confidence": '), (k / 50.0).cast("string"), F.lit("} because"))
    return t.events.select("event_id", ad.parse_vote(F.when(k % 4 == 3, "no object at all").otherwise(vote)).alias("v")).select("event_id", "v.verdict", "v.confidence")


@query(
    "validate_judge",
    """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'decision' WHEN user_id % 10 = 0 THEN 'reason' WHEN NOT (value / 50 BETWEEN 0 AND 1) THEN 'confidence' WHEN value / 50 >= 0.9 AND event_id % 3 = 0 THEN 'evidence' END AS problem FROM events""",
)
def validate_judge(t):
    votes = t.events.select(
        "event_id", F.when(F.col("event_type") == "click", "keep").when(F.col("event_type") == "view", "reject").otherwise("maybe").alias("decision"), F.when(F.col("user_id") % 10 == 0, " ").otherwise("seen").alias("reason"), (F.col("value") / 50).alias("confidence"), (F.col("event_id") % 3).alias("cited")
    )
    return ad.validate_judge(votes).select("event_id", "problem")


@query(
    "panel_decide",
    """SELECT doc_id, CASE WHEN a = 'keep' THEN 'keep' WHEN a = 'reject' AND b = 'reject' THEN 'reject' WHEN a = 'reject' AND b = 'keep' THEN CASE WHEN m THEN 'keep' WHEN NOT m THEN 'reject' ELSE 'escalate' END WHEN a = 'reject' THEN 'escalate' WHEN b = 'keep' THEN 'keep' WHEN b = 'reject' THEN 'escalate' ELSE 'keep' END AS decision
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 0 THEN 'keep' ELSE 'reject' END AS b, CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS m FROM labels)""",
)
def panel_decide(t):
    v = t.labels.select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, None).when(F.col("quality") == 1, "keep").otherwise("reject").alias("a"),
        F.when(F.col("doc_id") % 5 == 0, None).when(F.col("toxic") == 0, "keep").otherwise("reject").alias("b"),
        F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False).alias("m"),
    )
    return v.select("doc_id", ad.panel_decide(F.col("a"), F.col("b"), F.col("m")).alias("decision"))


@query("stage_counts", "SELECT CASE WHEN quality = 1 THEN 'kept' WHEN toxic = 1 THEN 'dropped' ELSE 'escalated' END AS decision, count(*) AS n FROM labels GROUP BY 1")
def stage_counts(t):
    return t.labels.groupBy(F.when(F.col("quality") == 1, "kept").when(F.col("toxic") == 1, "dropped").otherwise("escalated").alias("decision")).agg(F.count("*").alias("n"))


@query(
    "machine_tier",
    f"""SELECT doc_id, rule_id, CASE WHEN r THEN 'CONFIRMED' WHEN NOT r THEN 'REJECTED' ELSE 'POTENTIAL' END AS status, CASE WHEN r THEN greatest(0.9, confidence) WHEN NOT r THEN 0.05 ELSE confidence END AS adjusted
    FROM {HITS_SQL} LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN TRUE WHEN quality = 0 THEN FALSE END AS r FROM labels) USING (doc_id)""",
)
def machine_tier(t):
    r = t.labels.select("doc_id", F.when(F.col("toxic") == 1, True).when(F.col("quality") == 0, False).alias("reproduced"))
    return ad.machine_tier(hits(t.documents), r, "doc_id").select("doc_id", "rule_id", "status", "adjusted")


@query(
    "claim_adjudication",
    f"""SELECT h.doc_id, rule_id, CASE WHEN r THEN 'CONFIRMED' WHEN v.verdict = 'overturn' THEN 'REJECTED' ELSE 'POTENTIAL' END AS final FROM {HITS_SQL} h LEFT JOIN {_VOTES} v ON v.doc_id = h.doc_id LEFT JOIN (SELECT doc_id, toxic = 1 AS r FROM labels WHERE toxic = 1) m ON m.doc_id = h.doc_id""",
)
def claim_adjudication(t):
    """Findings with votes and machine results; the machine wins."""
    f = ad.ensemble_apply(hits(t.documents), _votes(t), "doc_id").withColumnRenamed("status", "voted").drop("adjusted", "verdict")
    m = ad.machine_tier(f, t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("reproduced")), "doc_id")
    return m.select("doc_id", "rule_id", F.when(F.col("status") == "CONFIRMED", "CONFIRMED").otherwise(F.col("voted")).alias("final"))


@query("llm_budget_gate", f"SELECT doc_id, rule_id FROM {HITS_SQL} WHERE confidence < 0.8 ORDER BY {RANK_SQL.format('severity')} DESC, doc_id, rule_id LIMIT 100")
def llm_budget_gate(t):
    """The first N unsettled findings go to review."""
    from auditspark.functions.text import severity_rank

    return hits(t.documents).where("confidence < 0.8").orderBy(severity_rank(F.col("severity")).desc(), "doc_id", "rule_id").limit(100).select("doc_id", "rule_id")


@query("triage_scores", f"SELECT h.doc_id, h.rule_id, least(greatest(coalesce(l.quality + l.toxic * 2, confidence), 0.0), 1.0) AS score FROM {HITS_SQL} h LEFT JOIN labels l USING (doc_id)")
def triage_scores(t):
    s = t.labels.select("doc_id", (F.col("quality") + F.col("toxic") * 2).cast("double").alias("given"))
    return hits(t.documents).join(s, "doc_id", "left").select("doc_id", "rule_id", F.least(F.greatest(F.coalesce("given", "confidence"), F.lit(0.0)), F.lit(1.0)).alias("score"))


@query(
    "apply_memory",
    f"""SELECT doc_id, rule_id, CASE verdict WHEN 'confirmed' THEN 'CONFIRMED' WHEN 'rejected' THEN 'REJECTED' ELSE 'POTENTIAL' END AS status, 'memory: ' || verdict AS note
    FROM {HITS_SQL} LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'confirmed' ELSE 'rejected' END AS verdict FROM labels) USING (doc_id)""",
)
def apply_memory(t):
    m = t.labels.select("doc_id", F.when(F.col("quality") == 0, "confirmed").otherwise("rejected").alias("verdict"))
    return ad.apply_memory(hits(t.documents), m, "doc_id").select("doc_id", "rule_id", "status", "note")


@query("annotate_reachability", f"SELECT doc_id, rule_id, CASE WHEN toxic = 1 THEN 'reachable' WHEN quality = 0 THEN 'not_reachable' ELSE 'unknown' END AS reachability, CASE WHEN quality = 0 AND toxic = 0 THEN 'REJECTED' ELSE 'POTENTIAL' END AS status FROM {HITS_SQL} LEFT JOIN labels USING (doc_id)")
def annotate_reachability(t):
    """Unknown reachability keeps a finding (fails open)."""
    r = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "reachable").when(F.col("quality") == 0, "not_reachable").alias("r"))
    h = hits(t.documents).join(r, "doc_id", "left")
    return h.select("doc_id", "rule_id", F.coalesce("r", F.lit("unknown")).alias("reachability"), F.when(F.col("r") == "not_reachable", "REJECTED").otherwise("POTENTIAL").alias("status"))


@query("target_profile", f"SELECT severity AS category, status AS verdict, count(*) AS n FROM {FINDINGS_SQL} GROUP BY GROUPING SETS ((severity), (status))")
def target_profile(t):
    f = findings_from_orders(t.orders).select(F.col("severity").alias("category"), F.col("status").alias("verdict"))
    return f.groupingSets([[F.col("category")], [F.col("verdict")]], F.col("category"), F.col("verdict")).agg(F.count("*").alias("n"))


@query("confirmed_categories", f"SELECT severity AS category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, severity) AS place FROM {FINDINGS_SQL} WHERE status = 'paid' GROUP BY 1")
def confirmed_categories(t):
    g = findings_from_orders(t.orders).where("status = 'paid'").groupBy(F.col("severity").alias("category")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))  # five categories


@query("learn_verdicts", f"SELECT fingerprint, CASE status WHEN 'paid' THEN 'confirmed' WHEN 'submitted' THEN 'overturned' ELSE 'rejected' END AS verdict FROM {FINDINGS_SQL} WHERE status <> 'new' OR severity = 'INFO'")
def learn_verdicts(t):
    f = findings_from_orders(t.orders).where("status <> 'new' OR severity = 'INFO'")
    return f.select("fingerprint", F.when(F.col("status") == "paid", "confirmed").when(F.col("status") == "submitted", "overturned").otherwise("rejected").alias("verdict"))
