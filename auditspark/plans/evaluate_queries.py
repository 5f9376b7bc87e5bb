"""Evaluation against the document labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.operators import evaluate as ev
from auditspark.plans.base import query
from auditspark.plans.bindings import HITS_SQL, LABELS_SQL, UNITS_SQL, hits, unit_labels, units

_H = f"(SELECT h.*, u.language AS ul FROM {HITS_SQL} h JOIN {UNITS_SQL} u USING (doc_id))"


def scores_sql(hits_sql: str) -> str:
    h = f"(SELECT h.*, u.language AS ul FROM {hits_sql} h JOIN {UNITS_SQL} u USING (doc_id))"
    return f"""SELECT language, category, tp, fp, positives, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM (
    SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN positives = 0 THEN 0.0 ELSE (positives - fn) / positives END AS r FROM (
    SELECT language, category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(fn) AS BIGINT) AS fn FROM (
      SELECT h.ul AS language, h.category, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS fp, 0 AS positives, 0 AS fn FROM {h} h LEFT JOIN {LABELS_SQL} l ON h.doc_id = l.doc_id AND h.category = l.category
      UNION ALL SELECT u.language, l.category, 0, 0, 1, CASE WHEN f.doc_id IS NULL THEN 1 ELSE 0 END FROM {LABELS_SQL} l JOIN {UNITS_SQL} u USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, category FROM {hits_sql}) f ON f.doc_id = l.doc_id AND f.category = l.category)
    GROUP BY GROUPING SETS ((), (language), (category))))"""


def _parts(t):
    return hits(t.documents), units(t.documents, t.labels), unit_labels(t.labels)


@query("bench_scores", scores_sql(HITS_SQL))
def bench_scores(t):
    return ev.bench_scores(*_parts(t))


@query(
    "bench_weighted",
    f"""WITH w AS (SELECT CAST(sum(CASE WHEN l.doc_id IS NOT NULL THEN CAST(confidence AS DECIMAL(10,4)) ELSE 0 END) AS DOUBLE) AS weighted_tp, CAST(sum(CASE WHEN l.doc_id IS NULL THEN CAST(confidence AS DECIMAL(10,4)) ELSE 0 END) AS DOUBLE) AS weighted_fp
      FROM {_H} h LEFT JOIN {LABELS_SQL} l ON h.doc_id = l.doc_id AND h.category = l.category),
    s AS (SELECT CAST(sum(coalesce(best, 0)) AS DOUBLE) AS detected, count(*) AS positives FROM {LABELS_SQL} l SEMI JOIN {UNITS_SQL} u USING (doc_id) LEFT JOIN (SELECT doc_id, category, max(CAST(confidence AS DECIMAL(10,4))) AS best FROM {HITS_SQL} GROUP BY 1, 2) b ON b.doc_id = l.doc_id AND b.category = l.category)
    SELECT weighted_tp, weighted_fp, detected, positives - detected AS weighted_fn, round(weighted_tp / (weighted_tp + weighted_fp), 4) AS weighted_precision, round(detected / positives, 4) AS weighted_recall FROM w, s""",
)
def bench_weighted(t):
    return ev.bench_weighted(*_parts(t))


@query("match_labels", f"SELECT h.doc_id, h.rule_id, h.category, l.doc_id IS NOT NULL AS tp FROM {HITS_SQL} h LEFT JOIN {LABELS_SQL} l ON h.doc_id = l.doc_id AND h.category = l.category")
def match_labels(t):
    return ev.match_labels(hits(t.documents), unit_labels(t.labels)).select("doc_id", "rule_id", "category", "tp")


@query("missed_labels", f"SELECT doc_id, category FROM {LABELS_SQL} EXCEPT SELECT doc_id, category FROM {HITS_SQL}")
def missed_labels(t):
    return ev.missed_labels(hits(t.documents), unit_labels(t.labels))


@query("clean_hits", f"SELECT doc_id, rule_id, category FROM {HITS_SQL} WHERE doc_id IN (SELECT doc_id FROM {UNITS_SQL}) AND doc_id NOT IN (SELECT doc_id FROM {LABELS_SQL})")
def clean_hits(t):
    return ev.clean_hits(*_parts(t)).select("doc_id", "rule_id", "category")


_BRIDGE = (("low-quality", "low-quality"), ("low-quality", "license"), ("toxic", "toxic"), ("toxic", "personal-data"))


@query(
    "label_map_recall",
    f"""SELECT label, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM (SELECT l.doc_id, l.category AS label, bool_or(f.doc_id IS NOT NULL) AS hit FROM {LABELS_SQL} l
    LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _BRIDGE)}) AS m(label, detector) ON m.label = l.category LEFT JOIN (SELECT DISTINCT doc_id, category FROM {HITS_SQL}) f ON f.doc_id = l.doc_id AND f.category = m.detector GROUP BY 1, 2) GROUP BY 1""",
)
def label_map_recall(t):
    bridge = t.spark.createDataFrame(_BRIDGE, "label string, detector string")
    return ev.label_map_recall(hits(t.documents), unit_labels(t.labels), bridge)


@query("label_recall", f"SELECT category AS label, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM (SELECT l.doc_id, l.category, bool_or(f.doc_id IS NOT NULL) AS hit FROM {LABELS_SQL} l LEFT JOIN {HITS_SQL} f ON f.doc_id = l.doc_id AND f.category = l.category GROUP BY 1, 2) GROUP BY 1")
def label_recall(t):
    kinds = t.spark.createDataFrame([(x, x) for x in ("low-quality", "toxic")], "label string, detector string")
    return ev.label_map_recall(hits(t.documents), unit_labels(t.labels), kinds)


@query(
    "confusion_matrix",
    "SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall FROM (SELECT count_if(toxic = 1 AND quality = 0) AS tp, count_if(toxic <> 1 AND quality = 0) AS fp, count_if(toxic = 1 AND quality <> 0) AS fn, count_if(toxic <> 1 AND quality <> 0) AS tn FROM labels)",
)
def confusion_matrix(t):
    return ev.confusion_matrix(t.labels, F.col("toxic") == 1, F.col("quality") == 0)


_STRONG = f"(SELECT * FROM {HITS_SQL} WHERE confidence >= 0.6)"


@query(
    "calibration_delta",
    f"SELECT round(f.precision - s.precision, 4) AS precision_delta, round(f.recall - s.recall, 4) AS recall_delta, s.fp - f.fp AS rejected FROM ({scores_sql(HITS_SQL)}) s, ({scores_sql(_STRONG)}) f WHERE s.language IS NULL AND s.category IS NULL AND f.language IS NULL AND f.category IS NULL",
)
def calibration_delta(t):
    """All hits against those of 0.6 or more confidence."""
    h, u, l = _parts(t)
    s, f = (ev.bench_scores(x, u, l).where("language IS NULL AND category IS NULL").select(*[F.col(c).alias(f"{n}_{c}") for c in ("precision", "recall", "fp")]) for n, x in (("s", h), ("f", h.where("confidence >= 0.6"))))
    return s.crossJoin(f).select(F.round(F.col("f_precision") - F.col("s_precision"), 4).alias("precision_delta"), F.round(F.col("f_recall") - F.col("s_recall"), 4).alias("recall_delta"), (F.col("s_fp") - F.col("f_fp")).alias("rejected"))


@query(
    "report_diff",
    f"""SELECT n.language, n.category, round(n.precision - coalesce(b.precision, 0), 4) AS precision_delta, round(n.recall - coalesce(b.recall, 0), 4) AS recall_delta, round(n.f1 - coalesce(b.f1, 0), 4) AS f1_delta,
    round(n.precision - coalesce(b.precision, 0), 4) < 0 OR round(n.recall - coalesce(b.recall, 0), 4) < 0 AS regressed FROM ({scores_sql(_STRONG)}) n LEFT JOIN ({scores_sql(HITS_SQL)}) b ON n.language IS NOT DISTINCT FROM b.language AND n.category IS NOT DISTINCT FROM b.category""",
)
def report_diff(t):
    h, u, l = _parts(t)
    return ev.report_diff(ev.bench_scores(h, u, l), ev.bench_scores(h.where("confidence >= 0.6"), u, l), ["language", "category"])


@query("new_missed", f"(SELECT doc_id, category FROM {LABELS_SQL} EXCEPT SELECT doc_id, category FROM {_STRONG}) EXCEPT (SELECT doc_id, category FROM {LABELS_SQL} EXCEPT SELECT doc_id, category FROM {HITS_SQL})")
def new_missed(t):
    h, l = hits(t.documents), unit_labels(t.labels)
    return ev.new_rows(ev.missed_labels(h.where("confidence >= 0.6"), l), ev.missed_labels(h, l), ["doc_id", "category"])


@query("rejected_fps", f"SELECT DISTINCT doc_id, rule_id FROM {HITS_SQL} h WHERE confidence < 0.6 AND NOT EXISTS (SELECT 1 FROM {LABELS_SQL} l WHERE l.doc_id = h.doc_id AND l.category = h.category)")
def rejected_fps(t):
    m = ev.match_labels(hits(t.documents), unit_labels(t.labels)).where("NOT tp")
    return ev.new_rows(m, m.where("confidence >= 0.6"), ["doc_id", "rule_id"])


@query("bench_gate", f"SELECT language, category, precision >= 0.5 AND recall >= 0.3 AND fp <= 100 AS passed FROM ({scores_sql(HITS_SQL)})")
def bench_gate(t):
    return ev.gate(ev.bench_scores(*_parts(t)), 0.5, 0.3, 100).select("language", "category", "passed")
