"""The driver tables as generic audit entities, in Spark and in SQL.

A document is a file, its source the target; orders are findings with a
lifecycle; events are a ledger or a timeline; customers are a watchlist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators.rules import TEXT_RULES, scan_documents


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text of every line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "content")).select("doc_id", (F.col("pos") + 1).alias("line"), "content")


LINES_SQL = "(SELECT doc_id, i AS line, ls[i] AS content FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"


def hits(docs: DataFrame) -> DataFrame:
    """Rule hits on documents: rule, category, severity, confidence, engine."""
    return scan_documents(docs, TEXT_RULES)


def _hits_sql() -> str:
    parts = []
    for r in TEXT_RULES:
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, source AS target, lang AS language, '{r.rule_id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, CAST({r.confidence} AS DOUBLE) AS confidence, '{r.engine}' AS engine FROM documents WHERE regexp_matches(coalesce(text, ''), '{p}')")
    return "(" + " UNION ALL ".join(parts) + ")"


HITS_SQL = _hits_sql()

#: Labels as (unit, category): low quality and toxic documents.
LABELS_SQL = "(SELECT doc_id, 'low-quality' AS category FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' AS category FROM labels WHERE toxic = 1)"
UNITS_SQL = "(SELECT doc_id, lang AS language FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


def unit_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 0, "low-quality"), F.when(F.col("toxic") == 1, "toxic")))).alias("category"))


def units(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").alias("language")).join(labels.select("doc_id"), "doc_id", "left_semi")


def findings_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as findings: key, target, status, severity, paid amount, seen."""
    digit = F.substring("o_orderpriority", 1, 1)
    severity = F.when(digit == "1", "CRITICAL").when(digit == "2", "HIGH").when(digit == "3", "MEDIUM").when(digit == "4", "LOW").otherwise("INFO")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "new").otherwise("submitted")
    return orders.select(
        F.col("o_orderkey").alias("fingerprint"), F.col("o_custkey").alias("target"), status.alias("status"), severity.alias("severity"), F.col("o_totalprice").cast("decimal(18,6)").alias("paid"), F.col("o_orderdate").alias("seen")
    )


FINDINGS_SQL = """(SELECT o_orderkey AS fingerprint, o_custkey AS target, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'new' ELSE 'submitted' END AS status,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'INFO' END AS severity,
  CAST(o_totalprice AS DECIMAL(18,6)) AS paid, o_orderdate AS seen FROM orders)"""

RANK_SQL = "CASE {0} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
