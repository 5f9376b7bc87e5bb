"""Canonical forms and report ingestion over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.operators import ingest
from auditspark.plans.base import query
from auditspark.plans.bindings import LINES_SQL, lines

_KEEP = ", ".join(f"'{k}'" for k in sorted(code.KEYWORDS | {"STR"}))
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '\"[^\"\\n]*\"|''[^''\\n]*''', ' STR ', 'g')"


@query(
    "canonicalize",
    f"""WITH p AS (SELECT doc_id, line, regexp_extract_all({_CLEAN}, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_ \\t\\n\\r]') AS ps FROM {LINES_SQL}),
    n AS (SELECT doc_id, line, ps, list_filter(list_filter(ps, lambda x: regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({_KEEP})), lambda x: TRUE) AS ws FROM p),
    d AS (SELECT doc_id, line, ps, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ns FROM n)
    SELECT doc_id, line, sha256(array_to_string(list_transform(ps, lambda x: CASE WHEN list_contains(ns, x) THEN 'ID' || CAST(list_position(ns, x) AS VARCHAR) ELSE x END), ' ')) AS digest FROM d""",
)
def canonicalize(t):
    """Rename-resistant form of every line."""
    return lines(t.documents).select("doc_id", "line", F.sha2(code.canonical(F.col("content")), 256).alias("digest"))


@query("strip_comments", "SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', '', 'g')) AS digest FROM documents")
def strip_comments(t):
    from auditspark.functions.text import strip_comments as strip

    return t.documents.select("doc_id", F.sha2(strip(F.col("text")), 256).alias("digest"))


@query(
    "audit_ingest",
    """SELECT doc_id AS report, id, CASE WHEN hit THEN upper(s) ELSE 'UNKNOWN' END AS severity, round(0.7 + CASE WHEN hit THEN 0.15 ELSE 0 END, 2) AS confidence, 'Issue in ' || lang AS title, sha256(trim(words)) AS description,
    'Review of ' || lang AS report_title, 'Firm ' || source AS auditor, '2024-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date
    FROM (SELECT doc_id, lang, source, regexp_replace(translate(coalesce(text, ''), chr(10), ' '), '(?i)critical|high|medium|moderate|low|info|note|[^a-z ]', '', 'g') AS words, 'H-' || lpad(CAST(doc_id % 90 + 1 AS VARCHAR), 2, '0') AS id, CASE doc_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE '' END AS s, doc_id % 3 < 2 AS hit FROM documents)""",
)
def audit_ingest(t):
    """Reports made of documents: title, auditor and date, and a finding's heading over
    each text's letters."""
    severity = F.when(F.col("doc_id") % 3 == 0, " (High)").when(F.col("doc_id") % 3 == 1, " (Medium)").otherwise("")
    head = F.concat(F.lit("## [H-"), (F.col("doc_id") % 90 + 1).cast("string"), F.lit("] Issue in "), F.col("lang"), severity)
    body = F.translate(F.coalesce("text", F.lit("")), "\n", " ")
    words = F.regexp_replace(body, "(?i)critical|high|medium|moderate|low|info|note|[^a-z ]", "")
    date = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    front = F.concat(F.lit("# Review of "), F.col("lang"), F.lit("\nAuditor: Firm "), F.col("source"), F.lit(".\nDate: "), date, F.lit("\n\n"))
    reports = t.documents.select(F.col("doc_id").alias("report"), F.concat(front, head, F.lit("\n"), words).alias("text"))
    facts = ingest.report_facts(reports).select("report", F.col("title").alias("report_title"), "auditor", "date")
    found = ingest.audit_ingest(reports).select("report", "id", "severity", "confidence", "title", F.sha2("description", 256).alias("description"))
    return found.join(facts, "report")


@query(
    "extract_functions",
    "SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS name, 'function' AS kind, 2 AS first_line, 3 + len(string_split(translate(coalesce(text, ''), '{}/*', ''), chr(10))) AS last_line FROM documents",
)
def extract_functions(t):
    """Function extents in files that hold each document as a function's body."""
    body = F.translate(F.coalesce("text", F.lit("")), "{}/*", "")
    file = F.concat(F.lit("// file\nfunction f"), F.col("doc_id").cast("string"), F.lit("() public {\n"), body, F.lit("\n}\n"))
    return code.extract_functions(t.documents.select("doc_id", file.alias("text"), F.lit("solidity").alias("lang"))).select("doc_id", "name", "kind", "first_line", "last_line")


@query(
    "scan_code",
    """SELECT doc_id, rule_id, severity FROM (SELECT doc_id, 'sol-unguarded-role' AS rule_id, 'HIGH' AS severity FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'sol-floating-pragma', 'LOW' FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'sol-timestamp', 'MEDIUM' FROM documents WHERE regexp_matches(coalesce(text, ''), '[0-9]'))""",
)
def scan_code(t):
    """The code catalog over contracts that hold each document in a string: a
    guard for odd ids, a loose pragma for every third, a time test where the
    text has a digit."""
    from auditspark.operators.code_rules import scan_code as scan

    i = F.col("doc_id").cast("string")
    pragma = F.when(F.col("doc_id") % 3 == 0, "pragma solidity ^0.8.0;").otherwise("pragma solidity 0.8.19;")
    guard = F.when(F.col("doc_id") % 2 == 0, "").otherwise("onlyOwner ")
    test = F.when(F.coalesce("text", F.lit("")).rlike("[0-9]"), "if (block.timestamp == x) y();").otherwise("")
    words = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z \n]", ""), "\n", " ")
    file = F.concat(pragma, F.lit("\ncontract C { address owner; string text = '"), words, F.lit("';\nfunction setFee"), i, F.lit("(uint f) public "), guard, F.lit("{ fee = f; }\nfunction g() internal { "), test, F.lit(" } }"))
    hits = scan(t.documents.select("doc_id", file.alias("text"), F.lit("solidity").alias("lang")))
    return hits.select("doc_id", "rule_id", "severity")
