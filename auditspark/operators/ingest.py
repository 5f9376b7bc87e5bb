"""Audit reports as findings: sections, severity, ids, files, functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.functions.text import normalise_id, normalise_severity

# Wordings of headings, hedges, file and function names, auditors and dates in reports.
_HEADING = "^#{1,4}\\s+\\S|^\\[?[HMCLIhmcli]\\s*-?\\s*[0-9]{1,3}\\]?[\\s:.-]+\\S|^[Ff]inding\\s+[0-9]+[\\s:.-]+\\S"
_HEDGED = "(?i)may be at risk|may be vulnerable|could be vulnerable|could be at risk|might be vulnerable|might be exploitable|potential vulnerability|potentially vulnerable|at risk of"
_FILE = "((?:contracts?|src|lib|tests?)/[A-Za-z0-9_./-]*[.](?:sol|vy|cairo|move|clar|func|rs|ts))"
_FUNCTION = "(?:function\\s+|`|[A-Z][A-Za-z0-9_]*[.])([A-Za-z_][A-Za-z0-9_]*)\\s*\\("
_ANY_FILE = "`([A-Za-z0-9_./-]+[.](?:sol|vy|cairo|move|clar|func|rs|ts))`"
_NOISE = ("if", "for", "while", "require", "revert", "return", "emit")
_AUDITOR = "(?im)^(?:auditor|audit[ \\t]+firm|audited[ \\t]+by|prepared[ \\t]+by)[ \\t]*[:\u2013\u2014-][ \\t]*(.+)$"
_AUDITED = "(?i)\\baudit(?:ed)?[ \\t]+by[ \\t]+((?-i:[A-Z])[A-Za-z0-9 .&'-]{2,60})"
_DATED = "(?im)^(?:date|report[ \\t]+date|published)[ \\t]*[:\u2013\u2014-][ \\t]*(.+)$"
_ISO = "\\b(20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})\\b"
REPORT_SUFFIXES = (".md", ".markdown", ".txt")
#: Auditor, date and title stand at the beginning of a report.
_FRONT = 4000


def read_audit_reports(spark: SparkSession, root: str, suffixes: tuple[str, ...] = REPORT_SUFFIXES) -> DataFrame:
    """``report`` (path), ``text`` of the report files below ``root``; other files are not read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.btrim(F.regexp_extract(text, pattern, 1), F.lit(" \t\r")), F.lit(""))


def report_facts(reports: DataFrame) -> DataFrame:
    """``report``, ``title``, ``auditor``, ``date``: what the beginning of a report says of it.

    The title is the first heading among the first ten lines, else the file's name in words;
    a date is what a line says that names one, else the first that is written by numbers.
    Null where a report does not tell; a null text tells nothing.
    """
    text = F.coalesce("text", F.lit(""))
    front = F.left(text, F.lit(_FRONT))
    heading = F.get(F.filter(F.transform(F.slice(F.split(text, "\r?\n"), 1, 10), lambda x: F.regexp_extract(F.btrim(x), "^#\\s+(.+?)\\s*$", 1)), lambda x: x != ""), F.lit(0))
    stem = F.regexp_replace(F.regexp_extract(F.col("report").cast("string"), "([^/]*?)(?:[.][A-Za-z0-9]+)?$", 1), "[_-]+", " ")
    auditor = F.rtrim(F.coalesce(_first(front, _AUDITOR), _first(front, _AUDITED)), F.lit("."))
    return reports.select("report", F.coalesce(heading, F.initcap(F.btrim(stem))).alias("title"), auditor.alias("auditor"), F.coalesce(_first(front, _DATED), _first(front, _ISO)).alias("date"))


def audit_ingest(reports: DataFrame) -> DataFrame:
    """report, id, title, severity, description, files, functions, confidence.

    Reports are rows (report, text).  A section counts if it has a severity or
    an id, or hedged wording and names code.  Sections without an id are
    numbered within their report.
    """
    lines = reports.select("report", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r?\\n")).alias("n", "line"))
    w = Window.partitionBy("report").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("heading", F.col("line").rlike(_HEADING)).withColumn("section", F.sum(F.col("heading").cast("int")).over(w)).where("section > 0")
    # A section is bounded by its report, which is one row.
    parts = marked.groupBy("report", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    s = parts.select("report", "section", F.regexp_replace(F.get("ls.line", F.lit(0)), "^#+\\s*", "").alias("heading"), F.array_join(F.slice(F.col("ls.line"), 2, 1_000_000), "\n").alias("body"))
    head = F.concat_ws("\n", "heading", F.left("body", F.lit(800)))
    s = s.withColumn("severity", normalise_severity(head)).withColumn("id", F.coalesce(normalise_id(F.col("heading")), normalise_id(F.left("body", F.lit(200)))))
    text = F.concat_ws("\n", "heading", "body")
    s = s.withColumn("files", F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (_FILE, _ANY_FILE)]))).withColumn("functions", F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(_FUNCTION), F.lit(1))), F.array(*[F.lit(x) for x in _NOISE])))
    code = (F.size("files") > 0) | (F.size("functions") > 0)
    hedged = F.col("severity").isNull() & F.col("id").isNull() & head.rlike(_HEDGED) & code
    s = s.withColumn("hedged", hedged).where(F.col("severity").isNotNull() | F.col("id").isNotNull() | F.col("hedged"))
    sure = F.lit(0.5) + F.when(F.col("id").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("severity").isNotNull(), 0.15).otherwise(0.0) + F.when(code, 0.1).otherwise(0.0)
    auto = F.row_number().over(Window.partitionBy("report", F.col("id").isNull()).orderBy("section"))
    title = F.btrim(F.regexp_replace(F.regexp_replace("heading", "^\\[?[HMCLIhmcli]\\s*-?\\s*[0-9]{1,3}\\]?\\s*[:-]?\\s*", ""), "(?i)\\(\\s*(critical|high|medium|low|info|informational)\\s*\\)\\s*$", ""))
    paragraphs = F.filter(F.transform(F.split("body", "\\n\\s*\\n"), lambda p: F.btrim(p, F.lit(" \n\t"))), lambda p: (p != "") & ~p.rlike("^(#|[|]|-|[*] |1[.] )"))
    return s.select(
        "report",
        F.coalesce("id", F.concat(F.lit("FINDING-"), F.lpad(auto.cast("string"), 2, "0"))).alias("id"),
        title.alias("title"),
        F.when(F.col("hedged"), "LOW").otherwise(F.coalesce("severity", F.lit("UNKNOWN"))).alias("severity"),
        F.array_join(F.slice(paragraphs, 1, 3), "\n\n").alias("description"),
        "files",
        "functions",
        F.round(F.when(F.col("hedged"), F.least(sure, F.lit(0.3))).otherwise(F.least(sure, F.lit(0.95))), 2).alias("confidence"),
    )
