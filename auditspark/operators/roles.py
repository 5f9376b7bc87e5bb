"""Who may do what: functions whose name holds a power, and whether they are guarded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions.code import extract_functions
from auditspark.functions.text import strip_comments
from auditspark.operators.code_rules import _POWERS, Facts, facts

# Words that name a role or a switch, in the order they are listed.
ROLE_WORDS = ("owner", "admin", "controller", "guardian", "governor", "manager", "operator", "fee", "paused", "whitelist")


def role_map(files: DataFrame) -> DataFrame:
    """doc_id, function, line, guarded, roles, reason of the functions (doc_id, text,
    lang) whose first word is a power, in files that name a role.  A null text has
    none; rows that repeat a doc_id count on their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Bound once: a text that is made by an expression would be made for every word.
    listed = lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(w)) & x.rlike(rf"\b{w}\b"), F.lit(w)) for w in ROLE_WORDS]))
    present = F.element_at(F.transform(F.array(F.lower(text)), listed), 1)
    named = files.select("doc_id", "lang", text.alias("text"), present.alias("roles")).where(F.size("roles") > 0)
    functions = extract_functions(named.select("doc_id", strip_comments(F.col("text")).alias("text"), "lang"))
    own = facts(F.col("body"), F.concat_ws(" ", "signature", "body"))
    f = functions.where(F.col("name").rlike(f"^(?:{'|'.join(_POWERS)})(?![a-z])")).select("doc_id", "name", "first_line", F.col("signature").alias("head"), own["tests"].alias("tests"))
    guarded = Facts({"head": F.col("head"), "tests": F.col("tests")}).guarded
    reason = F.concat(F.lit("name of a power "), F.when(guarded, "with").otherwise("without"), F.lit(" a guard"))
    roles = named.groupBy("doc_id").agg(F.first("roles").alias("roles"))
    return f.select("doc_id", F.col("name").alias("function"), F.col("first_line").alias("line"), guarded.alias("guarded"), reason.alias("reason")).join(roles, "doc_id")
