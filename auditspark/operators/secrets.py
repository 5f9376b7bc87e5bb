"""Secrets of known shapes in texts: which rule, what, on which line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions.text import finding_id, redact

# Kinds and shapes of keys that must be found alike; the last is the
# general shape of an assigned token.
KEY_SHAPES = (
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("alchemy_rpc", r"https://[a-zA-Z0-9._-]*alchemy[a-zA-Z0-9._-]*/v2/[A-Za-z0-9_-]{20,}"),
    ("infura_rpc", r"https://[a-zA-Z0-9._-]*infura[a-zA-Z0-9._-]*/v3/[A-Za-z0-9_-]{20,}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("openai_key", r"sk-[A-Za-z0-9]{20,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}"),
    ("generic_token", r"(?:token|secret|password)\s*[=:]\s*.?[A-Za-z0-9]{16,}"),
)

_HOST = "[a-zA-Z0-9._-]"


def linear(shape: str) -> str:
    """The same shape for an engine that backtracks: a host with a word inside, which
    has two runs of one class, is tested for the word and then read once."""
    for word in ("alchemy", "infura"):
        shape = shape.replace(f"{_HOST}*{word}{_HOST}*", f"(?={_HOST}*{word}){_HOST}*+")
    return shape


def secret_scan(rows: DataFrame, key: str, text: str, shapes=KEY_SHAPES) -> DataFrame:
    """``key``, kind, value, line of every match.  A null text has none.

    A rule that does not occur costs one pass; lines are made only of texts in
    which a rule occurs, and a match does not cross them (as in all these shapes
    but a broken generic one).
    """
    shapes = [(kind, linear(shape)) for kind, shape in shapes]
    whole = F.coalesce(F.col(text), F.lit(""))
    some = F.lit(False)
    for _, shape in shapes:
        some = some | whole.rlike(shape)
    lines = rows.where(some).select(F.col(key), F.posexplode(F.split(whole, "\n")).alias("at", "content"))

    def of(kind: str, shape: str):
        return F.transform(F.regexp_extract_all("content", F.lit(shape), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[of(kind, shape) for kind, shape in shapes])
    out = lines.select(key, (F.col("at") + 1).alias("line"), F.explode(found).alias("x"))
    return out.select(key, "x.kind", "x.value", "line")


def secret_findings(found: DataFrame, key: str) -> DataFrame:
    """Once per kind and value: finding_id, kind, shown (redacted), first ``key``, how many have it."""
    ident = finding_id(F.col("kind"), F.col("value")).alias("finding_id")
    return found.groupBy(ident, "kind").agg(F.min(key).alias(f"first_{key}"), F.count_distinct(key).alias("seen_in"), redact(F.min("value")).alias("shown"))


def as_findings(found: DataFrame, key: str) -> DataFrame:
    """Findings of secret hits: one severity, category and confidence, and a short description without the value."""
    text = F.concat(F.col("kind"), F.lit(" on line "), F.col("line").cast("string"))
    return found.select(key, F.lit("CRITICAL").alias("severity"), F.lit("secret-leak").alias("category"), F.lit(0.85).alias("confidence"), F.left(text, F.lit(120)).alias("description"), "line")
