"""Scalar column functions: identities, redaction, normalisation, places in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
BYTECODE_MARKERS = ("a264697066735822", "a265627a7a72315820")
STOPWORDS = frozenset("this that with from have when then than they them there here into only also such will would could should must been being were which while where what your their other each some does".split())


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_rank(severity: Column) -> Column:
    return F.coalesce(_map({s: i for i, s in enumerate(SEVERITIES)})[F.upper(severity)], F.lit(0))


def sarif_level(severity: Column) -> Column:
    return F.coalesce(_map(SARIF_LEVELS)[F.upper(severity)], F.lit("note"))


def collapse_ws(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0b\\f\\r]+", " "))


def sha_left(value: Column, n: int) -> Column:
    return F.left(F.sha2(value, 256), F.lit(n))


def fingerprint(target: Column, file: Column, function: Column, category: Column, line_hint: Column, description: Column) -> Column:
    """Identity of a finding: same place, kind and wording."""
    seed = sha_left(F.lower(collapse_ws(description)), 12)
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (target, file, function, category, line_hint)]
    return sha_left(F.concat_ws("\0", *parts, seed), 32)


def fingerprint_fallback(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_hash24(text: Column) -> Column:
    return sha_left(F.coalesce(text, F.lit("")), 24)


def finding_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), sha_left(F.coalesce(value, F.lit("")), 16))


def trigger_id(*parts: Column) -> Column:
    return sha_left(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 16)


def config_fingerprint(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def authz_fingerprint(program: Column, researcher: Column, source: Column, assets: Column) -> Column:
    """Of an authorisation: who may test what, and where that is written."""
    return sha_left(F.to_json(F.struct(program.alias("program"), researcher.alias("researcher"), source.alias("source"), assets.alias("assets"))), 16)


def redact(value: Column) -> Column:
    """Keep the ends of long values, hide short ones."""
    return F.when(F.length(value) <= 12, F.lit("***")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(4))))


def strip_comments(text: Column) -> Column:
    """Block comments become one space, line comments go.  It knows no strings; see
    ``source.clean_code`` for code of a known language."""
    whole = F.coalesce(text, F.lit(""))
    # Up to the last end of a comment every beginning has an end, so no text is read twice.
    closed = F.regexp_extract(whole, "(?s)^(.*\\*/)", 1)
    rest = F.substring(whole, F.length(closed) + 1, F.length(whole))
    return F.regexp_replace(F.concat(F.regexp_replace(closed, "(?s)/\\*.*?\\*/", " "), rest), "//[^\\n]*", "")


def tokenize(text: Column, most: int = 24) -> Column:
    """Distinct lower-case words of four letters or more, in order, without stopwords."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_][a-z0-9_]{3,}"), F.lit(0)))
    return F.slice(F.array_except(words, F.array(*[F.lit(w) for w in sorted(STOPWORDS)])), 1, most)


def topic_to_address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.right(topic, F.lit(40)))


def strip_metadata(bytecode: Column) -> Column:
    """Code before the last metadata marker; the first marker kind that occurs counts."""
    code = F.lower(F.regexp_replace(F.coalesce(bytecode, F.lit("")), "^0[xX]", ""))
    out = code
    for m in reversed(BYTECODE_MARKERS):
        out = F.when(F.contains(code, F.lit(m)), F.regexp_replace(code, f"(?s)^(.*){m}.*$", "$1")).otherwise(out)
    return out


def hostname_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def registered_domain(host: Column) -> Column:
    """Last two labels of a host."""
    labels = F.split(host, "\\.")
    return F.when(F.size(labels) <= 2, host).otherwise(F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; None if not http."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(u, "^([a-zA-Z]+)://", 1)), F.regexp_extract(u, "^[a-zA-Z]+://[^/?]*(.*)$", 1)
    authority = F.lower(F.regexp_extract(u, "^[a-zA-Z]+://([^/?]*)", 1))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), authority, rest))


def line_of(text: Column, offset: Column) -> Column:
    """Line number of a 0-based offset."""
    return F.regexp_count(F.left(text, offset), F.lit("\\n")) + 1


def start_line(hint: Column) -> Column:
    """First number of a hint like `L12-20`."""
    return F.nullif(F.regexp_extract(F.coalesce(hint, F.lit("")), "([0-9]{1,9})", 1), F.lit("")).cast("int")


def normalise_severity(text: Column) -> Column:
    """First severity word of a text, upper case; None if there is none."""
    word = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)(?:^|[^A-Za-z])(critical|high|medium|moderate|low|informational|info)(?:[^A-Za-z]|$)", 1))
    return F.when(word == "", None).when(word == "moderate", F.lit("MEDIUM")).when(word.isin("informational", "info"), F.lit("INFO")).otherwise(F.upper(word))


def normalise_id(text: Column) -> Column:
    """`h-1` -> `H-01`; None if the text has no id."""
    kind = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), "(?:^|[^A-Za-z0-9])([CHMLIchmli])-?([0-9]{1,3})(?:[^A-Za-z0-9]|$)", 1))
    number = F.regexp_extract(F.coalesce(text, F.lit("")), "(?:^|[^A-Za-z0-9])([CHMLIchmli])-?([0-9]{1,3})(?:[^A-Za-z0-9]|$)", 2)
    return F.when(kind != "", F.concat(kind, F.lit("-"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))


def first_date(text: Column) -> Column:
    """First ISO date in the first 4000 characters."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.left(F.coalesce(text, F.lit("")), F.lit(4000)), "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")


def location(file: Column, line: Column) -> Column:
    return F.when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))
