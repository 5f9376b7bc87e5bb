"""Operator 9: secret scan over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: an OR of
ANDs of trigrams that every match must hold.  The index keeps the postings of
the rule set's trigrams; postings are intersected per query, and only the
candidates are verified by the expression.  A rule without a mandatory trigram
scans every text.  All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import small, table, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``group`` must have at least ``least`` characters;
    matches that fail are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules are given; the others are shapes of published key formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # The runs of 24 or more are the long ones among the runs of one or more.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),  # a class, not a repeated group: that would recurse once per word
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("openai", r"sk-[A-Za-z0-9]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("alchemy", r"alchemy\.com/v2/[A-Za-z0-9_-]{20,}"),
    Rule("infura", r"infura\.io/v3/[0-9a-f]{32}"),
)

#: More alternatives of an expression than this are not derived; such a rule scans every text.
_MAX_ALTERNATIVES = 1024
#: Matches whose places are summed in one array.
_BLOCK = 128


_ANY = [["", ""]]  # text that need not hold anything: it ends the run before it
_CLASS = re.compile(r"\[(\^?)((?:\\.|[^\]\\])*)\]")
_TIMES = re.compile(r"(?:([*+?])|\{(\d+)(?:(,)(\d*))?\})[+?]?")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|(.))")


def _join(left: list, right: list) -> list | None:
    if len(left) * len(right) > _MAX_ALTERNATIVES:
        return None
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]


def _atom(pattern: str, at: int) -> tuple[list | None, int]:
    """Alternatives of the atom at ``at`` and where it ends."""
    if pattern[at] == "(":
        inside = re.compile(r"\((?:\?[a-z]*:)?").match(pattern, at).end()
        found, at = _branches(pattern, inside)
        return found, at + 1
    if m := _CLASS.match(pattern, at):
        members = [chr(int(h, 16)) if h else c or x for h, c, x in re.findall(r"\\(?:x([0-9a-fA-F]{2})|(.))|(.)", m[2])]
        plain = not m[1] and len(members) <= 6 and not re.search(r"\\[dwsDWS]|[^\\]-.", m[2])
        return [[c.lower()] for c in members] if plain else _ANY, m.end()
    if m := _ESCAPE.match(pattern, at):
        return [[chr(int(m[1], 16)).lower() if m[1] else m[2].lower()]] if m[1] or not m[2].isalnum() else _ANY, m.end()
    return ([[pattern[at].lower()]] if pattern[at] not in ".^$" else _ANY), at + 1


def _branches(pattern: str, at: int = 0) -> tuple[list | None, int]:
    """Alternatives of the expression from ``at`` to its end or closing bracket:
    lists of literal runs that stand in every match in this order.  The last run
    of a list may go on.  None when there are too many."""
    found, one = [], [[""]]
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            found, one, at = (found + one if None not in (found, one) else None), [[""]], at + 1
            continue
        options, at = _atom(pattern, at)
        if m := _TIMES.match(pattern, at):
            at = m.end()
            least = {"*": 0, "?": 0, "+": 1}.get(m[1]) if m[1] else int(m[2])
            exact, once = m[2] is not None and not m[3], m[1] == "?"
            if once and options is not None and all(len(x) == 1 for x in options):
                options = [[""], *options]
            elif least and options is not None and len(options) == 1 and len(options[0]) == 1 and len(options[0][0]) == 1:
                options = [[options[0][0] * least] + ([] if exact else [""])]
            else:
                options = _ANY
        one = _join(one, options) if None not in (one, options) else None
    return (found + one if None not in (found, one) else None), at


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams, or None if a match need not hold any."""
    alternatives, _ = _branches(pattern)
    if alternatives is None:
        return None
    clauses = {frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in alternatives}
    if not all(clauses):
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index restricted to ``trigrams``: trigram number, doc_id."""
    low = docs.where("text is not null and doc_id is not null").select("doc_id", F.lower("text").alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(F.explode(present).alias("trigram"), "doc_id").distinct()


def rule_trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in rules for c in trigram_query(r.pattern) or () for t in c})


def candidates(docs: DataFrame, rules=RULES, index: DataFrame | None = None) -> DataFrame:
    """doc_id and a bit mask of the rules whose trigram query its text satisfies.

    ``index`` is a stored result of ``postings`` over ``rule_trigrams``, by which
    further runs over the same documents need not read their texts for this.
    """
    spark = docs.sparkSession
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = rule_trigrams(rules)
    number = {t: i for i, t in enumerate(trigrams)}
    clauses = [(rule, k, number[t], len(c)) for rule, q in queries.items() for k, c in enumerate(q) for t in sorted(c)]
    wanted = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, clauses)) + " AS t(rule, clause, trigram, need)")
    hits = (postings(docs, trigrams) if index is None else index).join(F.broadcast(wanted), "trigram")  # the rule set's clauses: a fixed list
    whole = hits.groupBy("doc_id", "rule", "clause", "need").agg(F.count("*").alias("n")).where("n = need")
    return whole.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the rule's matches, in code points.

    Matches and the gaps between them come from one expression, so their lengths
    add up to the places.  The sums run within blocks and then over blocks, as
    appending to one array would copy it for every match.
    """
    pattern = F.lit(rule.pattern)
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else match
    pieces = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(match)).alias("gap"), match.alias("hit"), value.alias("value"))
    none = F.expr(f"cast(array() as {_SPANS})")

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    def block(xs, i):
        return F.aggregate(F.slice(xs, i * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shifted(at, spans):
        return F.transform(spans, lambda x: F.struct((x["start"] + at).alias("start"), x["ord"].alias("ord"), (x["end"] + at).alias("end"), x["kind"].alias("kind")))

    def chained(blocks):
        first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPANS}>)").alias("out"))
        return F.aggregate(blocks, first, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.array_append(s["out"], shifted(s["at"], b["out"])).alias("out")), lambda s: F.flatten(s["out"]))

    placed = _let(pieces, lambda xs: chained(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda i: block(xs, i))))
    return F.when(text.rlike(rule.pattern), placed).otherwise(none)


def find_secrets(docs: DataFrame, rules=RULES, index: DataFrame | None = None) -> DataFrame:
    """doc_id and ``found``: array of (start, ord, end, kind), sorted by start and
    then by the order of the rules, which also settles ties.

    Null counts as the empty text, which holds nothing; an empty table gives an
    empty result.  Texts of any length are read whole: no expression nests a
    repetition, so time grows in proportion to the text.  Rows without a doc_id
    are verified by every rule.  Rows that repeat a doc_id each get a row; they
    share its candidates, which are a superset for each.  Other columns of
    ``docs`` are not used, so their names cannot clash.
    """
    found = written(candidates(docs, rules, index), "secret-candidates")
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(found, 24), "doc_id", "left")
    everything = (1 << len(rules)) - 1
    mask = F.when(F.col("doc_id").isNull(), F.lit(everything)).otherwise(F.coalesce("rules", F.lit(0)))
    spans = []
    for i, rule in enumerate(rules):
        own = _spans(F.col("text"), rule, i)
        if trigram_query(rule.pattern) is not None:
            own = F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, own).otherwise(F.expr(f"cast(array() as {_SPANS})"))
        spans.append(own)
    return marked.select("doc_id", F.array_sort(F.flatten(F.array(*spans))).alias("found"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    counts = [of_kind(k).alias(f"n_{k}") for k in base]
    own = F.filter("found", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The same spans, found by DuckDB over all texts without an index."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g, {r.least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
each_hit AS (SELECT rid, ord, kind, m, v, g, least, unnest(range(1, len(m) + 1)) AS i FROM hits),
placed AS (SELECT rid, ord, kind, length(m[i]) AS n, length(v[i]) >= least AS good,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM each_hit),
spans AS (SELECT rid, ord, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR) AS span FROM placed WHERE good),
agg AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (rid)
"""


OP9_SQL = _oracle()
