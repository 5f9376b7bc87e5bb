"""Tool reports, crawled files and code facts made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.functions import text as fx
from auditspark.operators import locate, reach, web
from auditspark.plans.base import query
from auditspark.plans.bindings import LINES_SQL, lines
from auditspark.sources import corpus, tool_reports

_TEXT = "coalesce(text, '')"
_WORDS = "regexp_replace(translate(coalesce(text, ''), chr(10), ' '), '[^a-z ]', '', 'g')"


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _one_of(*values: str) -> Column:
    """The value that a document's number picks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))


def _one_of_sql(*values: str) -> str:
    return f"""([{', '.join(f"'{v}'" for v in values)}])[doc_id % {len(values)} + 1]"""


def _json(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def _words() -> Column:
    """Letters and blanks of a text."""
    return F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\n", " "), "[^a-z ]", "")


def _each_line(f) -> Column:
    """``f(line, place from 0)`` of every line of a text, as an array."""
    return F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), f)


def _word(x: Column) -> Column:
    return F.regexp_extract(x, "([a-z]+)", 1)


def _by_length(x: Column, *values: str | None) -> Column:
    """The value, or null, that the length of a line picks."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.length(x) % len(values) + 1).cast("int"))


_WORD, _LENGTH = "regexp_extract(content, '([a-z]+)', 1)", "length(content)"


def _by_length_sql(*values: str) -> str:
    return f"""([{', '.join(f"'{v}'" for v in values)}])[{_LENGTH} % {len(values)} + 1]"""


def _file(kind: str, x: Column) -> Column:
    return F.concat(F.lit(kind + "/"), _word(x))


def _report(tool: str, t, value: Column) -> DataFrame:
    """Hits of a tool's reports, one report for each document with an issue for each
    of its lines, and of one that is no JSON."""
    rows = t.documents.select(_id().alias("target"), value.alias("value")).unionByName(t.spark.sql("SELECT 'none' AS target, 'no json' AS value"))
    return tool_reports.normalize(tool, rows).withColumn("description", F.sha2("description", 256))


def _hits(engine: str, rows: str = LINES_SQL, **columns: str) -> str:
    none = {"file": "''", "line": "0", "function": "''", "category": "''", "severity": "'MEDIUM'", "title": "''", "description": "content", "swc_id": "''", "confidence": "0.5"} | columns
    none["description"], none["line"], none["confidence"] = f"sha256({none['description']})", f"CAST({none['line']} AS INTEGER)", f"CAST({none['confidence']} AS DOUBLE)"
    return f"SELECT '{engine}' AS engine, CAST(doc_id AS VARCHAR) AS target, {', '.join(f'{v} AS {k}' for k, v in none.items())} FROM {rows}"


_IMPACTS = ("High", "Medium", "Low", "Informational", "Optimization", "Unheard", None)
_LEVELS = ("HIGH", "MEDIUM", "LOW", "INFO", "INFO", "MEDIUM", "MEDIUM")


@query(
    "normalize_slither",
    _hits(
        "slither",
        file=f"CASE {_LENGTH} % 5 WHEN 1 THEN 'short/' || {_WORD} WHEN 2 THEN 'src/' || {_WORD} WHEN 3 THEN 'src/' || {_WORD} ELSE '' END",
        line=f"CASE WHEN {_LENGTH} % 5 IN (1, 2, 3) THEN line ELSE 0 END",
        function=f"CASE WHEN {_LENGTH} % 5 IN (2, 3) THEN {_WORD} ELSE '' END",
        category=f"'check-' || {_WORD}",
        severity=_by_length_sql(*_LEVELS),
        title=f"'Check-' || {_WORD}",
        swc_id=f"CASE WHEN {_LENGTH} % 3 = 0 THEN 'SWC-' || {_LENGTH} ELSE '' END",
        confidence="([0.6, 0.8, 0.5, 0.6])[line % 4 + 1]",
    ),
)
def normalize_slither(t):
    """Elements by the length of the line: a contract only; a node with a short name;
    a function; a node without a file before a function; none."""

    def detector(x, i):
        def element(kind, relative, short, name):
            place = F.struct(relative.alias("filename_relative"), short.alias("filename_short"), F.array(i + 1, i + 9).alias("lines"))
            return F.struct(F.lit(kind).alias("type"), name.alias("name"), place.alias("source_mapping"))

        none, empty = F.lit(None).cast("string"), F.lit("")
        contract, node = element("contract", _file("src", x), none, F.lit("C")), element("node", empty, _file("short", x), F.lit("n"))
        function, lost = element("function", _file("src", x), none, _word(x)), element("node", none, empty, F.lit("n"))
        k = F.length(x) % 5
        elements = F.when(k == 0, F.array(contract)).when(k == 1, F.array(contract, node)).when(k == 2, F.array(contract, function)).when(k == 3, F.array(lost, function)).otherwise(F.slice(F.array(contract), 1, 0))
        sure = F.element_at(F.array(F.lit("Medium"), F.lit("High"), F.lit("Low"), none), ((i + 1) % 4 + 1).cast("int"))
        see = F.when(F.length(x) % 3 == 0, F.concat(F.lit("see SWC-"), F.length(x).cast("string"), F.lit(" there")))
        return F.struct(F.concat(F.lit("Check-"), _word(x)).alias("check"), _by_length(x, *_IMPACTS).alias("impact"), sure.alias("confidence"), x.alias("description"), see.alias("markdown"), elements.alias("elements"))

    return _report("slither", t, _json(results=F.struct(_each_line(detector).alias("detectors"))))


_INSTANCES = f"(SELECT l.*, instance FROM {LINES_SQL} l, unnest(CASE {_LENGTH} % 3 WHEN 0 THEN [0] WHEN 1 THEN [1] ELSE [1, 2] END) u(instance))"


@query(
    "normalize_aderyn",
    _hits("aderyn", _INSTANCES, file=f"CASE WHEN instance = 0 THEN '' ELSE 'src/' || {_WORD} END", line="CASE WHEN instance = 1 THEN line ELSE 0 END", function=f"CASE WHEN instance = 0 THEN '' ELSE {_WORD} END", category=f"'weak-' || {_WORD} || '-point'", severity=_by_length_sql(*_LEVELS), title=f"'Weak ' || {_WORD} || ' Point'"),
)
def normalize_aderyn(t):
    """No, one or two instances an issue; the line of the second is no number."""

    def issue(x, i):
        places = F.array(*[F.struct(_file("src", x).alias("path"), line.alias("line"), _word(x).alias("function")) for line in ((i + 1).cast("string"), F.lit("?"))])
        return F.struct(F.concat(F.lit("Weak "), _word(x), F.lit(" Point")).alias("title"), _by_length(x, *_IMPACTS).alias("impact"), x.alias("details"), F.slice(places, 1, F.length(x) % 3).alias("instances"))

    return _report("aderyn", t, _json(issues=_each_line(issue)))


@query(
    "normalize_mythril",
    _hits("mythril", file=f"'src/' || {_WORD}", line="line", function=f"CASE WHEN {_LENGTH} % 2 = 0 THEN {_WORD} ELSE '' END", category=f"{_WORD} || '-overflow'", severity=_by_length_sql("HIGH", "LOW", "MEDIUM"), title=f"{_WORD} || ' Overflow'", swc_id=f"CASE WHEN {_LENGTH} % 4 IN (1, 2) THEN 'SWC-' || {_LENGTH} ELSE '' END", confidence="0.7"),
)
def normalize_mythril(t):
    """Weakness numbers with and without their prefix, empty or missing."""

    def issue(x, i):
        n, k = F.length(x).cast("string"), F.length(x) % 4
        swc = F.when(k == 0, "").when(k == 1, n).when(k == 2, F.concat(F.lit("SWC-"), n))
        return F.struct(F.concat(_word(x), F.lit(" Overflow")).alias("title"), _by_length(x, "High", "Low", None).alias("severity"), x.alias("description"), F.when(F.length(x) % 2 == 0, _word(x)).alias("function"), _file("src", x).alias("filename"), (i + 1).alias("lineno"), swc.alias("swc-id"))

    return _report("mythril", t, _json(issues=_each_line(issue)))


@query(
    "normalize_semgrep",
    _hits("semgrep", file=f"'src/' || {_WORD}", line="line", category=_WORD, severity=_by_length_sql("HIGH", "MEDIUM", "LOW", "MEDIUM"), title=_by_length_sql("", "pack.", "pack.deep.") + f" || {_WORD}", description="left(content, 2000)", confidence="0.6"),
)
def normalize_semgrep(t):
    """Names of rules with no, one and two packs before them; levels in either case or missing."""

    def result(x, i):
        extra = F.struct(_by_length(x, "ERROR", "warning", "INFO", None).alias("severity"), x.alias("message"))
        return F.struct(F.concat(_by_length(x, "", "pack.", "pack.deep."), _word(x)).alias("check_id"), _file("src", x).alias("path"), F.struct((i + 1).alias("line")).alias("start"), extra.alias("extra"))

    return _report("semgrep", t, _json(results=_each_line(result)))


@query(
    "normalize_echidna",
    _hits("echidna", file=_WORD, function=f"CASE WHEN {_LENGTH} % 3 = 0 THEN '' ELSE 'echidna_' || {_WORD} END", category="'assertion-failure'", severity="'HIGH'", title=f"'assertion failure in ' || CASE WHEN {_LENGTH} % 3 = 0 THEN '?' ELSE 'echidna_' || {_WORD} END", description="left(content, 2000)", confidence="0.95"),
)
def normalize_echidna(t):
    """Every third length of a line names no function."""
    issue = lambda x: F.struct(_word(x).alias("contract"), F.when(F.length(x) % 3 != 0, F.concat(F.lit("echidna_"), _word(x))).alias("function"), x.alias("bug"))
    return _report("echidna", t, _json(issues=_each_line(issue)))


@query(
    "normalize_npm_audit",
    _hits("npm-audit", file="'package.json'", category="'dependency-vuln'", severity=_by_length_sql("HIGH", "LOW", "MEDIUM"), title=f"CASE WHEN {_LENGTH} % 2 = 0 THEN {_WORD} || ' is open' ELSE {_WORD} || '-' || line END", confidence="0.8"),
)
def normalize_npm_audit(t):
    """A package for each line; half have no title."""

    def entry(x, i):
        v = F.struct(_by_length(x, "high", "low", None).alias("severity"), F.when(F.length(x) % 2 == 0, F.concat(_word(x), F.lit(" is open"))).alias("title"), x.alias("url"))
        return F.struct(F.concat(_word(x), F.lit("-"), (i + 1).cast("string")).alias("key"), v.alias("value"))

    return _report("npm-audit", t, _json(vulnerabilities=F.map_from_entries(_each_line(entry))))


@query(
    "normalize_cargo_audit",
    _hits("cargo-audit", file="'Cargo.toml'", category="'dependency-vuln'", severity=_by_length_sql("HIGH", "MEDIUM", "MEDIUM"), title=_WORD, description="left(content, 2000)", confidence="0.85"),
)
def normalize_cargo_audit(t):
    """An advisory for each line, high, low or without a level."""
    advisory = lambda x: F.struct(_by_length(x, "high", "low", None).alias("severity"), _word(x).alias("title"), x.alias("description"))
    return _report("cargo-audit", t, _json(vulnerabilities=F.struct(_each_line(lambda x: F.struct(advisory(x).alias("advisory"))).alias("list"))))


@query(
    "flatten_report",
    f"""SELECT CASE WHEN {_LENGTH} % 3 = 0 THEN 'own-' || {_WORD} WHEN size % 2 = 1 THEN 't' || doc_id WHEN {_LENGTH} % 2 = 0 THEN 'even' || doc_id ELSE 'odd' || doc_id END AS target,
  {_WORD} AS category, {_by_length_sql("HIGH", "LOW")} AS severity, CAST({_LENGTH} % 10 AS DOUBLE) / 10 AS confidence
  FROM (SELECT doc_id, length({_TEXT}) AS size, unnest(string_split({_TEXT}, chr(10))) AS content FROM documents)""",
)
def flatten_report(t):
    """A finding for each line, under two targets or flat; some have a target of their own."""

    def finding(x):
        own = F.when(F.length(x) % 3 == 0, F.concat(F.lit("own-"), _word(x)))
        return F.struct(own.alias("target"), _word(x).alias("category"), _by_length(x, "HIGH", "LOW").alias("severity"), ((F.length(x) % 10) / 10).alias("confidence"))

    whole = F.split(F.coalesce("text", F.lit("")), "\n")
    part = lambda kind, rest: F.struct(F.concat(F.lit(kind), _id()).alias("target"), F.transform(F.filter(whole, lambda x: F.length(x) % 2 == rest), finding).alias("findings"))
    nested = _json(targets=F.array(part("even", 0), part("odd", 1)))
    flat = _json(target=F.concat(F.lit("t"), _id()), findings=F.transform(whole, finding))
    value = F.when(F.length(F.coalesce("text", F.lit(""))) % 2 == 0, nested).otherwise(flat)
    return tool_reports.flatten_report(t.documents.select(value.alias("value")))


@query("read_chain_logs", "SELECT '0xab' || user_id AS address, event_type AS topic, event_id AS block_number, 'h' || event_id AS tx_hash FROM events WHERE event_id % 5 <> 0 AND user_id IS NOT NULL")
def read_chain_logs(t):
    """Logs with a block number in hex; every fifth has none and goes."""
    block = F.when(F.col("event_id") % 5 == 0, "zz").otherwise(F.concat(F.lit("0x"), F.hex("event_id")))
    value = _json(address=F.concat(F.lit("0xAB"), F.col("user_id").cast("string")), topics=F.array("event_type"), data=F.lit("0x"), blockNumber=block, transactionHash=F.concat(F.lit("h"), F.col("event_id").cast("string")))
    return tool_reports.read_chain_logs(t.events.select(value.alias("value"))).select("address", F.get("topics", F.lit(0)).alias("topic"), "block_number", "tx_hash")


@query("dependency_urls", f"SELECT DISTINCT 'https://github.com/a/' || {_WORD} || '-' || {_LENGTH} AS url FROM {LINES_SQL} WHERE doc_id % 6 < 5")
def dependency_urls(t):
    """Git urls in manifests of five kinds, a dependency before every line of a document."""
    name, k = _one_of(".gitmodules", "package.json", "Cargo.toml", "Scarb.toml", "remappings.txt", "other"), F.col("doc_id") % 6

    def dependency(x):
        at = F.concat(F.lit("a/"), _word(x), F.lit("-"), F.length(x).cast("string"))
        whole = F.concat(F.lit("https://github.com/"), at)
        line = F.when(k == 0, F.concat(F.lit("url = "), whole)).when(k == 1, F.concat(F.lit('"github:'), at, F.lit('"'))).when(k == 2, F.concat(F.lit('git = "'), whole, F.lit('"'))).when(k == 3, F.concat(F.lit('github = "'), at, F.lit('"'))).otherwise(F.concat(F.lit("@x="), whole))
        return F.concat(line, F.lit("\n"), F.regexp_replace(x, "[^a-z ]", ""))

    rows = t.documents.select(F.concat(F.lit("r/"), name).alias("path"), F.array_join(_each_line(dependency), "\n").alias("text"))
    return tool_reports.manifest_dependencies(rows)


@query("detect_framework", "SELECT 'r' || r AS repo, (['foundry', 'hardhat', 'truffle', 'brownie', 'unknown'])[r % 5 + 1] AS framework, array_to_string(list_sort(list_distinct(list('^0.8.' || doc_id % 3))), ',') AS pragmas FROM (SELECT doc_id, doc_id % 500 AS r FROM documents) GROUP BY r")
def detect_framework(t):
    """Frameworks of repositories, each with many documents as files."""
    r = F.col("doc_id") % 500
    name = F.element_at(F.array(*[F.lit(x) for x in ("foundry.toml", "hardhat.config.ts", "truffle-config.js", "brownie-config.yaml", "a.sol")]), (r % 5 + 1).cast("int"))
    text = F.concat(F.lit("pragma solidity ^0.8."), (F.col("doc_id") % 3).cast("string"), F.lit(";\n"), _words())
    files = t.documents.select(F.concat(F.lit("r"), r.cast("string")).alias("repo"), F.concat(F.lit("x/"), name).alias("path"), text.alias("text"))
    return corpus.detect_framework(files).select("repo", "framework", F.array_join("pragmas", ",").alias("pragmas"))


@query(
    "mnemonic_scan",
    """WITH l AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[^a-z]+')) AS word FROM benchmark) WHERE word <> ''),
    w AS (SELECT doc_id, ws[i] AS word, i - 1 AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[^a-z]+') AS ws FROM documents))),
    h AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM w WHERE word <> '' AND word IN (SELECT word FROM l))
    SELECT doc_id, CAST(min(n) AS INTEGER) AS start, count(*) AS length FROM h GROUP BY doc_id, g HAVING count(*) >= 12""",
)
def mnemonic_scan(t):
    """Runs of twelve or more words that the benchmark's items hold."""
    words = t.benchmark.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[^a-z]+")).alias("word")).where("word <> ''")
    return reach.mnemonic_scan(t.documents, words)


@query("tier_limits", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE CASE o_custkey % 3 WHEN 0 THEN n <= 2 WHEN 1 THEN TRUE ELSE FALSE END")
def tier_limits(t):
    """Orders that a customer's tier allows: two, all, or (no such tier) none."""
    k = F.col("o_custkey") % 3
    tier = F.when(k == 0, "free").when(k == 1, "team").otherwise("gone")
    return reach.tier_limit(t.orders.select("o_orderkey", "o_custkey"), {"free": 2, "team": -1}, "o_custkey", tier, ["o_orderkey"])


@query("parse_robots", "SELECT host, path FROM (SELECT 'h' || doc_id AS host, unnest(list_transform(string_split(coalesce(text, ''), chr(10))[1:40], lambda l: '/' || regexp_replace(l, '[^a-z]', '', 'g'))) AS path FROM documents)")
def parse_robots(t):
    """Disallowed paths of robots files, a rule for each line of a document."""
    rules = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("Disallow : /"), F.regexp_replace(x, "[^a-z]", ""), F.lit(" # all")))
    text = F.concat(F.lit("User-agent: *\r\nAllow: /x\ndisallow:\n"), F.array_join(rules, "\r\n"))
    return web.robots(t.documents.select(F.concat(F.lit("h"), _id()).alias("host"), text.alias("text")))


@query("parse_sitemap", "SELECT 'h' || doc_id AS host, 'http://x/' || unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+')[1:100]) AS url FROM documents")
def parse_sitemap(t):
    """Urls of sitemaps, one for each word of a document."""
    urls = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0)), lambda w: F.concat(F.lit("<url><loc> http://x/"), w, F.lit(" </loc></url>")))
    return web.sitemap(t.documents.select(F.concat(F.lit("h"), _id()).alias("host"), F.array_join(urls, "\n").alias("text")))


@query("ct_subdomains", "SELECT name FROM (SELECT DISTINCT unnest(['c' || c_custkey || '.example.com', 'n' || c_nationkey || '.example.com']) AS name FROM customer) ORDER BY name LIMIT 200")
def ct_subdomains(t):
    """First names under a domain in certificates, one for each customer."""
    c, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    value = F.concat(F.lit("*.C"), c, F.lit(".example.com\nmyexample.com\nn"), n, F.lit(".Example.com"))
    return web.subdomains(t.customer.select(value.alias("name_value")), "example.com")


@query("archive_urls", "SELECT 'https://web.archive.org/web/' || page_id || '/' || url AS url FROM pages WHERE page_id % 3 <> 0")
def archive_urls(t):
    return web.archive_urls(t.pages.select(F.col("page_id").cast("string").alias("timestamp"), F.col("url").alias("original"), F.when(F.col("page_id") % 3 == 0, "404").otherwise("200").alias("statuscode")))


_VERDICTS = ("reachable", "not_reachable", "unknown")
_LINES_WORDS = f"(SELECT doc_id, line, content, {_LENGTH} AS n, {_WORD} AS word, doc_id * 1000000 + line AS node FROM {LINES_SQL})"


def _line_rows(t) -> DataFrame:
    """doc_id, line, x, n (its length), word (its first) and node of every line."""
    rows = lines(t.documents).select("doc_id", F.col("line").cast("long").alias("line"), F.col("content").alias("x"))
    return rows.select("*", F.length("x").alias("n"), _word(F.col("x")).alias("word"), (F.col("doc_id") * 1000000 + F.col("line")).alias("node"))


@query(
    "corroborate_reachability",
    f"""SELECT node, CASE WHEN a = 'reachable' OR b = 'reachable' THEN 'reachable' WHEN a = 'not_reachable' AND coalesce(b, a) = a THEN 'not_reachable' ELSE 'unknown' END AS verdict, a = b AS agree
    FROM (SELECT node, {_one_of_sql(*_VERDICTS).replace("doc_id", "n")} AS a, CASE WHEN word <> '' THEN {_one_of_sql(*_VERDICTS).replace("doc_id", "length(word)")} END AS b FROM {_LINES_WORDS})""",
)
def corroborate_reachability(t):
    """A verdict by the length of a line, and one by that of its first word if it has one."""
    rows = _line_rows(t)
    first = rows.select("node", _by_length(F.col("x"), *_VERDICTS).alias("verdict"))
    second = rows.where("word <> ''").select("node", _by_length(F.col("word"), *_VERDICTS).alias("verdict"))
    return reach.corroborate(first, second)


_SIGNATURES = ("@external\ndef f", "@internal\ndef f", "public entry fun f", "public(friend) fun f", "(define-private (f", "() f")
_SIGNED = ("vyper", "vyper", "move", "move", "clarity", "func")


def _functions(t) -> DataFrame:
    """A signature for each line, of a kind that its length picks."""
    x = F.col("x")
    return _line_rows(t).select("doc_id", "line", "node", _by_length(x, *_SIGNED).alias("lang"), F.concat(_by_length(x, *_SIGNATURES), "word", F.lit("(a)")).alias("signature"))


@query("visibility_reach", f"SELECT doc_id, line, CASE WHEN n % 6 IN (0, 2) THEN 'reachable' ELSE 'unknown' END AS reach, (['open', 'closed', 'open', 'closed', 'closed', 'none'])[n % 6 + 1] AS declared FROM {_LINES_WORDS}")
def visibility_reach(t):
    return reach.visibility_reach(_functions(t)).select("doc_id", "line", "reach", "declared")


@query("reach_dispatch", f"SELECT node, CASE WHEN n % 6 IN (0, 2) THEN 'reachable' ELSE 'unknown' END AS verdict FROM {_LINES_WORDS} UNION ALL SELECT -1 - node, {_one_of_sql(*_VERDICTS).replace('doc_id', 'length(word)')} FROM {_LINES_WORDS} WHERE n % 2 = 0")
def reach_dispatch(t):
    """Declarations of four languages, call-graph verdicts of a fifth."""
    graph = _line_rows(t).where("n % 2 = 0").select((-1 - F.col("node")).alias("node"), _by_length(F.col("word"), *_VERDICTS).alias("verdict"))
    solidity = graph.select("node", F.lit("solidity").alias("lang"), F.lit("function f()").alias("signature"))
    return reach.reach_dispatch(_functions(t).select("node", "lang", "signature").unionByName(solidity), graph)


_BASES = "CASE n % 4 WHEN 0 THEN [] WHEN 1 THEN ['B' || word] WHEN 2 THEN ['B' || word, 'C' || n] ELSE ['lib.B' || word, 'C' || n] END"


@query("inheritance_edges", f"SELECT doc_id, 'A' || line AS contract, unnest({_BASES}) AS base FROM {_LINES_WORDS}")
def inheritance_edges(t):
    """A contract or interface for each line: without a base, with one, with two of
    which one has arguments, with a qualified one and a line break."""

    def contract(x, i):
        b, c, k = F.concat(F.lit("B"), _word(x)), F.concat(F.lit("C"), F.length(x).cast("string")), F.length(x) % 4
        heirs = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" is "), b)).when(k == 2, F.concat(F.lit(" is "), b, F.lit(", "), c, F.lit("(1, x)"))).otherwise(F.concat(F.lit(" is lib."), b, F.lit(",\n  "), c))
        return F.concat(F.when(i % 2 == 0, "contract A").otherwise("interface A"), (i + 1).cast("string"), heirs, F.lit(" { string s = '"), F.regexp_replace(x, "[^a-z]", ""), F.lit("'; }"))

    return reach.inheritance_edges(t.documents.select("doc_id", F.array_join(_each_line(contract), "\n").alias("text")))


@query(
    "external_interfaces",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list(call)))[1:15], ',') AS calls FROM
    (SELECT doc_id, CASE n % 3 WHEN 0 THEN 'IT' || word || '.go' || n ELSE 'IC' || word || '.sync' || n END AS call FROM {_LINES_WORDS} WHERE n % 3 < 2) GROUP BY doc_id""",
)
def external_interfaces(t):
    """Lines as calls through typed variables, through casts, and through a number."""

    def call(x, i):
        n, v, k = F.length(x).cast("string"), F.concat(F.lit("t"), (i + 1).cast("string")), F.length(x) % 3
        typed = F.concat(F.when(k == 0, F.concat(F.lit("IT"), _word(x))).otherwise("uint"), F.lit(" "), v, F.lit("; "), v, F.lit(".go"), n, F.lit("(a, 1);"))
        return F.when(k == 1, F.concat(F.lit("IC"), _word(x), F.lit("(pair).sync"), n, F.lit("();"))).otherwise(typed)

    text = F.concat(F.lit("contract X { function f() { "), F.array_join(_each_line(call), "\n"), F.lit(" } }"))
    return reach.external_interfaces(t.documents.select("doc_id", text.alias("text"))).select("doc_id", F.array_join("calls", ",").alias("calls"))


@query("taint_flows", "SELECT CAST(a.conv_id AS VARCHAR) AS file, 't0' AS entry, 0 AS entry_param, 't2' AS fn, 'send' AS sink, 2 AS hops FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) a WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1) AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 2)")
def taint_flows(t):
    """Turns as functions that hand their parameter on; from the third on they send."""
    c = t.conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("string").alias("file"), "turn").distinct()
    fn = lambda n: F.concat(F.lit("t"), n.cast("string"))
    zero = F.lit(0)
    entries = c.where("turn = 0").select("file", F.lit("t0").alias("fn"), zero.alias("param"))
    calls = c.select("file", fn(F.col("turn")).alias("caller"), zero.alias("caller_param"), fn(F.col("turn") + 1).alias("callee"), zero.alias("callee_param"))
    calls = calls.join(c.select("file", fn(F.col("turn")).alias("callee")), ["file", "callee"], "left_semi")
    sinks = c.where("turn >= 2").select("file", fn(F.col("turn")).alias("fn"), zero.alias("param"), F.lit("send").alias("sink"))
    return reach.taint_flows(entries, calls, sinks)


@query(
    "taint_local",
    "SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['x', 'y', 'z'] WHEN 1 THEN ['x', 'z'] ELSE ['x'] END) AS name, 'x' AS param FROM documents UNION ALL SELECT doc_id, unnest(['msg.sender', 'who']), 'msg.sender' FROM documents",
)
def taint_local(t):
    """Names that a function's parameter and its caller influence, around each
    document in a string: through a chain, past a later assignment, not past state."""
    k = F.col("doc_id") % 3
    lines = F.when(k == 0, "uint y = x * 2; z = y + 1;").when(k == 1, "uint y = x * 2; z = y + 1; y = bal[x];").otherwise("uint y = total + x; z = y + 1;")
    file = F.concat(F.lit("function f(uint x) public { string s = '"), _words(), F.lit("'; address who = msg.sender; "), lines, F.lit(" }"))
    found = code.extract_functions(t.documents.select("doc_id", file.alias("text"), F.lit("solidity").alias("lang")))
    known = reach.local_influence(code.assignments(found.withColumn("state", F.array(F.lit("total"), F.lit("bal")))))
    return known.where(~F.contains("name", F.lit("#"))).select("doc_id", "name", "param")


@query("generic_vulnerable", "SELECT CAST(user_id AS VARCHAR) AS finding, CAST(event_id AS VARCHAR) AS version, bool_or(value > 40) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS vulnerable FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL")
def generic_vulnerable(t):
    """Event types as forms of a user's code, marked by a high value."""
    e = t.events.where("value IS NOT NULL AND user_id IS NOT NULL")
    return locate.generic_vulnerable(e.select(F.col("user_id").cast("string").alias("finding"), F.col("event_id").alias("version"), F.col("event_type").alias("canon"), (F.col("value") > 40).alias("marked")))


def _versions() -> tuple[Column, Column, Column, Column]:
    """Two versions of a function with a document in a string: the same, renamed,
    in another order, grown, changed."""
    k, s = F.col("doc_id") % 5, F.concat(F.lit("string s = '"), _words(), F.lit("'; "))
    old = F.concat(F.lit("{ one = two; three(four); "), s, F.lit("}"))
    new = F.when(k == 1, F.concat(F.lit("{ uno = dos; three(four); "), s, F.lit("}"))).when(k == 2, F.concat(F.lit("{ three(four); one = two; "), s, F.lit("}"))).when(k == 3, F.concat(F.lit("{ one = two; three(four); five(); "), s, F.lit("}"))).when(k == 4, F.concat(F.lit("{ one = two + 7; three(four); "), s, F.lit("}"))).otherwise(old)
    return F.lit("f"), old, F.when(k == 1, "g").otherwise("f"), new


@query("change_kind", "SELECT doc_id, (['identical', 'renamed', 'reshuffled', 'grown', 'changed'])[doc_id % 5 + 1] AS kind FROM documents")
def change_kind(t):
    return t.documents.select("doc_id", code.change_kind(*_versions()).alias("kind"))


@query("split_statements", f"SELECT doc_id, 3 + len(regexp_extract_all({_TEXT}, '[a-z]+')) AS n FROM documents")
def split_statements(t):
    """Statements of a body with a loop, a string with a cut mark and a call for each word."""
    calls = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0)), lambda w: F.concat(w, F.lit("(f(g({a: 1}; b)));")))
    body = F.concat(F.lit("{ for (uint i = h(1); i < n(k(x)); i++) { c = 'a;b'; } // d;\n"), F.array_join(calls, " "), F.lit(" return c; }"))
    return t.documents.select("doc_id", F.size(code.statements(body)).cast("long").alias("n"))


def _weak(t) -> DataFrame:
    """Functions with a statement for each line, by its length: sends, writes, checks
    of the caller, locks and events in the order of the document."""

    def statement(x):
        n, k = F.length(x).cast("string"), F.length(x) % 12
        write = F.concat(F.lit("v"), n, F.lit(" = 1;"))
        return F.when(k % 6 == 0, "to.transfer(a);").when(k % 6 == 1, write).when(k == 3, "require(msg.sender == owner);").when(k == 5, "locked;").otherwise(F.concat(F.lit("emit E("), n, F.lit(");")))

    body = F.concat(F.lit("{ string memory s; "), F.array_join(_each_line(statement), "\n"), F.lit(" }"))
    seen = F.element_at(F.array(*[F.lit(x) for x in (" public", " external", " internal", " public view")]), (F.length(F.coalesce("text", F.lit(""))) % 4 + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(F.lit("function f"), _id(), F.lit("()"), seen).alias("signature"), body.alias("body"))


_ACTS = f"""(SELECT doc_id, any_value(length({_TEXT})) AS size, min(line) FILTER (n % 6 = 0) AS sent, max(line) FILTER (n % 6 = 1) AS wrote, bool_or(n % 12 = 3) AS checked, bool_or(n % 12 = 5) AS locked
  FROM {_LINES_WORDS} JOIN documents USING (doc_id) GROUP BY doc_id)"""


@query("reentrancy_vulnerable", f"SELECT doc_id, sent IS NOT NULL AND NOT locked AND (wrote IS NULL OR wrote > sent) AS weak FROM {_ACTS}")
def reentrancy_vulnerable(t):
    return _weak(t).select("doc_id", code.reentrancy_vulnerable(F.col("body")).alias("weak"))


@query("access_vulnerable", f"SELECT doc_id, size % 4 < 2 AND coalesce(sent, wrote) IS NOT NULL AND NOT checked AS weak FROM {_ACTS}")
def access_vulnerable(t):
    return _weak(t).select("doc_id", code.access_vulnerable(F.col("signature"), fx.strip_comments(F.col("body"))).alias("weak"))


@query("elsewhere_scan", f"SELECT 'p' || doc_id AS path, 'f' AS name FROM {_ACTS} WHERE wrote > sent AND doc_id % 3 <> 0")
def elsewhere_scan(t):
    """Functions that write after they send, besides those already located."""
    named = _weak(t).select(F.concat(F.lit("p"), _id()).alias("path"), F.lit("f").alias("name"), "body", "doc_id")
    return locate.elsewhere(named, named.where("doc_id % 3 = 0"), F.col("body").rlike("(?s)transfer.* = 1;"))


@query("places", "SELECT event_id, CAST(event_id % 1000 AS INTEGER) AS line, 'f' || event_id || CASE WHEN event_id % 2 = 0 THEN ':' || event_id % 1000 ELSE '' END AS place FROM events")
def places(t):
    """Lines of hints, and places with and without a line."""
    i, n = F.col("event_id").cast("string"), F.col("event_id") % 1000
    line = fx.start_line(F.concat(F.lit("L"), n.cast("string"), F.lit("-2000")))
    return t.events.select("event_id", line.alias("line"), fx.location(F.concat(F.lit("f"), i), F.when(F.col("event_id") % 2 == 0, line)).alias("place"))


@query("identities_of_rows", "SELECT c_custkey, sha256('{\"a\":' || c_custkey || ',\"b\":\"x' || c_nationkey || '\"}') AS config, sha256(c_custkey || 'x' || c_nationkey) AS fallback FROM customer")
def identities_of_rows(t):
    """Fingerprints of a configuration, and of a finding without a place."""
    x = F.concat(F.lit("x"), F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", fx.config_fingerprint(F.col("c_custkey").alias("a"), x.alias("b")).alias("config"), fx.fingerprint_fallback(F.col("c_custkey"), x).alias("fallback"))
