"""Rules across functions and contracts, comments by language, functions as SQL rows.

There are no source files to read, so contracts are written around documents: names of
contracts, functions, parameters and variables are words of the text, what is guarded,
bounded, handed on and in which order follows from how many words it has, and the text
itself stands in a comment and in a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import source, table
from auditspark.operators import contracts, locate, verdicts
from auditspark.plans.base import query
from auditspark.shared import written

_WORDS = "[a-z]{3,9}"
_WORDS_SQL = f"regexp_extract_all(coalesce(text, ''), '{_WORDS}')"


def _words(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    noted = F.translate(text, "\"\\\n*", "    ")
    return docs.select("doc_id", words.alias("ws"), F.size(words).alias("n"), F.translate(text, "*", " ").alias("said"), noted.alias("noted"))


def _name(prefix: str, at: int) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.coalesce(F.get("ws", F.lit(at)), F.lit("none")))


def _name_sql(prefix: str, at: int) -> str:
    return f"'{prefix}_' || coalesce(ws[{at + 1}], 'none')"


def _flow_files(docs: DataFrame) -> DataFrame:
    """Payments in the function itself, one call away in a base contract, and two calls away
    with the arguments in either order; guarded, bounded, or drawn from state."""
    d = _words(docs).withColumn("shape", F.col("n") % 3).withColumn("swap", F.expr("n div 3 % 2")).withColumn("safe", F.expr("n div 6 % 4"))
    base, end, value, top, go, given, mid, inner = (_name(p, i) for i, p in enumerate(("Base", "end", "v", "Top", "go", "p", "mid", "b")))
    lit = F.lit
    own = F.when(F.col("safe") == 3, F.concat(lit("uint x = "), given, lit(" * cap; "))).otherwise(F.concat(lit("uint x = "), given, lit(" + 1; ")))
    own = F.concat(own, F.when(F.col("safe") == 2, "require(x < 9); ").otherwise(""), lit("payable(msg.sender).transfer(x);"))
    one = F.concat(end, lit("(payable(msg.sender), "), given, lit(");"))
    two = F.when(F.col("swap") == 0, F.concat(mid, lit("(q, "), given, lit(");"))).otherwise(F.concat(mid, lit("("), given, lit(", q);")))
    body = F.when(F.col("shape") == 0, own).when(F.col("shape") == 1, one).otherwise(two)
    paid = F.when(F.col("safe") == 3, F.concat(lit("uint z = "), value, lit(" * cap; to.transfer(z);"))).when(F.col("safe") == 2, F.concat(lit("require("), value, lit(" <= cap); to.transfer("), value, lit(");"))).otherwise(F.concat(lit("to.transfer("), value, lit(");")))
    text = F.concat(
        lit("/* "), F.col("said"), lit(" */\ncontract "), base, lit(" {\n  uint cap;\n  function "), end, lit("(address payable to, uint "), value, lit(") internal { "), paid, lit(" }\n}\ncontract "), top, lit(" is "), base, lit(' {\n  string note = "'), F.col("noted"),
        lit('";\n  function '), go, lit("(uint "), given, lit(", uint q) public "), F.when(F.col("safe") == 1, "onlyOwner ").otherwise(""), lit("{ "), body, lit(" }\n  function "), mid, lit("(uint a, uint "), inner, lit(") internal { uint y = "), inner, lit("; "), end, lit("(payable(msg.sender), y); }\n}\n"),
    )
    return d.select("doc_id", text.alias("text"))


@query(
    "taint_of_source",
    f"""SELECT doc_id, {_name_sql("go", 4)} AS entry, CASE WHEN shape = 2 AND swap = 1 THEN 'q' ELSE {_name_sql("p", 5)} END AS entry_param, CASE shape WHEN 0 THEN {_name_sql("go", 4)} ELSE {_name_sql("end", 1)} END AS fn, '.transfer()' AS sink, shape AS hops
    FROM (SELECT doc_id, ws, CAST(len(ws) % 3 AS INT) AS shape, len(ws) // 3 % 2 AS swap, len(ws) // 6 % 4 AS safe FROM (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents)) WHERE safe = 0""",
)
def taint_of_source(t):
    """Parameters that reach a payment, from contracts alone: calls, their arguments and
    the payments are read from the bodies."""
    found = written(source.contracts(_flow_files(t.documents)), "contracts")
    name = lambda c: F.regexp_extract(c, "[.]([^/]+)/", 1)
    return contracts.taint(found, contracts.ancestors(found)).select("doc_id", name("entry").alias("entry"), "entry_param", name("fn").alias("fn"), "sink", "hops")


def _state_files(docs: DataFrame) -> DataFrame:
    """Amounts that others can change, and names that hide others."""
    d = _words(docs)
    base, own, other, setter, buy, top, inner = (_name(p, i) for i, p in enumerate(("Base", "s", "t", "set", "buy", "Top", "f")))
    lit = F.lit
    text = F.concat(
        lit("/* "), F.col("said"), lit(" */ contract "), base, lit(" {\n  uint "), own, lit(";\n  uint public "), other, lit(";\n  function "), setter, lit("(uint v) external "), F.when(F.col("n") % 2 == 0, "onlyOwner ").otherwise(""), lit("{ "), own, lit(" = v; }\n  function "), buy,
        lit("() external { payable(msg.sender).transfer("), F.when(F.expr("n div 2 % 2") == 0, own).otherwise(other), lit("); }\n}\ncontract "), top, lit(" is "), base, lit(" {\n  uint "), F.when(F.col("n") % 3 == 0, own).otherwise(_name("u", 7)), lit(' = 1; string note = "'), F.col("noted"),
        lit('";\n  function '), inner, lit("(uint "), F.when(F.col("n") % 5 == 0, other).otherwise(lit("x")), lit(") public { }\n}\n"),
    )
    return d.select("doc_id", text.alias("text"))


_COUNTED = f"(SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents))"


@query(
    "scan_contracts",
    f"""SELECT doc_id, {_name_sql("buy", 4)} AS function, 'sol-mutable-payment' AS rule_id, {_name_sql("s", 1)} AS what, 'MEDIUM' AS severity FROM {_COUNTED} WHERE n % 2 = 0 AND n // 2 % 2 = 0
    UNION ALL SELECT doc_id, NULL, 'sol-shadowing', {_name_sql("s", 1)}, 'MEDIUM' FROM {_COUNTED} WHERE n % 3 = 0
    UNION ALL SELECT doc_id, {_name_sql("f", 6)}, 'sol-local-shadowing', {_name_sql("t", 2)}, 'LOW' FROM {_COUNTED} WHERE n % 5 = 0""",
)
def scan_contracts(t):
    """Rules across functions and contracts."""
    return contracts.scan_contracts(_state_files(t.documents)).select("doc_id", "function", "rule_id", "what", "severity")


@query(
    "state_uses",
    f"""SELECT doc_id, contract, function, variable, declared_in, use FROM (SELECT doc_id, {_name_sql("Base", 0)} AS contract, {_name_sql("Base", 0)} AS declared_in, {_name_sql("set", 3)} AS function, {_name_sql("s", 1)} AS variable, unnest(['read', 'write']) AS use FROM {_COUNTED}
    UNION ALL SELECT doc_id, {_name_sql("Base", 0)}, {_name_sql("Base", 0)}, {_name_sql("buy", 4)}, CASE WHEN n // 2 % 2 = 0 THEN {_name_sql("s", 1)} ELSE {_name_sql("t", 2)} END, unnest(['read', 'pay']) FROM {_COUNTED})""",
)
def state_uses(t):
    """Which functions read, write and pay by which state variables."""
    found = written(source.contracts(_state_files(t.documents)), "contracts")
    uses = contracts.state_uses(found, contracts.ancestors(found))
    return uses.select("doc_id", "contract", F.regexp_extract("fn", "[.]([^/]+)/", 1).alias("function"), "variable", "declared_in", "use")


#: The text's lines, each in a string with the mark of a comment and again in a comment.
_MARKS = {"solidity": ("//", "/* ", " */"), "vyper": ("#", "", ""), "clarity": (";;", "", ""), "scilla": ("", "(* ", " *)")}


@query(
    "clean_code",
    """SELECT doc_id, lang, sha256(CASE lang WHEN 'solidity' THEN CASE WHEN contains(t, chr(10)) THEN repeat(chr(10), len(t) - len(replace(t, chr(10), ''))) ELSE ' ' END WHEN 'scilla' THEN CASE WHEN contains(t, chr(10)) THEN repeat(chr(10), len(t) - len(replace(t, chr(10), ''))) ELSE ' ' END ELSE '' END
    || array_to_string(list_transform(string_split(t, chr(10)), lambda x: '"' || m || ' ' || x || '" '), chr(10))) AS digest
    FROM (SELECT doc_id, lang, translate(coalesce(text, ''), '"\\''*/#;', '') AS t, CASE lang WHEN 'solidity' THEN '//' WHEN 'vyper' THEN '#' WHEN 'clarity' THEN ';;' ELSE '' END AS m
    FROM (SELECT doc_id, text, (['solidity', 'vyper', 'clarity', 'scilla'])[length(coalesce(text, '')) % 4 + 1] AS lang FROM documents))""",
)
def clean_code(t):
    """Comments go, strings that look like them stay, lines keep their numbers."""
    text = F.coalesce("text", F.lit(""))
    d = t.documents.select("doc_id", F.element_at(F.array(*[F.lit(k) for k in _MARKS]), (F.length(text) % 4 + 1).cast("int")).alias("lang"), F.translate(text, "\"\\'*/#;", "").alias("t"))
    mark, opens, closes = (F.element_at(F.create_map(*[F.lit(x) for k, v in _MARKS.items() for x in (k, v[i])]), F.col("lang")) for i in range(3))
    line = F.when(mark == "", F.lit("")).otherwise(F.concat(mark, F.lit(" ")))
    lines = F.transform(F.split("t", "\n"), lambda x: F.concat(F.lit('"'), mark, F.lit(" "), x, F.lit('" '), F.when(mark == "", F.lit("")).otherwise(F.concat(line, x))))
    head = F.when(opens == "", F.lit("")).otherwise(F.concat(opens, F.col("t"), closes))
    code = F.concat(head, F.array_join(lines, "\n"))
    return d.select("doc_id", "lang", F.sha2(source.clean_code(code, F.col("lang")), 256).alias("digest"))


@query(
    "functions_in_sql",
    f"""SELECT doc_id, lang, {_name_sql("f", 0)} AS name, CASE lang WHEN 'vyper' THEN 'def' ELSE 'function' END AS kind, 2 AS first_line, CASE lang WHEN 'vyper' THEN 2 + lines ELSE 3 + lines END AS last_line
    FROM (SELECT doc_id, ws, lang, CASE lang WHEN 'vyper' THEN 1 ELSE len(string_split(t, chr(10))) END AS lines FROM (SELECT doc_id, {_WORDS_SQL} AS ws, translate(coalesce(text, ''), '{{}}/*"''', '') AS t, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 'solidity' ELSE 'vyper' END AS lang FROM documents))""",
)
def functions_in_sql(t):
    """The table function, joined laterally in SQL."""
    text, words = F.coalesce("text", F.lit("")), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORDS), F.lit(0))
    d = t.documents.select("doc_id", words.alias("ws"), F.translate(text, "{}/*\"'", "").alias("t"), F.when(F.length(text) % 2 == 0, "solidity").otherwise("vyper").alias("lang"))
    braces = F.concat(F.lit("// file\nfunction "), _name("f", 0), F.lit("() public {\n"), F.col("t"), F.lit("\n}\n"))
    indents = F.concat(F.lit("# file\ndef "), _name("f", 0), F.lit("():\n    "), F.translate("t", "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029", " "), F.lit(" end\n"))
    files = d.select("doc_id", "lang", F.when(F.col("lang") == "solidity", braces).otherwise(indents).alias("text"))
    table.register(t.spark)
    return t.spark.sql("SELECT d.doc_id, d.lang, f.name, f.kind, f.first_line, f.last_line FROM {files} d, LATERAL functions(d.text, d.lang) f", files=files)


def _bank_files(docs: DataFrame) -> DataFrame:
    """Three versions of a contract around each document, with names of its words: a payment
    before the books are changed that is renamed, moved, mended or copied on the way."""
    d = _words(docs).withColumn("kind", F.col("n") % 5)
    own, value, later, second = (_name(p, i) for i, p in enumerate(("take", "n", "pay", "sum")))
    lit = F.lit

    def function(name: Column, amount: Column, mended: bool) -> Column:
        book, call = F.concat(lit("held[msg.sender] -= "), amount, lit("; ")), F.concat(lit("(bool done,) = msg.sender.call{value: "), amount, lit('}(""); require(done); '))
        return F.concat(lit("  function "), name, lit("(uint "), amount, lit(") external { require(held[msg.sender] >= "), amount, lit("); "), *((book, call) if mended else (call, book)), lit("}\n"))

    bank = lambda *fs: F.concat(lit("/* "), F.col("said"), lit(" */\ncontract Bank { mapping(address => uint) held;\n  string note = \""), F.col("noted"), lit('";\n'), *fs, lit("}\n"))
    till = lambda f: F.concat(lit("contract Till { mapping(address => uint) held;\n"), f, lit("}\n"))
    weak, renamed, mended = function(own, value, False), function(later, second, False), function(own, value, True)
    a, b = lit("src/Bank.sol"), lit("src/Till.sol")
    row = lambda version, path, text: F.struct(lit(version).alias("version"), path.alias("path"), text.alias("text"))
    two = F.when(F.col("kind") == 0, F.array(row(2, a, bank(weak)))).when(F.col("kind") == 1, F.array(row(2, a, bank(renamed)))).when(F.col("kind") == 2, F.array(row(2, a, bank()), row(2, b, till(renamed))))
    two = two.when(F.col("kind") == 3, F.array(row(2, a, bank(mended)))).otherwise(F.array(row(2, a, bank(mended, renamed))))
    three = F.when(F.col("kind") == 3, F.array(row(3, a, bank(weak)))).otherwise(F.array(row(3, a, bank(mended))))
    every = F.concat(F.array(row(1, a, bank(weak))), two, three)
    return d.select(F.col("doc_id").alias("repo"), own.alias("own"), F.explode(every).alias("f")).select("repo", "own", "f.*", lit("solidity").alias("lang"))


@query(
    "source_verdicts",
    f"""SELECT doc_id AS finding, v.version, CASE v.version WHEN 1 THEN 'STILL OPEN' WHEN 2 THEN (['STILL OPEN', 'STILL OPEN', 'STILL OPEN', 'FIXED', 'BAND-AID'])[n % 5 + 1] ELSE (['FIXED', 'FIXED', 'FIXED', 'REGRESSED', 'FIXED'])[n % 5 + 1] END AS verdict,
    CASE WHEN v.version = 2 AND n % 5 = 2 THEN 'src/Till.sol' ELSE 'src/Bank.sol' END AS path, CASE WHEN v.version = 2 AND n % 5 IN (1, 2) THEN {_name_sql("pay", 2)} ELSE {_name_sql("take", 0)} END AS name FROM {_COUNTED}, (VALUES (1), (2), (3)) AS v(version)""",
)
def source_verdicts(t):
    """Verdicts of every version from its source alone."""
    files = written(_bank_files(t.documents), "versions")
    findings = files.where("version = 1").select(F.col("repo").alias("finding"), "repo", F.lit("reentrancy").alias("kind"), "path", F.col("own").alias("name"))
    return verdicts.source_verdicts(findings, files.drop("own")).select("finding", "version", "verdict", "path", "name")


@query("locate_function")
def locate_function(t):
    """A function for each document, with a statement for each of its lines, by the words
    and commas in it: those of every twentieth are looked for among those of all others
    (likeness has no SQL form; tested against all pairs)."""
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("string")
    statements = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("a"), count(x, "[.!?]"), F.lit(" = f("), count(x, "[^ ]+"), F.lit(", "), count(x, ","), F.lit("); ")))
    every = t.documents.select("doc_id", F.concat(F.lit("p"), "doc_id").alias("path"), F.concat(F.lit("f"), "doc_id").alias("name"), F.concat(F.lit("{ "), F.array_join(statements, ""), F.lit("}")).alias("body"))
    wanted = every.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), "path", "name", "body")
    return locate.locate(wanted, every.where("doc_id % 20 <> 0").select("path", "name", "body"))
