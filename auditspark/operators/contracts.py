"""Rules that look at several functions or contracts at a time.

``source.contracts`` reads the files once; ancestors, uses of state variables, calls and
flows are joins on what it gives, always within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import code, source
from auditspark.operators import reach
from auditspark.shared import written

_NAME = "[A-Za-z_$][A-Za-z0-9_$]*+"
_LEFT = "(?<![A-Za-z0-9_$.])"
_WRITES = rf"{_LEFT}({_NAME})(?:\.{_NAME}|\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+){{0,4}}+\]){{0,16}}+\s*+(?:[-+*/%|&^]?=(?![=>])|\+\+|--)"
_DELETES = rf"(?:\bdelete\s++|\+\+|--)({_NAME})"
_GROWS = rf"{_LEFT}({_NAME})(?:\[[^\[\]]*+\]){{0,8}}+\s*+\.\s*+(?:push|pop)\b"
_DECLARES = rf"{_LEFT}(?:u?int\d*+|address|bool|string|bytes\d*+|[A-Z][A-Za-z0-9_$]*+(?:\.{_NAME})?)(?:\s*+\[[^\]]*+\]){{0,4}}+(?:\s++(?:memory|storage|calldata|payable)){{0,3}}+\s++({_NAME})\s*+(?=[=;,)])"
_COMPARED = rf"(?:(?<![A-Za-z0-9_$])({_NAME})[\])\s]*+(?=[<>])|[<>]=?[\s(]*+({_NAME})(?![\[.(]))"
_GUARD_HEAD = r"\b(?:only[A-Z_]|auth|requires)\w*"
_GUARD_TEST = r"[!=]=\s*msg\s*\.\s*sender\b|\bmsg\s*\.\s*sender\s*[!=]=|\b_check(?:Owner|Role)\s*\(|\bhasRole\s*\("
_SETUP = ("constructor", "initialize")


def _functions(found: DataFrame) -> DataFrame:
    """A row per function with a body: ``fn`` is its name in its file."""
    f = found.select("doc_id", "contract", F.explode("functions").alias("f")).where("f.body IS NOT NULL")
    f = f.select("doc_id", "contract", "f.*", F.size("f.params").alias("arity"))
    head = F.regexp_extract("signature", r"(?s)\)(.*)$", 1)
    return f.select(
        "*",
        F.concat_ws("", "contract", F.lit("."), "name", F.lit("/"), "arity", F.lit("@"), "line").alias("fn"),
        (head.rlike(_GUARD_HEAD) | F.col("body").rlike(_GUARD_TEST)).alias("guarded"),
        (~F.col("signature").rlike(r"\b(?:private|internal)\b") & (F.col("kind") != "modifier")).alias("open"),
        (F.col("name").isin(*_SETUP) | (F.col("name") == F.col("contract"))).alias("setup"),
        F.array_union(F.filter("params", lambda p: p != ""), F.array_union(F.regexp_extract_all(F.concat_ws(" ", F.regexp_extract("signature", r"\breturns\b(.*)$", 1), F.lit(";")), F.lit(_DECLARES), F.lit(1)), F.regexp_extract_all("body", F.lit(_DECLARES), F.lit(1)))).alias("locals"),
    )


def ancestors(found: DataFrame) -> DataFrame:
    """``doc_id``, ``contract``, ``ancestor``, ``place``: all contracts that a contract
    stands on, itself included, by rising ``place``: nearer ones first, of equally near ones
    the one declared last.  One join a level; a contract met twice, as in a diamond or
    in a cycle, stays where it was met first."""
    edges = found.select("doc_id", F.col("contract").alias("ancestor"), F.posexplode("bases").alias("at", "base")).distinct()
    edges = written(edges, "bases")
    seen = written(found.select("doc_id", "contract", F.col("contract").alias("ancestor"), F.array().cast("array<int>").alias("way")).distinct(), "ancestors")
    front = seen
    while True:
        step = front.join(edges, ["doc_id", "ancestor"]).select("doc_id", "contract", F.col("base").alias("ancestor"), F.array_append("way", -F.col("at")).alias("way"))
        step = step.groupBy("doc_id", "contract", "ancestor").agg(F.min("way").alias("way"))
        new = written(step.join(seen, ["doc_id", "contract", "ancestor"], "left_anti"), "ancestors")
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    order = Window.partitionBy("doc_id", "contract").orderBy(F.size("way"), "way", "ancestor")  # a row per ancestor
    return written(seen.withColumn("place", F.row_number().over(order) - 1).drop("way"), "ancestors")


def _state(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "contract", F.explode("state").alias("s")).select("doc_id", "contract", F.col("s.name").alias("variable"), F.col("s.type").alias("type"), F.col("s.visibility").alias("visibility"), F.col("s.line").alias("line"))


def visible_state(found: DataFrame, above: DataFrame) -> DataFrame:
    """``doc_id``, ``contract``, ``variable``, ``declared_in``: what a name means in a
    contract, its own or the nearest inherited state variable."""
    s = _state(found).select("doc_id", F.col("contract").alias("ancestor"), "variable").distinct()
    j = above.join(s, ["doc_id", "ancestor"])
    return j.groupBy("doc_id", "contract", "variable").agg(F.min_by("ancestor", "place").alias("declared_in"))


def shadowing(found: DataFrame, above: DataFrame) -> DataFrame:
    """``doc_id``, ``contract``, ``function``, ``line``, ``variable``, ``declared_in``: a state
    variable that a contract declares although one above it has the name (function null),
    and a parameter or local of a function with the name of a state variable it could see."""
    s = _state(found)
    inherited = above.where("place > 0").join(s.select("doc_id", F.col("contract").alias("ancestor"), "variable").distinct(), ["doc_id", "ancestor"])
    nearest = inherited.groupBy("doc_id", "contract", "variable").agg(F.min_by("ancestor", "place").alias("declared_in"))
    own = s.groupBy("doc_id", "contract", "variable").agg(F.min("line").alias("line"))
    states = own.join(nearest, ["doc_id", "contract", "variable"]).select("doc_id", "contract", F.lit(None).cast("string").alias("function"), "line", "variable", "declared_in")
    inner = _functions(found).select("doc_id", "contract", F.col("name").alias("function"), "line", F.explode("locals").alias("variable"))
    hidden = inner.join(visible_state(found, above), ["doc_id", "contract", "variable"]).select(*states.columns).distinct()
    return states.unionByName(hidden)


def _payments(functions: DataFrame, tokens: bool) -> DataFrame:
    """``doc_id``, ``fn``, ``sink``, ``names`` (of the amount) of every payment; with
    ``tokens``, of tokens too."""
    c = functions.select("doc_id", "fn", F.explode("calls").alias("c")).select("doc_id", "fn", "c.*").withColumn("n", F.size("args"))
    args = lambda i: F.try_element_at("args", F.lit(i + 1))
    one = F.col("on") & (F.col("n") == 1)
    sink = F.when(F.col("value").isNotNull(), F.struct(F.concat("callee", F.lit("{value:}")).alias("sink"), F.col("value").alias("names")))
    sink = sink.when(one & F.col("callee").isin("transfer", "send"), F.struct(F.concat(F.lit("."), "callee", F.lit("()")).alias("sink"), args(0).alias("names")))
    sink = sink.when(one & (F.col("callee") == "value"), F.struct(F.lit("call.value()").alias("sink"), args(0).alias("names")))
    if tokens:
        sink = sink.when(F.col("on") & (F.col("n") == 2) & F.col("callee").isin("transfer", "safeTransfer"), F.struct(F.lit("token").alias("sink"), args(1).alias("names")))
        sink = sink.when(F.col("on") & (F.col("n") == 3) & F.col("callee").isin("transferFrom", "safeTransferFrom"), F.struct(F.lit("token").alias("sink"), args(2).alias("names")))
    return c.select("doc_id", "fn", sink.alias("s")).where("s IS NOT NULL").select("doc_id", "fn", "s.sink", "s.names")


def state_uses(found: DataFrame, above: DataFrame) -> DataFrame:
    """The def-use index: ``doc_id``, ``contract``, ``fn``, ``variable``, ``declared_in``, ``use``
    (read, write, pay: the amount of a payment) of the state variables of each function.  A
    name that the function declares is its own."""
    f = _functions(found)
    listed = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    words = F.array_distinct(F.regexp_extract_all("body", F.lit(_LEFT + f"({_NAME})"), F.lit(1)))
    used = {"write": F.array_distinct(F.concat(listed(_WRITES), listed(_DELETES), listed(_GROWS))), "read": words}
    parts = [f.select("doc_id", "contract", "fn", "locals", F.explode(names).alias("variable"), F.lit(use).alias("use")) for use, names in used.items()]
    paid = _payments(f, True).join(f.select("doc_id", "contract", "fn", "locals"), ["doc_id", "fn"])
    parts.append(paid.select("doc_id", "contract", "fn", "locals", F.explode("names").alias("variable"), F.lit("pay").alias("use")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.where(~F.array_contains("locals", F.col("variable"))).drop("locals").distinct()
    return rows.join(visible_state(found, above), ["doc_id", "contract", "variable"]).select("doc_id", "contract", "fn", "variable", "declared_in", "use")


def mutable_payments(found: DataFrame, uses: DataFrame) -> DataFrame:
    """``doc_id``, ``fn``, ``variable``, ``writer``: a function that anybody may call pays an amount
    out of a state variable which another function, of those in charge, can rewrite."""
    f = _functions(found).select("doc_id", "fn", "guarded", "open", "setup")
    facts = uses.join(f, ["doc_id", "fn"])
    key = ["doc_id", "declared_in", "variable"]
    paid = facts.where("use = 'pay' AND NOT guarded AND NOT setup").select(*key, "fn").distinct()
    changed = facts.where("use = 'write' AND guarded AND open AND NOT setup").select(*key, F.col("fn").alias("writer"))
    both = paid.join(changed, key).where("fn <> writer")
    return both.groupBy("doc_id", "fn", "variable").agg(F.min("writer").alias("writer"))


def plaintext_moves(found: DataFrame, uses: DataFrame) -> DataFrame:
    """``doc_id``, ``fn``, ``variable``: a payable function keeps the caller's number in a state
    variable under the caller's name, a function pays by what is kept there, and the
    contract hashes nothing."""
    f = _functions(found)
    stored = F.regexp_extract_all("body", F.lit(rf"{_LEFT}{_NAME}\s*+\[[^\[\]\n]{{0,80}}+\]\s*+=(?!=)[^;{{}}]{{1,400}}+;"), F.lit(0))
    s = f.where(F.col("signature").rlike(r"\bpayable\b")).select("doc_id", "contract", "fn", F.regexp_extract_all("signature", F.lit(rf"\buint\d*+\s++({_NAME})"), F.lit(1)).alias("numbers"), F.explode(stored).alias("text"))
    parts = rf"^({_NAME})\s*+\[([^\]]*+)\]\s*+=(.*);$"
    s = s.select("doc_id", "contract", "fn", "numbers", *[F.regexp_extract("text", "(?s)" + parts, i).alias(n) for i, n in ((1, "variable"), (2, "index"), (3, "value"))])
    names = F.regexp_extract_all("value", F.lit(f"{_LEFT}({_NAME})"), F.lit(1))
    s = s.where(F.arrays_overlap(names, "numbers") & F.concat_ws(" ", "index", "value").rlike(r"\bmsg\s*\.\s*sender\b"))
    own = uses.where("use = 'write'").join(s, ["doc_id", "contract", "fn", "variable"], "left_semi")
    pays = f.where(F.exists("calls", lambda c: c["on"] & c["callee"].isin("send", "transfer", "call"))).select("doc_id", "fn")
    decided = uses.where("use = 'read'").join(pays, ["doc_id", "fn"], "left_semi").select("doc_id", "declared_in", "variable").distinct()
    hashing = f.where(F.exists("calls", lambda c: c["callee"].isin("keccak256", "sha3", "sha256"))).select("doc_id", "contract").distinct()
    out = own.join(decided, ["doc_id", "declared_in", "variable"], "left_semi").join(hashing, ["doc_id", "contract"], "left_anti")
    return out.select("doc_id", "fn", "variable").distinct()


def _influences(found: DataFrame, above: DataFrame, functions: DataFrame) -> DataFrame:
    """``doc_id``, ``fn``, ``name``, ``param``: see ``reach.local_influence``."""
    names = visible_state(found, above).groupBy("doc_id", "contract").agg(F.collect_list("variable").alias("state"))
    f = functions.join(names, ["doc_id", "contract"], "left").select("doc_id", F.col("fn").alias("name"), "signature", "body", F.coalesce("state", F.array().cast("array<string>")).alias("state"))
    return reach.local_influence(code.assignments(f))


def calls(functions: DataFrame, above: DataFrame, influences: DataFrame) -> DataFrame:
    """The positional call graph: ``doc_id``, ``caller``, ``caller_param``, ``callee``,
    ``callee_param``.  A call means the function of that name and number of parameters in the
    caller's contract or the nearest above it.  An argument carries the parameters that
    influence a name in it; what an index reads does not count."""
    c = functions.select("doc_id", "contract", F.col("fn").alias("caller"), F.explode("calls").alias("c")).where("NOT c.on")
    c = c.select("doc_id", "contract", "caller", F.col("c.callee").alias("name"), F.size("c.args").alias("arity"), F.posexplode("c.args").alias("at", "names"))
    c = c.where(~F.array_contains("names", "[]"))
    known = functions.where("kind = 'function'").select("doc_id", F.col("contract").alias("ancestor"), "name", "arity", F.col("fn").alias("callee"), F.col("params").alias("callee_params"))
    meant = above.join(known, ["doc_id", "ancestor"]).groupBy("doc_id", "contract", "name", "arity").agg(F.min_by(F.struct("callee", "callee_params"), "place").alias("to"))
    j = c.join(meant, ["doc_id", "contract", "name", "arity"]).select("doc_id", "caller", F.col("to.callee").alias("callee"), F.get("to.callee_params", F.col("at")).alias("callee_param"), F.explode("names").alias("name"))
    i = influences.select("doc_id", F.col("fn").alias("caller"), "name", F.col("param").alias("caller_param"))
    return j.where("callee_param <> ''").join(i, ["doc_id", "caller", "name"]).select("doc_id", "caller", "caller_param", "callee", "callee_param").distinct()


def sinks(functions: DataFrame, influences: DataFrame) -> DataFrame:
    """``doc_id``, ``fn``, ``param``, ``sink``: parameters that choose the amount of a payment.  Not
    those of guarded functions, of amounts that are compared with something, or of
    amounts that a checked signature covers."""
    f = functions.where("NOT guarded").select("doc_id", "fn", F.array_distinct(F.concat(*[F.regexp_extract_all("body", F.lit(_COMPARED), F.lit(i)) for i in (1, 2)])).alias("compared"), "calls")
    signed = F.when(F.exists("calls", lambda c: c["callee"] == "ecrecover"), F.flatten(F.flatten(F.transform(F.filter("calls", lambda c: c["callee"].isin("encode", "encodePacked")), lambda c: c["args"]))))
    f = f.select("doc_id", "fn", F.concat("compared", F.coalesce(signed, F.array().cast("array<string>"))).alias("bounded"))
    amount = _payments(functions, False).where(~F.array_contains("names", "[]")).join(f, ["doc_id", "fn"]).where(~F.arrays_overlap("names", "bounded"))
    a = amount.select("doc_id", "fn", "sink", "bounded", F.explode("names").alias("name"))
    return a.join(influences, ["doc_id", "fn", "name"]).where(~F.array_contains("bounded", F.col("param"))).select("doc_id", "fn", "param", "sink").distinct()


def taint(found: DataFrame, above: DataFrame) -> DataFrame:
    """``doc_id``, ``entry``, ``entry_param``, ``fn``, ``sink``, ``hops``: parameters of functions that
    anybody may call and that choose an amount that is paid, there (no hops) or in a function
    that is called on the way; the nearest sink of each parameter."""
    f = written(_functions(found).where("kind <> 'modifier'"), "functions")
    influences = written(_influences(found, above, f), "influences")
    entries = f.where("open AND NOT guarded AND NOT setup").select("doc_id", "fn", F.explode(F.array_append("params", F.lit("msg.sender"))).alias("param")).where("param <> ''")
    edges, ends = written(calls(f, above, influences), "calls"), written(sinks(f, influences), "sinks")
    file = F.col("doc_id").alias("file")
    flows = reach.taint_flows(entries.select(file, "fn", "param"), edges.select(file, "caller", "caller_param", "callee", "callee_param"), ends.select(file, "fn", "param", "sink"))
    return flows.select(F.col("file").alias("doc_id"), "entry", "entry_param", "fn", "sink", "hops")


#: Rules of this module: category, severity, confidence.
CROSS_RULES = {
    "sol-shadowing": ("shadowing", "MEDIUM", 0.6),
    "sol-local-shadowing": ("shadowing", "LOW", 0.75),
    "sol-mutable-payment": ("front-running", "MEDIUM", 0.7),
    "sol-plaintext-move": ("front-running", "HIGH", 0.65),
    "sol-taint-direct": ("uncontrolled-payout", "HIGH", 0.7),
    "sol-taint-flow": ("uncontrolled-payout", "HIGH", 0.65),
}


def scan_contracts(files: DataFrame) -> DataFrame:
    """Hits of the rules across functions on Solidity files (doc_id, text): function,
    line, rule_id, category, severity, confidence; one row per function, rule and name."""
    found = written(source.contracts(files), "contracts")
    above = ancestors(found)
    uses = written(state_uses(found, above), "state-uses")
    places = _functions(found).select("doc_id", "fn", F.col("name").alias("function"), "line")

    def hit(rows: DataFrame, rule: Column) -> DataFrame:
        return rows.select("doc_id", "function", "line", rule.alias("rule_id"), "what")

    hidden = shadowing(found, above).withColumn("what", F.col("variable"))
    flows = taint(found, above).withColumn("direct", F.col("hops") == 0)
    flows = flows.groupBy("doc_id", F.col("entry").alias("fn")).agg(F.bool_or("direct").alias("direct"), F.min_by("entry_param", F.struct("hops", "entry_param")).alias("what"))
    parts = [
        hit(hidden, F.when(F.col("function").isNull(), "sol-shadowing").otherwise("sol-local-shadowing")),
        hit(mutable_payments(found, uses).join(places, ["doc_id", "fn"]).withColumn("what", F.col("variable")), F.lit("sol-mutable-payment")),
        hit(plaintext_moves(found, uses).join(places, ["doc_id", "fn"]).withColumn("what", F.col("variable")), F.lit("sol-plaintext-move")),
        hit(flows.join(places, ["doc_id", "fn"]), F.when(F.col("direct"), "sol-taint-direct").otherwise("sol-taint-flow")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    of = F.create_map(*[F.lit(x) for k, v in CROSS_RULES.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in CROSS_RULES.items() for x in (k, v[1])]), F.create_map(*[F.lit(x) for k, v in CROSS_RULES.items() for x in (k, v[2])])
    return rows.select("doc_id", "function", "line", "rule_id", "what", *[m[F.col("rule_id")].alias(n) for m, n in zip(of, ("category", "severity", "confidence"), strict=True)])
