"""Reachability, inheritance, interfaces, taint and word-list runs on fixtures."""

import re
import time

from pyspark.sql import functions as F

from auditspark.functions import code, source
from auditspark.operators import reach


def test_visibility(spark):
    rows = [("vyper", "@external\ndef f():"), ("vyper", "@internal\ndef f():"), ("move", "public entry fun f()"), ("clarity", "(define-private (f))"), ("func", "() f()")]
    out = reach.visibility_reach(spark.createDataFrame(rows, "lang string, signature string")).collect()
    assert [(r["reach"], r["declared"]) for r in out] == [("reachable", "open"), ("unknown", "closed"), ("reachable", "open"), ("unknown", "closed"), ("unknown", "none")]


def test_corroborate(spark):
    a = spark.createDataFrame([(1, "not_reachable"), (2, "not_reachable"), (3, "unknown"), (4, "not_reachable")], "node long, verdict string")
    b = spark.createDataFrame([(1, "reachable"), (2, "not_reachable"), (3, "unknown")], "node long, verdict string")
    assert {r["node"]: r["verdict"] for r in reach.corroborate(a, b).collect()} == {1: "reachable", 2: "not_reachable", 3: "unknown", 4: "not_reachable"}


def test_bases_over_lines(spark):
    """Bases on lines of their own, with arguments and qualified."""
    df = spark.createDataFrame([(1, "contract A is\n    B,\n\tlib.C,\r\n  D(1, x)\n{ }"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["contract"], r["base"]) for r in reach.inheritance_edges(df).collect()} == {(1, "A", "B"), (1, "A", "lib.C"), (1, "A", "D")}


def test_inheritance_and_interfaces(spark):
    text = "contract A is B, C(1) { IERC20 token; function f() { token.transfer(a, 1); IPair(pair).sync(); } } interface D is E {}"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {(r["contract"], r["base"]) for r in reach.inheritance_edges(df).collect()} == {("A", "B"), ("A", "C"), ("D", "E")}
    assert reach.external_interfaces(df).collect()[0]["calls"] == ["IERC20.transfer", "IPair.sync"]


def test_taint(spark):
    entries = spark.createDataFrame([("f", "open", 0), ("f", "open", 1)], "file string, fn string, param int")
    calls = spark.createDataFrame([("f", "open", 1, "mid", 0), ("f", "mid", 0, "deep", 2), ("f", "deep", 2, "mid", 0)], "file string, caller string, caller_param int, callee string, callee_param int")
    sinks = spark.createDataFrame([("f", "deep", 2, "send")], "file string, fn string, param int, sink string")
    out = [tuple(r) for r in reach.taint_flows(entries, calls, sinks).collect()]
    assert out == [("f", "open", 1, "deep", "send", 2)]
    st = spark.createDataFrame([(1, "g", None, "a", False), (1, "g", "b", "a", False), (1, "g", "c", "b", False), (1, "g", "d", "c", True)], "doc_id long, fn string, target string, source string, killed boolean")
    assert {r["name"] for r in reach.local_influence(st).collect()} == {"a", "b", "c"}


def test_assignments(spark):
    """Later values, killed values, loops, chains longer than six, and the caller."""
    chain = "a0 = x; " + " ".join(f"a{i} = a{i - 1};" for i in range(1, 9))
    rows = [
        (1, "f", "function f(uint x, address to) public", "{ uint y = x * 2; z = y + 1; y = bal[x]; }", ["bal"]),
        (1, "g", "function g(uint x) public", "{ y = x + total; who = msg.sender; x = 1; if (y == x) { } s = 'x'; }", ["total"]),
        (2, "h", "function h(uint x) public", "{ while (a) { v = w; w = x; } }", []),
        (2, "k", "function k(uint x) public", "{ " + chain + " }", []),
        (3, "n", None, None, []),
    ]
    f = spark.createDataFrame(rows, "doc_id long, name string, signature string, body string, state array<string>")
    found = {}
    for r in reach.local_influence(code.assignments(f)).where("not contains(name, '#')").collect():
        found.setdefault((r["fn"], r["param"]), set()).add(r["name"])
    assert found["f", "x"] == {"x", "z"} and found["f", "to"] == {"to"}
    assert found["g", "x"] == {"x"} and found["g", "msg.sender"] == {"msg.sender", "who"}
    assert found["h", "x"] == {"x", "v", "w"}
    assert found["k", "x"] == {"x", *(f"a{i}" for i in range(9))}
    assert {k for k in found if k[0] == "n"} == {("n", "msg.sender")}


def test_bodies_are_read_once(spark):
    """What assignments are read from is written without bodies, once."""
    files = spark.createDataFrame([(1, "function f(uint x) public { y = x; z = y; }", "solidity")], "doc_id long, text string, lang string")
    out = code.assignments(code.extract_functions(files).withColumn("state", F.array().cast("array<string>")))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["target"], r["source"]) for r in out.where("target IS NOT NULL").collect()} == {("y#0", "x"), ("z#1", "y#0"), ("y", "y#0"), ("z", "z#1")}


def test_strings_are_leapt_over():
    """Reading a file costs a small part of reading its strings letter by letter."""
    long = "some words of prose " * 200_000
    text = f'contract C {{ string s = "{long}{long}"; function f(uint x) public {{ y = x; }} }}'
    letters = re.compile(r'"(?:[^"\\\n]|\\.)*+"?')

    def least(run):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        return min(took)

    slow = least(lambda: letters.sub("", text))
    assert least(lambda: list(source._parse(text))) < 2 * slow
    assert least(lambda: list(code.functions_of(text, "solidity"))) < slow
    assert [f["name"] for c in source._parse(text) for f in c["functions"]] == ["f"]


def test_mnemonic(spark):
    words = [f"w{chr(97 + i)}" for i in range(14)]
    df = spark.createDataFrame([(1, "seed: " + " ".join(words) + " end"), (2, " ".join(words[:11])), (3, None)], "doc_id long, text string")
    out = reach.mnemonic_scan(df, spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert [(r["doc_id"], r["length"]) for r in out] == [(1, 14)]


def test_mnemonic_inside_a_row(spark):
    """A short list costs no shuffle; a longer one finds the same runs."""
    words = [f"w{chr(97 + i)}" for i in range(14)]
    run = " ".join(words)
    texts = [run, f"- {run}, no {run} {run}", f"{run} 7", "", None, "no", f"{' '.join(words[:11])} no {run}", run.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = spark.createDataFrame([(w,) for w in [*words, "", words[0]]], "word string")
    inside, joined = reach.mnemonic_scan(df, listed), reach.mnemonic_scan(df, listed, list_words=13)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    found = sorted(map(tuple, inside.collect()))
    assert found == sorted(map(tuple, joined.collect())) == [(0, 0, 14), (1, 1, 14), (1, 16, 28), (2, 0, 14), (6, 12, 14)]
    assert inside.dtypes == joined.dtypes == [("doc_id", "bigint"), ("start", "int"), ("length", "bigint")]


def test_tiers(spark):
    df = spark.createDataFrame([("a", "free", i) for i in range(5)] + [("b", "team", i) for i in range(5)], "k string, tier string, i int")
    assert reach.tier_limit(df, {"free": 2, "team": -1}, "k", F.col("tier"), ["i"]).count() == 7
