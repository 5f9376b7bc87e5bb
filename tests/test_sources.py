"""Tool reports, audit reports and code on hand-written fixtures."""

import json

from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.operators import ingest
from auditspark.sources import tool_reports as tr


def reports(spark, *values):
    return spark.createDataFrame([("t", json.dumps(v) if not isinstance(v, str) else v) for v in values], "target string, value string")


def hits(df):
    return [r.asDict() for r in df.collect()]


def test_slither(spark):
    d = {"results": {"detectors": [
        {"check": "Reentrancy-Eth", "impact": "High", "confidence": "High", "description": "d", "markdown": "see SWC-107", "elements": [{"type": "contract", "name": "C"}, {"type": "function", "name": "withdraw", "source_mapping": {"filename_relative": "a.sol", "lines": [3, 4]}}]},
        {"check": "naming", "impact": "Informational", "confidence": "Low", "elements": []},
    ]}}
    a, b = sorted(hits(tr.normalize("slither", reports(spark, d, "not json"))), key=lambda r: r["category"], reverse=True)
    assert (a["file"], a["line"], a["function"], a["severity"], a["swc_id"], a["confidence"]) == ("a.sol", 3, "withdraw", "HIGH", "SWC-107", 0.8)
    assert (b["file"], b["severity"], b["confidence"]) == ("", "INFO", 0.5)


def test_other_tools(spark):
    aderyn = {"issues": [{"title": "Bad Thing", "impact": "High", "details": "x", "instances": [{"path": "a", "line": "7"}, {"path": "b", "line": "?"}]}, {"title": "None", "instances": []}]}
    found = hits(tr.normalize("aderyn", reports(spark, aderyn)))
    assert sorted((r["category"], r["file"], r["line"]) for r in found) == [("bad-thing", "a", 7), ("bad-thing", "b", 0), ("none", "", 0)]
    mythril = {"issues": [{"title": "Integer Overflow", "severity": "High", "swc-id": "101", "lineno": 5, "function": "f", "filename": "m.sol"}]}
    m = hits(tr.normalize("mythril", reports(spark, mythril)))[0]
    assert (m["swc_id"], m["severity"], m["category"], m["confidence"]) == ("SWC-101", "HIGH", "integer-overflow", 0.7)
    semgrep = {"results": [{"check_id": "a.b.rule", "path": "p", "start": {"line": 2}, "extra": {"severity": "ERROR", "message": "m"}}, {"check_id": "c", "path": "q"}]}
    assert sorted((r["category"], r["severity"]) for r in hits(tr.normalize("semgrep", reports(spark, semgrep)))) == [("c", "MEDIUM"), ("rule", "HIGH")]
    echidna = {"issues": [{"contract": "C", "function": "g", "bug": "b"}]}
    assert hits(tr.normalize("echidna", reports(spark, echidna)))[0]["confidence"] == 0.95
    npm = {"vulnerabilities": {"left-pad": {"severity": "high", "url": "u"}}}
    assert hits(tr.normalize("npm-audit", reports(spark, npm)))[0]["title"] == "left-pad"
    cargo = {"vulnerabilities": {"list": [{"advisory": {"severity": "high", "title": "T", "description": "d"}}]}}
    assert hits(tr.normalize("cargo-audit", reports(spark, cargo)))[0]["severity"] == "HIGH"


def test_flatten_report(spark):
    nested = {"targets": [{"target": "a", "findings": [{"category": "x"}, {"category": "y", "target": "own"}]}]}
    flat = {"target": "b", "findings": [{"category": "z"}]}
    found = sorted((r["target"], r["category"]) for r in hits(tr.flatten_report(reports(spark, nested, flat))))
    assert found == [("a", "x"), ("b", "z"), ("own", "y")]


def test_chain_logs(spark):
    good = {"address": "0xAB", "topics": ["t"], "data": "0x", "blockNumber": "0x10", "transactionHash": "h"}
    found = hits(tr.read_chain_logs(reports(spark, good, {"address": "0x1", "blockNumber": "zz"}, "broken")))
    assert [(r["address"], r["block_number"]) for r in found] == [("0xab", 16)]


def test_dependencies(spark):
    rows = [
        ("r/.gitmodules", "[submodule]\n path = x\n url = https://github.com/a/b\n"),
        ("r/package.json", '{"dependencies": {"a": "^1.0", "b": "git+https://github.com/c/d.git#v1", "e": "github:f/g"}}'),
        ("r/Cargo.toml", 'x = { git = "https://github.com/h/i" }'),
        ("r/Scarb.toml", 'y = { github = "j/k" }'),
        ("r/remappings.txt", "@x=https://github.com/l/m\n"),
    ]
    found = [r["url"] for r in tr.manifest_dependencies(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert found == sorted(["https://github.com/a/b", "https://github.com/c/d.git", "https://github.com/f/g", "https://github.com/h/i", "https://github.com/j/k", "https://github.com/l/m"], key=str.lower)


def test_audit_ingest(spark):
    text = "# Report\n\n## [H-01] Reentrancy in withdraw (High)\n\nThe function withdraw( in src/Vault.sol sends first.\n\n- list\n\n## Notes\nThis may be vulnerable: see `sweep(`.\n\n## M-2 Missing check\nMedium. Text.\n\n## Nothing\nAll fine here.\n\n## Gas\nlow impact\n"
    found = {r["id"]: r for r in ingest.audit_ingest(spark.createDataFrame([("r", text)], "report string, text string")).collect()}
    h = found["H-01"]
    assert (h["title"], h["severity"], h["files"], h["functions"], h["confidence"]) == ("Reentrancy in withdraw", "HIGH", ["src/Vault.sol"], ["withdraw"], 0.95)
    assert found["M-02"]["severity"] == "MEDIUM"
    assert found["FINDING-01"]["severity"] == "LOW" and found["FINDING-01"]["confidence"] == 0.3
    assert found["FINDING-02"]["title"] == "Gas" and len(found) == 4


def test_canonical(spark):
    rows = [("f", "function f(uint a) { b = a; // x\n emit E(\"s\"); }", "g", "function g(uint c) { d = c; emit E(\"other\"); }"), ("f", "{ a = 1; b = 2; }", "f", "{ b = 2; a = 1; }"), ("f", "{ a = 1; }", "f", "{ a  =  1; }"), ("f", "{ a = 1; }", "f", "{ a = 1; c(); }"), ("f", "{ a = 1; }", "f", "{ a = b + 1; }")]
    df = spark.createDataFrame(rows, "n string, o string, m string, w string")
    kinds = [r["k"] for r in df.select(code.change_kind(F.col("n"), F.col("o"), F.col("m"), F.col("w")).alias("k")).collect()]
    assert kinds[0] == "renamed" and kinds[2] == "identical" and kinds[3] == "grown" and kinds[4] == "changed"


def test_functions_and_properties(spark):
    source = """
    // function no(){}
    contract C {
      function bad(uint a) external {
        msg.sender.call{value: a}("");
        balance[msg.sender] = 0;
      }
      function good(uint a) external nonReentrant { balance[msg.sender] = 0; msg.sender.call{value: a}(""); }
      function decl(uint a) external;
      function owner() public onlyOwner { x = 1; }
    }"""
    df = spark.createDataFrame([(1, source, "solidity"), (2, "def f(a):\n    return a\n\ndef g():\n    pass\nx = 1\n", "vyper"), (3, None, "solidity")], "doc_id long, text string, lang string")
    f = code.extract_functions(df)
    names = {(r["doc_id"], r["name"]) for r in f.collect()}
    assert names == {(1, "bad"), (1, "good"), (1, "owner"), (2, "f"), (2, "g")}
    p = {r["name"]: (r["r"], r["a"]) for r in f.where("doc_id = 1").select("name", code.reentrancy_vulnerable(F.col("body")).alias("r"), code.access_vulnerable(F.col("signature"), F.col("body")).alias("a")).collect()}
    assert p["bad"] == (True, True) and p["owner"] == (False, False) and p["good"][0] is False
