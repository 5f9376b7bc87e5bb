"""Code read by its language, and rules across functions and contracts."""

import time

import pytest
from pyspark.sql import functions as F

from auditspark.functions import source
from auditspark.operators import contracts
from auditspark.operators.code_rules import scan_code
from auditspark.operators.rules import scan_documents
from auditspark.operators.secrets import secret_scan

FILES = "doc_id long, text string"

CLEAN = [
    ("solidity", 'string u = "http://x/*y*/"; // gone "\nuint a; /* one\ntwo */ uint b; /**/ c', 'string u = "http://x/*y*/"; \nuint a; \n uint b;   c'),
    ("solidity", "a /* never ends\nb\n", "a \n\n"),
    ("solidity", "x = 'it\\'s // no'; // yes", "x = 'it\\'s // no'; "),
    ("solana", "fn f<'a>(x: &'a str) { let c = '\"'; /* z */ } // e", "fn f<'a>(x: &'a str) { let c = '\"';   } "),
    ("vyper", 'x = "#no"  # yes\ny = """# kept\n"""\n# z', 'x = "#no"  \ny = """# kept\n"""\n'),
    ("clarity", '(f ";; no") ;; yes\n; (g)', '(f ";; no") \n; (g)'),
    ("func", '{- a\nb -} int x; ;; yes\n{ int y; }', '\n int x; \n{ int y; }'),
    ("scilla", "(* a\n* b *) transition t () (x)\nend", "\n transition t () (x)\nend"),
    ("michelson", "# a\nPUSH string \"# b\"; /* c */", "\nPUSH string \"# b\";  "),
    ("webassembly", "(; a ;) (func) ;; b", "  (func) "),
    ("go", "s := `// kept`\n// gone", "s := `// kept`\n"),
    ("ts-sdk", "const u = `http://${x}`; // gone", "const u = `http://${x}`; "),
    ("move", "x = b\"a//b\"; // c", "x = b\"a//b\"; "),
    ("other", "a // b", "a // b"),
]


def test_clean_code(spark):
    rows = [(i, text, lang) for i, (lang, text, _) in enumerate(CLEAN)] + [(99, None, "solidity")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["clean"] for r in df.select("doc_id", source.clean_code(F.col("text"), F.col("lang")).alias("clean")).collect()}
    for i, (lang, text, clean) in enumerate(CLEAN):
        assert out[i] == clean, (lang, text)
        assert out[i].count("\n") == text.count("\n")
    assert out[99] == ""


TAINT = [  # text, functions that are hit and how
    ("function w(uint x) public { uint y = x * 2; (bool ok,) = msg.sender.call{value: y}(\"\"); }", {("w", "sol-taint-direct")}),
    ("function w(uint x) public { _mid(x); } function _mid(uint a) internal { _end(a); } function _end(uint v) internal { (bool ok,) = msg.sender.call{value: v}(\"\"); }", {("w", "sol-taint-flow")}),
    ("function w(uint x) public { uint y = x + 1; payable(msg.sender).transfer(y); }", {("w", "sol-taint-direct")}),
    ("function w(address zed, uint amt) public { _pay(amt, zed); } function _pay(uint b, address a) internal { payable(a).transfer(b); }", {("w", "sol-taint-flow")}),
    ("function w(address zed, uint amt) public { _pay(7, amt); } function _pay(uint b, uint c) internal { payable(msg.sender).transfer(b); }", set()),
    ("mapping(address => uint) bals; function w(uint amount) external { uint bal = bals[msg.sender]; if (amount > bal) revert(); (bool ok,) = msg.sender.call{value: amount}(\"\"); }", set()),
    ("mapping(address => uint) d; function w(uint _amount) external { require(d[msg.sender] >= _amount, \"x\"); (bool ok,) = msg.sender.call{value: _amount}(\"\"); }", set()),
    ("uint totalAssets; uint totalShares; function w(uint share) external { uint amount = share * totalAssets / totalShares; (bool ok,) = msg.sender.call{value: amount}(\"\"); }", set()),
    ("mapping(address => uint) balances; function w() external { uint amount = balances[msg.sender]; (bool ok,) = msg.sender.call{value: amount}(\"\"); }", set()),
    ("function fwd(address t) public payable { (bool ok,) = t.call{value: msg.value}(\"\"); }", set()),
    ("function sweep(address to, uint amount) external onlyOwner { (bool ok,) = to.call{value: amount}(\"\"); }", set()),
    ("function m(address from, address to, uint256 value, bytes calldata s) external payable { bytes32 h = keccak256(abi.encodePacked(from, to, value)); require(ecrecover(h, _v(s), _r(s), _r(s)) == from, \"x\"); (bool ok,) = to.call{value: value}(\"\"); } function _v(bytes calldata s) internal pure returns (uint8) { return uint8(s[64]); } function _r(bytes calldata s) internal pure returns (bytes32) { return bytes32(s); }", set()),
    ("function w(uint x) public { uint y = x * 2; y = y < 100 ? y : 100; (bool ok,) = msg.sender.call{value: y}(\"\"); }", set()),
    ("function drain(address to, uint256 amount) external { (bool s,) = to.call{value: amount}(\"\"); }", {("drain", "sol-taint-direct")}),
    ("function a(uint x) public { b(x); } function b(uint x) public { c(x); } function c(uint x) internal { b(x); payable(msg.sender).send(x); }", {("a", "sol-taint-flow"), ("b", "sol-taint-flow")}),
    ("".join(f"function f{i}(uint x) {'public' if i == 0 else 'internal'} {{ f{i + 1}(x); }} " for i in range(9)) + "function f9(uint x) internal { payable(msg.sender).transfer(x); }", {("f0", "sol-taint-flow")}),
]


def hits(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), FILES)
    out = {i: set() for i in range(len(texts))}
    for r in contracts.scan_contracts(df).collect():
        out[r["doc_id"]].add((r["function"], r["rule_id"]))
    return out


def test_taint_on_source(spark):
    out = hits(spark, [f"pragma solidity 0.8.0; contract A {{ {text} }}" for text, _ in TAINT])
    for i, (text, wanted) in enumerate(TAINT):
        assert {h for h in out[i] if "taint" in h[1]} == wanted, text


def test_taint_through_inheritance(spark):
    """The nearest function of a name is meant, and a call of another arity is another function."""
    base = "contract B { function pay(uint x) internal virtual { payable(msg.sender).transfer(x); } function pay(uint x, uint y) internal { } } "
    one = base + "contract C is B { function go(uint n) public { pay(n); } }"
    two = base + "contract C is B { function pay(uint x) internal override { } function go(uint n) public { pay(n); } }"
    three = base + "contract C is B { function go(uint n) public { pay(n, n); } }"
    out = hits(spark, [one, two, three])
    assert [out[i] for i in range(3)] == [{("go", "sol-taint-flow")}, set(), set()]


ORDER = [
    ("uint price; function setPrice(uint p) external onlyOwner { price = p; } function buy() external { token.transferFrom(msg.sender, owner, price); }", {("buy", "sol-mutable-payment")}),
    ("uint price; function setPrice(uint p) external { require(msg.sender == owner); price = p; } function cash() public { payable(msg.sender).transfer(price); }", {("cash", "sol-mutable-payment")}),
    ("uint price; function setPrice(uint p) external { price = p; } function buy() external { token.transferFrom(msg.sender, owner, price); }", set()),  # nobody is in charge of it
    ("uint price; function initialize(uint p) external onlyOwner { price = p; } function buy() external { token.transferFrom(msg.sender, owner, price); }", set()),
    ("uint price; function setPrice(uint p) external onlyOwner { price = p; } function buy() external payable { require(msg.value >= price); }", set()),  # a bound, no amount
    ("uint price; function setPrice(uint price) external onlyOwner { price = price; } function buy() external { uint price = 3; payable(msg.sender).transfer(price); }", set()),  # locals
    ("uint price; function setPrice(uint p) external onlyOwner { price = p; } function take() external onlyOwner { payable(msg.sender).transfer(price); }", set()),
    ("struct P { address a; uint n; } mapping(uint => P) moves; function play(uint n) external payable { moves[count] = P(msg.sender, n); } function end() public { payable(moves[0].a).transfer(2); }", {("play", "sol-plaintext-move")}),
    ("mapping(address => uint) move; function play(uint n) external payable { move[msg.sender] = n; } function end() public { if (move[a] == 1) payable(a).transfer(2); }", {("play", "sol-plaintext-move")}),
    ("mapping(address => uint) move; function play(uint n) external { move[msg.sender] = n; } function end() public { if (move[a] == 1) payable(a).transfer(2); }", set()),  # not payable
    ("mapping(address => uint) move; function play(uint n) external payable { move[msg.sender] = n; } function end() public { payable(a).transfer(2); }", set()),  # not decided by it
    ("mapping(address => uint) move; function play(uint n) external payable { move[msg.sender] = n; } function end(uint s) public { require(keccak256(abi.encode(s)) == h); if (move[a] == 1) payable(a).transfer(2); }", set()),
]


def test_order_dependence(spark):
    out = hits(spark, [f"contract A {{ {text} }}" for text, _ in ORDER])
    for i, (text, wanted) in enumerate(ORDER):
        assert {h for h in out[i] if h[1] in ("sol-mutable-payment", "sol-plaintext-move")} == wanted, text


def test_state_of_bases_is_meant(spark):
    """Payments and writes meet in the contract that declares the variable, and in no other."""
    base = "contract B { uint price; function setPrice(uint p) external onlyOwner { price = p; } } "
    out = hits(spark, [base + "contract C is B { function buy() external { payable(msg.sender).transfer(price); } }", base + "contract C { uint price; function buy() external { payable(msg.sender).transfer(price); } }"])
    assert out == {0: {("buy", "sol-mutable-payment")}, 1: set()}


SHADOWS = [
    ("contract A { uint x; } contract B is A { } contract C is B { uint x; }", {(None, "C", "x", "A")}),
    ("contract A { uint x; } contract B is A { uint x; } contract C is B { uint x; }", {(None, "B", "x", "A"), (None, "C", "x", "B")}),
    ("contract T { uint x; } contract L is T { } contract R is T { uint y; } contract D is L, R { uint y; uint x; }", {(None, "D", "x", "T"), (None, "D", "y", "R")}),
    ("contract A { function f() public { uint x = 1; } } contract B is A { uint x; }", set()),  # a local of the base
    ("contract A { uint x; } contract B { uint x; }", set()),
    ("contract A is A { uint x; } contract B is C { uint x; } contract C is B { uint y; }", set()),
    ("contract A { uint x; mapping(address => mapping(uint => bool)) public seen; } contract B is A { bytes32 private constant seen = 1; struct S { uint x; } event E(uint x); }", {(None, "B", "seen", "A")}),
    ("contract A { uint x; function f(uint x) public { } function g() public { address[] memory x; } function h() public returns (uint y) { y = x; } }", {("f", "A", "x", "A"), ("g", "A", "x", "A")}),
    ("contract A { uint total; } contract B is A { function f() public returns (uint total) { total = 1; } }", {("f", "B", "total", "A")}),
]


def test_shadowing(spark):
    found = source.contracts(spark.createDataFrame(list(enumerate(t for t, _ in SHADOWS)), FILES))
    out = {i: set() for i in range(len(SHADOWS))}
    for r in contracts.shadowing(found, contracts.ancestors(found)).collect():
        out[r["doc_id"]].add((r["function"], r["contract"], r["variable"], r["declared_in"]))
    for i, (text, wanted) in enumerate(SHADOWS):
        assert out[i] == wanted, text


def test_def_use_index(spark):
    text = "contract A { uint a; uint[] b; mapping(uint => uint) c; function f(uint d) public { a += d; b.push(c[d]); delete c[a]; } function g() public { uint a = 1; c[a]++; emit X(b); } }"
    found = source.contracts(spark.createDataFrame([(1, text)], FILES))
    out = {(r["fn"].split("/")[0], r["variable"], r["use"]) for r in contracts.state_uses(found, contracts.ancestors(found)).collect() if r["use"] == "write"}
    assert out == {("A.f", "a", "write"), ("A.f", "b", "write"), ("A.f", "c", "write"), ("A.g", "c", "write")}


def test_no_contracts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "contract"), (4, "contract A { function f( {"), (5, "contract é { uint x; }")], FILES)
    assert contracts.scan_contracts(df).count() == 0


def test_lines_and_strings(spark):
    text = 'contract A {\n  /* b\n { */ string s = "} // {";\n  function f(uint v) public {\n    payable(msg.sender).transfer(v); } }'
    rows = contracts.scan_contracts(spark.createDataFrame([(1, text)], FILES)).collect()
    assert [(r["function"], r["line"], r["rule_id"]) for r in rows] == [("f", 4, "sol-taint-direct")]


LONG = {
    "one letter": "a" * 1_000_000,
    "alchemy": "https://" + "alchemy" * 140_000,
    "comparisons": "a==" * 330_000,
    "words": "x " * 500_000,
    "openings": "/*" * 500_000,
    "brackets": "a[" * 500_000,
    "calls": "send(" * 200_000,
    "links": "https://infura/" * 66_000,
    "quotes": "\"\\" * 500_000,
    "at signs": "a@" * 500_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_a_megabyte_takes_seconds(spark, name):
    """One text of 1 MB, alone and as a string of a contract."""
    text = LONG[name]
    docs = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    quoted = text.replace('"', "'")
    code = spark.createDataFrame([(1, f'contract C {{ function f(uint a) public {{ g("{quoted}"); {text} }} }}', "solidity")], "doc_id long, text string, lang string")
    small = spark.createDataFrame([(1, "a", "solidity")], "doc_id long, text string, lang string")
    runs = {"documents": lambda: scan_documents(docs).count(), "secrets": lambda: secret_scan(docs, "doc_id", "text").count(), "code": lambda: scan_code(code).count()}
    scan_code(small).count()  # plans and compiles the rules
    took = {}
    for k, run in runs.items():
        began = time.time()
        run()
        took[k] = time.time() - began
    assert took["documents"] < 2 and took["secrets"] < 2 and took["code"] < 10, took
