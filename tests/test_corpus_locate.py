"""File corpora and function location on fixtures."""

import difflib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.operators import locate
from auditspark.sources import corpus

BODY = "{ uint share = amount * total / supply; balance[msg.sender] = balance[msg.sender] - amount; total = total - share; emit Sent(msg.sender, share); token.transfer(msg.sender, share); }"


def test_read_corpus(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.sol").write_text("contract A {}\nline 2")
    (tmp_path / "src" / "a.t.sol").write_text("contract T {}")
    (tmp_path / "src" / "b.rs").write_text("use cosmwasm_std::x;")
    (tmp_path / "src" / "big.sol").write_text("x" * 2000)
    (tmp_path / "src" / "n.txt").write_text("no")
    (tmp_path / "node_modules" / "c.sol").write_text("contract C {}")
    files = corpus.tag_language(corpus.read_corpus(spark, str(tmp_path), max_bytes=1000))
    found = {r["path"].rpartition("/")[2]: (r["lang"], r["text"]) for r in files.collect()}
    assert found == {"a.sol": ("solidity", "contract A {}\nline 2"), "b.rs": ("cosmwasm", "use cosmwasm_std::x;")}


def test_framework(spark):
    rows = [("r", "r/foundry.toml", None), ("r", "r/a.sol", "pragma solidity ^0.8.0;"), ("s", "s/hardhat.config.ts", ""), ("q", "q/x", None)]
    out = {r["repo"]: (r["framework"], r["pragmas"]) for r in corpus.detect_framework(spark.createDataFrame(rows, "repo string, path string, text string")).collect()}
    assert out == {"r": ("foundry", ["^0.8.0"]), "s": ("hardhat", []), "q": ("unknown", [])}


def test_locate(spark):
    wanted = [(1, "a.sol", "f", BODY), (2, "a.sol", "g", BODY.replace("share", "part")), (3, "a.sol", "h", "{ one(); two(); three(); }"), (4, "a.sol", "k", BODY.replace("total - share", "total - share - fee")), (5, "a.sol", "z", "{ nothing = like; this; }")]
    now = [("a.sol", "f", "{ changed(); }"), ("b.sol", "moved", BODY.replace("amount", "value")), ("c.sol", "p", "{ three(); one(); two(); }")]
    out = locate.locate(spark.createDataFrame(wanted, "id long, path string, name string, body string"), spark.createDataFrame(now, "path string, name string, body string"))
    found = {r["id"]: (r["name"], r["stage"]) for r in out.collect()}
    assert found[1] == ("f", 1) and found[2] == ("moved", 3) and found[4] == ("moved", 5)
    assert 5 not in found


def test_generic(spark):
    rows = [("x", 1, "A", True), ("x", 2, "B", False), ("x", 3, "A", False), ("y", 1, "A", False)]
    out = locate.generic_vulnerable(spark.createDataFrame(rows, "finding string, version int, canon string, marked boolean"))
    assert {(r["finding"], r["version"]): r["vulnerable"] for r in out.collect()} == {("x", "1"): True, ("x", "2"): False, ("x", "3"): True, ("y", "1"): False}


def test_statements(spark):
    """Headers of any depth stay whole; strings and comments cut nothing."""
    bodies = ["{ for (uint i = f(1); i < g(h(k(n(2)))); i++) { a(); } b = 'x;y'; // c;\n d({e: 1}); }", "", None, "((((((((((((;)))))))))))); a", ") ; ( ;"]
    out = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", code.statements(F.col("body")).alias("s"))
    assert [r["s"] for r in out.orderBy("i").collect()] == [
        ["for (uint i = f(1); i < g(h(k(n(2)))); i++)", "a()", "b = STR", "d({e: 1})"], [], [], ["((((((((((((;))))))))))))", "a"], [")", "( ;"],
    ]



def test_statements_few_texts_at_a_time():
    """A batch is handed over in parts, and pieces of parentheses cut as single marks do."""
    r = random.Random(4)
    bodies = [None, *("".join(r.choice("(((()))){};; ab\n'\"/*") for _ in range(r.randint(0, 60))) for _ in range(5000))]
    parts = list(code.statements.func(iter([pa.array(bodies, pa.string())])))
    assert max(len(p) for p in parts) <= code.FEW

    def plain(text):
        depth, start, out, text = 0, 0, [], code._STRING.sub("STR", code._COMMENT.sub(" ", text))
        for at, c in enumerate(text):
            if c in "()":
                depth = depth + 1 if c == "(" else max(0, depth - 1)
            elif c in "{};" and not depth:
                out.append(text[start:at])
                start = at + 1
        return [" ".join(x.split()) for x in [*out, text[start:]] if x.split()]

    assert [x for p in parts for x in p.to_pylist()] == [plain(b or "") for b in bodies]

def _bodies(rng, n):
    """Bodies of code in families of edits, and copies."""
    words = "a b owner total price msg sender require return if for uint x y z + - * / == < > ( ) ; { } [ ] , .".split()
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60]))]
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    return out[:n]


def test_like_forms_equal_all_pairs(spark):
    """The join on prefixes loses no pair: every pair compared, on short and long forms."""
    rng = random.Random(8)
    forms = sorted(set(_bodies(rng, 120)))
    wanted, known = forms[::3], forms
    rows = lambda xs: spark.createDataFrame([(f"{i:04}", x) for i, x in enumerate(xs)], "form string, canon string")
    for like in (0.8, 0.6):
        got = {(r["a_form"], r["b_form"]): r["score"] for r in locate.like_forms(rows(wanted), rows(known), like).collect()}
        want = {(f"{i:04}", f"{j:04}"): s for i, a in enumerate(wanted) for j, b in enumerate(known) if (s := 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()) >= like}
        assert got == want


def test_locate_equals_a_loop(spark):
    rng = random.Random(9)
    bodies = _bodies(rng, 90)
    current = [(f"p{rng.randrange(6)}", f"f{rng.randrange(40)}", b) for b in bodies[:60]]
    wanted = [(i, f"p{rng.randrange(6)}", f"f{rng.randrange(40)}" if rng.random() < 0.3 else f"g{i}", b) for i, b in enumerate(bodies[30:])]
    wdf, cdf = spark.createDataFrame(wanted, "id long, path string, name string, body string"), spark.createDataFrame(current, "path string, name string, body string")
    got = {r["id"]: (r["path"], r["name"], r["stage"], r["score"]) for r in locate.locate(wdf, cdf).collect()}
    known = locate.prepared(cdf).collect()
    asked = {r["path"]: r for r in locate.prepared(wdf.select(F.col("id").cast("string").alias("path"), "name", "body")).collect()}
    for i, path, name, _ in wanted:
        w, hits = asked[str(i)], []
        for c in known:
            stages = [(1, c["path"] == path and c["name"] == name), (2, c["name"] == name), (3, c["canon"] == w["canon"]), (4, c["parts"] == w["parts"] and len(w["parts"]) >= 3)]
            hits += [(s, -1.0, c["path"], c["name"]) for s, ok in stages if ok]
            score = difflib.SequenceMatcher(None, w["canon"], c["canon"]).ratio() if w["canon"] and c["canon"] else 0.0
            hits += [(5, -score, c["path"], c["name"])] if score >= 0.8 else []
        best = min(hits, default=None)
        assert got.get(i) == (best and (best[2], best[3], best[0], -best[1])), i


def test_a_form_with_many_copies(spark):
    copies = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("f").alias("name"), F.lit("{ a = b + 1; return a; }").alias("body"))
    wanted = spark.createDataFrame([(1, "q", "g", "{ a = b + 2; return a; }"), (2, "q", "h", "{ x = y + 1; return x; }"), (3, "q", "f", "")], "id long, path string, name string, body string")
    out = {r["id"]: (r["path"], r["stage"]) for r in locate.locate(wanted, copies).collect()}
    assert out == {1: ("p0", 5), 2: ("p0", 3), 3: ("p0", 2)}


def test_locate_nothing(spark):
    wanted = spark.createDataFrame([(1, "q", "g", None)], "id long, path string, name string, body string")
    assert locate.locate(wanted, spark.createDataFrame([], "path string, name string, body string")).count() == 0
