"""Costs that must not grow faster than the input."""

import difflib
import os
import random
import time

from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.operators import locate, roles, verdicts
from auditspark.operators.rules import TEXT_RULES, scan_documents


def _docs(spark, texts):
    return spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_rules_with_words_are_their_patterns(spark):
    """Words and look-behinds change no hit, also where a word begins a text or touches a letter."""
    hit = "a1b2c3d4e5f6a7b8c9"
    texts = [None, "", f"token = {hit}", f"my_token = {hit}", f"mytoken = {hit}", f"é token: '{hit}", f"(secret={hit}", f"\npassword={hit}", "token", "idiot", "idiots", "xidiot", "an idiot.", "\U0001f600idiot", "a@b.cc", "@b.cc", "a | b | c | d | e | f | g"]
    docs = _docs(spark, texts)
    plain = F.coalesce("text", F.lit(""))
    for rule in TEXT_RULES:
        wanted = {r.doc_id for r in docs.where(plain.rlike(rule.pattern)).collect()}
        assert {r.doc_id for r in scan_documents(docs, (rule,)).collect()} == wanted, rule.rule_id


def test_rules_read_documents_fast(spark):
    """25 MB of documents in one task: no choice of groups at every letter."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scan_documents(docs.limit(1)).count()
    began = time.time()
    scan_documents(docs).count()
    assert time.time() - began < 8


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_like_forms_write_no_pairs(spark, monkeypatch):
    """Forms of like letters in any order, in tiles of a few: all pairs compared, none but
    alike ones written, and the likest ones are those of all pairs."""
    rng = random.Random(3)
    texts = sorted({"".join(rng.sample("abcdefgh" * 2, 16)) + "é" * rng.randrange(3) for _ in range(400)})
    rows = lambda xs: spark.createDataFrame([(x, x) for x in xs], "form string, canon string")
    monkeypatch.setattr(locate, "TILE_FORMS", 70, raising=False)
    want = {(a, b): s for a in texts[::4] for b in texts if (s := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.7}
    folder = spark.conf.get("spark.checkpoint.dir")
    before = _bytes(folder)
    assert {(r.a_form, r.b_form): r.score for r in locate.like_forms(rows(texts[::4]), rows(texts), 0.7).collect()} == want
    assert _bytes(folder) - before < 100_000
    top = {a: max(s for (x, _), s in want.items() if x == a) for a, _ in want}
    best = locate.like_forms(rows(texts[::4]), rows(texts), 0.7, best=True).collect()
    assert {(r.a_form, r.b_form) for r in best if r.score == top[r.a_form]} == {p for p, s in want.items() if s == top[p[0]]}


def test_verdicts_broadcast_no_table(spark, monkeypatch):
    """Tables of functions are small in a file and large in the driver."""
    plans, write = [], locate.written
    keep = lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1]
    monkeypatch.setattr(verdicts, "written", keep)
    code = "contract A { mapping(address => uint) held; function take(uint n) external { msg.sender.call{value: n}(\"\"); held[msg.sender] -= n; } }"
    files = spark.createDataFrame([(r, v, "a.sol", code, "solidity") for r in range(3) for v in (1, 2)], "repo long, version int, path string, text string, lang string")
    findings = spark.createDataFrame([(r, r, "reentrancy", "a.sol", "take") for r in range(3)], "finding long, repo long, kind string, path string, name string")
    out = verdicts.source_verdicts(findings, files)
    assert {(r.finding, r.version, r.verdict) for r in out.collect()} == {(r, v, "STILL OPEN") for r in range(3) for v in (1, 2)}
    for plan in (*plans, out._jdf.queryExecution().executedPlan().toString()):
        assert "cogroup" in plan.lower() or "Broadcast" not in plan, plan  # bands of forms are some dozens


def test_texts_of_a_batch_are_few_at_a_time(spark, monkeypatch):
    """Functions of a batch are given in small batches, and long strings are blanked fast."""
    body = "s = '" + "word " * 200_000 + "';"
    began = time.time()
    assert [f[0] for f in code.braced_functions(f"function f() {{ {body} }}")] == ["f"]
    assert time.time() - began < 0.15
    sizes = code.extract_functions(spark.range(300).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("function f() { a; }").alias("text"), F.lit("solidity").alias("lang")))
    assert sizes.count() == 300


def test_role_map_makes_its_text_once(spark):
    files = spark.createDataFrame([(1, "contract C { address Owner; uint fee; function setFee(uint f) public { fee = f; } } // coffee", "solidity"), (2, "coffee", "solidity"), (3, None, "solidity")], "doc_id long, text string, lang string")
    made = files.select("doc_id", F.sha2("text", 512).alias("h"), F.concat(F.reverse(F.reverse("text"))).alias("text"), "lang").drop("h")
    out = roles.role_map(made)
    assert [(r.doc_id, r.function, r.guarded, r.roles) for r in out.collect()] == [(1, "setFee", False, ["owner", "fee"])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") <= 6
