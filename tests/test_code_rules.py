"""Each rule fires on its own example and stays silent on a mended one."""

import pytest

from auditspark.operators.code_rules import CODE_RULES, CodeRule, scan_code

P8, P4 = "pragma solidity 0.8.19;\n", "pragma solidity 0.4.24;\n"
CASES = [
    ("solidity", "sol-reentrancy", P8 + 'contract C { function w(uint a) public { (bool ok,) = msg.sender.call{value: a}(""); require(ok); bal[msg.sender] -= a; } }', P8 + 'contract C { function w(uint a) public nonReentrant { (bool ok,) = msg.sender.call{value: a}(""); require(ok); bal[msg.sender] -= a; } }'),
    ("solidity", "sol-unguarded-role", P8 + "contract C { address owner; function setFee(uint f) public { fee = f; } }", P8 + "contract C { address owner; function setFee(uint f) public onlyOwner { fee = f; } }"),
    ("solidity", "sol-tx-origin", P8 + "contract C { function f() public { require(tx.origin == owner); } }", P8 + "contract C { function f() public { require(msg.sender == owner); } }"),
    ("solidity", "sol-selfdestruct", P8 + "contract C { function k() public { selfdestruct(payable(msg.sender)); } }", P8 + "contract C { function k() public onlyOwner { selfdestruct(payable(msg.sender)); } }"),
    ("solidity", "sol-open-init", P8 + "contract C { function initialize(address o) public { owner = o; } }", P8 + "contract C { function initialize(address o) public initializer { owner = o; } }"),
    ("solidity", "sol-randomness", P8 + "contract C { function r() public { uint w = block.timestamp % 7; } }", P8 + "contract C { function r() public { uint w = block.timestamp + 7; } }"),
    ("solidity", "sol-spot-oracle", P8 + "contract C { function p() public { pair.getReserves(); } }", P8 + "contract C { function p() public { pair.twap(); } }"),
    ("solidity", "sol-signature-replay", P8 + "contract C { function s() public { ecrecover(h, v, r, s); } }", P8 + "contract C { bytes32 DOMAIN_SEPARATOR; function s() public { ecrecover(h, v, r, s); } }"),
    ("solidity", "sol-default-visibility", P4 + "contract C { function f() { x = 1; } }", P4 + "contract C { function f() public { x = 1; } }"),
    ("solidity", "sol-floating-pragma", "pragma solidity ^0.8.0;\ncontract C {}", P8 + "contract C {}"),
    ("solidity", "sol-balance-equality", P8 + "contract C { function f() public { if (address(this).balance == 1) x = 1; } }", P8 + "contract C { function f() public { if (address(this).balance >= 1) x = 1; } }"),
    ("solidity", "sol-fixed-gas", P8 + "contract C { function f() public { a.call{gas: 2300}(b); } }", P8 + "contract C { function f() public { a.call(b); } }"),
    ("vyper", "vy-reentrancy", "def w(a: uint256):\n    raw_call(msg.sender, b'', value=a)\n    self.bal[msg.sender] -= a\n", "def w(a: uint256):\n    self.bal[msg.sender] -= a\n    raw_call(msg.sender, b'', value=a)\n"),
    ("move", "move-missing-acquires", "fun f() { borrow_global<T>(a); }", "fun f() acquires T { borrow_global<T>(a); }"),
    ("clarity", "clar-open-set", "(define-public (f) (var-set x 1))", "(define-public (f) (begin (asserts! (is-eq tx-sender o) e) (var-set x 1)))"),
    ("solana", "sola-account-info", "pub a: AccountInfo<'info>", "#[account(has_one = owner)] pub a: AccountInfo<'info>"),
    ("ts-sdk", "ts-zero-slippage", "swap({ amountOutMin: 0 })", "swap({ amountOutMin: quote })"),
    ("cosmwasm", "cw-sender", "use cosmwasm_std::X; S.save(deps, &x)", "use cosmwasm_std::X; if info.sender != o {} S.save(deps, &x)"),
]


def test_cases(spark):
    rows = []
    for i, (lang, _, bad, good) in enumerate(CASES):
        rows += [(2 * i, bad, lang), (2 * i + 1, good, lang)]
    hits = {(r["doc_id"], r["rule_id"]) for r in scan_code(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, (_, rule, _, _) in enumerate(CASES):
        assert (2 * i, rule) in hits, rule
        assert (2 * i + 1, rule) not in hits, rule


def test_comments_do_not_count(spark):
    df = spark.createDataFrame([(1, "// selfdestruct(x)\ncontract C { function f() public { /* tx.origin require( */ } }", "solidity"), (2, None, "solidity")], "doc_id long, text string, lang string")
    assert scan_code(df).count() == 0


def test_patterns_compile(spark):
    df = spark.createDataFrame([(1, "x", r) for r in sorted({r.language for r in CODE_RULES})], "doc_id long, text string, lang string")
    scan_code(df).collect()
    assert len({r.rule_id for r in CODE_RULES}) == len(CODE_RULES)


@pytest.mark.parametrize("scope", ["F", "D"])
def test_own_rule(spark, scope):
    rule = CodeRule("own", "solidity", scope, "x", "LOW", 0.5, (("all", "magic"),))
    df = spark.createDataFrame([(1, "contract C { function f() public { magic(); } }", "solidity")], "doc_id long, text string, lang string")
    assert [r["rule_id"] for r in scan_code(df, (rule,)).collect()] == ["own"]


def test_functions_stay_in_the_row_of_their_file(spark):
    """Nothing is joined to functions, so texts are not shuffled and files without an id,
    or with one id, keep their own facts."""
    fee = "contract C { address owner; function setFee(uint f) public { fee = f; } }"
    rows = [(None, fee, "solidity"), (1, fee, "solidity"), (1, fee.replace("owner", "other"), "solidity"), (2, P4 + "contract C { function f() { x = 1; } }", "solidity"), (3, None, None)]
    hits = scan_code(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    found = [(r["doc_id"], r["function"], r["rule_id"]) for r in hits.collect()]
    assert sorted(found, key=str) == [(1, "setFee", "sol-unguarded-role"), (2, "f", "sol-default-visibility"), (None, "setFee", "sol-unguarded-role")]
