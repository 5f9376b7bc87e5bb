"""Verdicts from the source of versions: renamed, reshuffled, moved, guarded, changed and back again."""

import random

from auditspark.operators import verdicts

HEAD = "pragma solidity ^0.8.0;\ncontract Bank {\n  mapping(address => uint) held;\n  uint rate;\n  address chief;\n"
IN = "  function put() external payable { held[msg.sender] += msg.value; }\n"
WEAK = '  function {0}(uint {1}) external {{\n    require(held[msg.sender] >= {1}, "low");\n    (bool done,) = msg.sender.call{{value: {1}}}("");\n    require(done, "no");\n    held[msg.sender] -= {1};\n  }}\n'
MIXED = '  function {0}(uint {1}) external {{\n    (bool done,) = msg.sender.call{{value: {1}}}("");\n    require(held[msg.sender] >= {1}, "low");\n    require(done, "no");\n    held[msg.sender] -= {1};\n  }}\n'
SAFE = '  function {0}(uint {1}) external {{\n    require(held[msg.sender] >= {1}, "low");\n    held[msg.sender] -= {1};\n    (bool done,) = msg.sender.call{{value: {1}}}("");\n    require(done, "no");\n  }}\n'
OPEN = "  function setRate(uint r) external {\n    rate = r;\n  }\n"
SHUT = "  function setRate(uint r) external onlyOwner {\n    rate = r;\n  }\n"
SLIP = "  function setRateNow(uint r) external {\n    rate = r;\n  }\n"
SUM = "  function {0}(uint n) external pure returns (uint) {{\n    uint cut = n * 3 / 1000;\n    return cut;\n  }}\n"
SUM2 = '  function {0}(uint n) external pure returns (uint) {{\n    require(n > 0, "none");\n    uint cut = n * 5 / 1000;\n    require(cut <= n, "much");\n    return cut;\n  }}\n'
A, B = "src/Bank.sol", "src/Till.sol"


def file(*functions):
    return HEAD + "".join(functions) + "}\n"


#: repository: kind, name, versions (path to text), verdicts, where the function is at the end
CASES = {
    "reshuffled": ("reentrancy", "take", [{A: file(IN, WEAK.format("take", "n"))}, {A: file(IN, MIXED.format("payOut", "sum"))}, {A: file(IN, SAFE.format("payOut", "sum"))}], ["STILL OPEN", "BAND-AID", "FIXED"], (A, "payOut")),
    "renamed": ("reentrancy", "take", [{A: file(IN, WEAK.format("take", "n"))}, {A: file(WEAK.format("takeFunds", "amount"), IN)}], ["STILL OPEN", "STILL OPEN"], (A, "takeFunds")),
    "moved": ("reentrancy", "take", [{A: file(IN, WEAK.format("take", "n"))}, {A: file(IN), B: file(WEAK.format("payOut", "sum"))}, {A: file(IN), B: file(SAFE.format("payOut", "sum"))}], ["STILL OPEN", "STILL OPEN", "FIXED"], (B, "payOut")),
    "guarded": ("access-control", "setRate", [{A: file(IN, OPEN)}, {A: file(IN, SHUT)}], ["STILL OPEN", "FIXED"], (A, "setRate")),
    "half guarded": ("access-control", "setRate", [{A: file(IN, OPEN)}, {A: file(IN, SHUT, SLIP)}], ["STILL OPEN", "BAND-AID"], (A, "setRate")),
    "generic": ("generic", "fee", [{A: file(SUM.format("fee"))}, {A: file(SUM.format("feeOf"))}, {A: file(SUM2.format("feeOf"))}, {A: file(SUM.format("feeOf"))}], ["STILL OPEN", "STILL OPEN", "FIXED", "REGRESSED"], (A, "feeOf")),
    "deleted": ("reentrancy", "take", [{A: file(IN, WEAK.format("take", "n"))}, {A: file(IN)}], ["STILL OPEN", "FIXED"], (None, None)),
    "copied": ("reentrancy", "take", [{A: file(WEAK.format("take", "n"))}, {A: file(SAFE.format("take", "n"), WEAK.format("other", "n"))}], ["STILL OPEN", "BAND-AID"], (A, "take")),
    "later": ("reentrancy", "take", [{A: file(IN)}, {A: file(IN, WEAK.format("take", "n"))}, {A: file(IN, WEAK.format("take", "n"))}], ["STILL OPEN", "STILL OPEN"], (A, "take")),
    "never": ("reentrancy", "take", [{A: file(IN)}], [], None),
}


def test_verdicts_from_source(spark):
    findings = [(repo, repo, kind, A, name) for repo, (kind, name, *_) in CASES.items()]
    files = [(repo, v, path, text, "solidity") for repo, c in CASES.items() for v, version in enumerate(c[2], 1) for path, text in version.items()]
    random.Random(1).shuffle(files)  # their order does not matter
    out = verdicts.source_verdicts(spark.createDataFrame(findings, "finding string, repo string, kind string, path string, name string"), spark.createDataFrame(files, "repo string, version int, path string, text string, lang string")).orderBy("finding", "version").collect()
    for repo, (_, _, versions, wanted, at) in CASES.items():
        rows = [r for r in out if r["finding"] == repo]
        assert [r["verdict"] for r in rows] == wanted, repo
        assert [r["version"] for r in rows] == list(range(len(versions) - len(wanted) + 1, len(versions) + 1))
        assert not at or (rows[-1]["path"], rows[-1]["name"]) == at, repo


def test_no_versions(spark):
    findings = spark.createDataFrame([("f", "r", "generic", A, "x")], "finding string, repo string, kind string, path string, name string")
    assert verdicts.source_verdicts(findings, spark.createDataFrame([], "repo string, version int, path string, text string, lang string")).count() == 0
