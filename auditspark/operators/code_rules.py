"""Rule catalog for source code: conditions on facts of functions and documents.

Facts are taken from a text once: the names it calls, the words it uses, what it
assigns, what it assigns after value left, what its conditions test and what they
compare for equality.  A rule is a condition on facts, written from the description
of a weakness; names in rules are those of the languages and of token and proxy
standards.  All rules of a scan are expressions of one plan; the functions table is
made once per file and no rule shuffles.

Patterns are read in linear time: a run of unbounded length begins only at its left
end (a look-behind) and gives nothing back (``++``, ``*+``), or it is bounded.  Rules
across functions and contracts are in ``contracts``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions.code import function_list
from auditspark.functions.source import clean_code
from auditspark.shipping import ship

# Weakness numbers of the categories.
SWC = {
    "reentrancy": "SWC-107", "access-control": "SWC-115", "oracle-manipulation": "SWC-120", "arithmetic": "SWC-101", "randomness": "SWC-120", "signature-replay": "SWC-122", "tx-origin": "SWC-115",
    "unprotected-init": "SWC-105", "proxy-upgrade": "SWC-105", "unchecked-external-call": "SWC-104", "selfdestruct": "SWC-106", "delegatecall": "SWC-112", "unlimited-approval": "SWC-114", "slippage": "SWC-108",
    "denial-of-service": "SWC-113", "front-running": "SWC-114", "floating-pragma": "SWC-103", "deprecated": "SWC-111", "uninitialized-storage": "SWC-109", "timestamp-dependence": "SWC-116",
    "arbitrary-storage-write": "SWC-124", "hash-collision": "SWC-133", "private-data": "SWC-136", "default-visibility": "SWC-100", "rtl-override": "SWC-130", "shadowing": "SWC-119", "hardcoded-gas": "SWC-134",
    "strict-balance-equality": "SWC-132", "signature-malleability": "SWC-117", "typographical-error": "SWC-129",
}

# Names of Solidity and of its token and proxy standards.
_PAYING = ("call", "transfer", "send", "safeTransfer")
_LOW_LEVEL = ("call", "delegatecall")
_DYNAMIC = r"\b(?:string|bytes)\b|\[\]"
#: First words of names that change who holds what, or how a contract runs; and names of the ones in charge.
_POWERS = "set change replace configure assign pause resume unpause freeze stop mint burn issue withdraw drain collect recover sweep upgrade migrate grant revoke transferOwnership".split()
_IN_CHARGE = ("owner", "admin", "governance", "operator", "manager", "governor", "controller")

_NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
_LEFT = r"(?<![A-Za-z0-9_])"
_TARGET = rf"({_NAME})(?:\.{_NAME}|\[[^\[\]]*+\]){{0,32}}+\s*+[-+*/|&]?=(?![=>])"


def facts(text: Column, around: Column) -> dict[str, Column]:
    """Facts of a text; ``around`` is the same with its signature."""
    listed = lambda pattern, of=text, group=1: F.array_distinct(F.regexp_extract_all(of, F.lit(pattern), F.lit(group)))
    paid = F.regexp_extract(text, r"(?s)(?:\.(?:call|delegatecall|callcode)\b|\braw_call\s*+\()(.*)$", 1)
    after = F.regexp_extract(paid, r"(?s)^[^;\n]*+[;\n](.*)$", 1)
    return {
        "calls": listed(rf"{_LEFT}({_NAME})\s*+(?:\{{[^{{}}]*+\}}\s*+)?\("),
        "words": listed(_NAME, around, 0),
        "assigned": listed(r"(?<![=!<>.A-Za-z0-9_])(?:self\.)?" + _TARGET),
        "late": listed(_LEFT + r"(?:self\.)?" + _TARGET, after),
        "tests": F.array_join(F.regexp_extract_all(text, F.lit(r"\b(?:require|assert|if|while|asserts!)\b([^;{}\n]*)"), F.lit(1)), "\n"),
        "equal": F.when(F.contains(text, F.lit("==")), F.array_join(F.regexp_extract_all(text, F.lit(r"(?<![^\s=!<>&|;{},])[^\s=!<>&|;{},]++\s*+==\s*+[^\s=&|;{},]++"), F.lit(0)), "\n")).otherwise(""),
        "unused": F.regexp_extract_all(text, F.lit(r"(?:^|[;{}])\s*+[\w.\[\]]+(?:\([^();]*\))?\.(call|delegatecall|send)\b"), F.lit(1)),
        "loop": F.regexp_extract(text, r"(?s)\b(?:for|while)\s*\((.*)$", 1),
    }


class Facts:
    """What a rule's condition asks."""

    def __init__(self, texts: dict[str, Column]):
        self.texts = texts

    def has(self, where: str, pattern: str) -> Column:
        return self.texts[where].rlike(pattern)

    def _any(self, where: str, names) -> Column:
        return F.arrays_overlap(self.texts[where], F.array(*[F.lit(x) for x in names]))

    def calls(self, *names: str) -> Column:
        return self._any("calls", names)

    def uses(self, *names: str) -> Column:
        return self._any("words", names)

    def file_uses(self, *names: str) -> Column:
        return self._any("file_words", names)

    def assigns(self) -> Column:
        return F.size(self.texts["assigned"]) > 0

    def before(self, minor: int) -> Column:
        """Written for a compiler before 0.``minor``."""
        return F.coalesce(self.texts["minor"] < minor, F.lit(False))

    @property
    def guarded(self) -> Column:
        """A modifier by the naming convention, or a test of the caller."""
        return F.regexp_extract(self.texts["head"], r"(?s)\)(.*)$", 1).rlike(r"\b(?:only|auth|requires|when)[A-Z_]?\w*") | self.texts["tests"].contains("msg.sender")

    @property
    def pays(self) -> Column:
        return self.calls(*_PAYING)

    @property
    def open(self) -> Column:
        return ~self.has("head", r"\b(?:internal|private|view|pure)\b")


@dataclass(frozen=True)
class CodeRule:
    """``has`` must hold and ``lacks`` must not: functions of ``Facts``, or pairs of
    a text (name, head, body, all, file, raw, tests, equal, loop) and a pattern."""

    rule_id: str
    language: str
    scope: str  # F: per function, D: per document
    category: str
    severity: str
    confidence: float
    has: tuple
    lacks: tuple = ()


_When = Callable[[Facts], Column]


def _f(rule_id: str, category: str, severity: str, confidence: float, when: _When, language: str = "solidity") -> CodeRule:
    return CodeRule(rule_id, language, "F", category, severity, confidence, (when,))


def _d(rule_id: str, category: str, severity: str, confidence: float, when: _When, language: str = "solidity") -> CodeRule:
    return CodeRule(rule_id, language, "D", category, severity, confidence, (when,))


def _unless(language: str, rule_id: str, category: str, severity: str, confidence: float, uses: str, unless: str = "") -> CodeRule:
    """A document that uses one word of ``uses`` and none of ``unless``."""
    return _d(rule_id, category, severity, confidence, lambda f: f.uses(*uses.split()) & (~f.uses(*unless.split()) if unless else F.lit(True)), language)


CODE_RULES = (
    _f("sol-reentrancy", "reentrancy", "HIGH", 0.8, lambda f: (F.size(f.texts["late"]) > 0) & ~f.uses("nonReentrant")),
    _f("sol-unchecked-call", "unchecked-external-call", "MEDIUM", 0.7, lambda f: f._any("unused", _LOW_LEVEL) & ~f.guarded),
    _f("sol-unchecked-send", "denial-of-service", "MEDIUM", 0.65, lambda f: f._any("unused", ("send",)) & ~f.guarded),
    _f("sol-send-in-loop", "denial-of-service", "MEDIUM", 0.7, lambda f: f.has("loop", r"\.(?:send|transfer|call)\b")),
    _f("sol-growth-loop", "denial-of-service", "MEDIUM", 0.65, lambda f: f.has("loop", r"^[^{]*\.length\b") & f.has("loop", r"\.push\s*\(") & ~f.guarded),
    _f("sol-unguarded-role", "access-control", "HIGH", 0.85, lambda f: f.has("name", f"^(?:{'|'.join(_POWERS)})(?![a-z])") & f.file_uses(*_IN_CHARGE) & f.open & ~f.guarded),
    _f("sol-take-ownership", "access-control", "HIGH", 0.85, lambda f: f._any("taken", _IN_CHARGE) & ~f.guarded & ~f.has("name", r"(?i)^(?:constructor|init\w*)$")),
    _f("sol-spot-oracle", "oracle-manipulation", "HIGH", 0.8, lambda f: f.calls("getReserves") | (f.calls("latestRoundData") & ~f.uses("updatedAt"))),
    _f("sol-first-deposit", "arithmetic", "HIGH", 0.8, lambda f: f.has("equal", r"(?i)total(?:shares|supply)\W*==\s*0")),
    _f("sol-round-trip", "arithmetic", "MEDIUM", 0.6, lambda f: f.has("body", r"\*\s*total\w+(?:\(\))?\s*/\s*total\w+")),
    _f("sol-divide-first", "arithmetic", "MEDIUM", 0.6, lambda f: f.has("body", r"/\s*+[\w.]++\s*+\)*+\s*+\*(?!\*)\s*+[\w(]")),
    _f("sol-pre8-unchecked", "arithmetic", "HIGH", 0.7, lambda f: f.before(8) & f.has("body", r"[-+*]=\s*\w|=[^=;]*\w\s*+[-+*]\s*+\w") & ~f.has("tests", "[<>]") & ~f.calls("add", "sub", "mul") & ~f.file_uses("SafeMath")),
    _f("sol-randomness", "randomness", "HIGH", 0.85, lambda f: f.calls("blockhash") | (f.has("body", r"\bblock\.\w+|\bnow\b") & f.uses("timestamp", "number", "difficulty", "prevrandao", "now") & f.has("body", "%"))),
    _f("sol-preimage", "front-running", "HIGH", 0.75, lambda f: f.has("equal", r"keccak256|sha3|sha256") & f.pays),
    _f("sol-claim-race", "front-running", "HIGH", 0.65, lambda f: f.has("name", r"(?i)claim|redeem|solve") & f.has("tests", r"!\s*\w") & f.pays & ~f.guarded),
    _f("sol-signature-replay", "signature-replay", "MEDIUM", 0.7, lambda f: f.calls("ecrecover") & ~f.file_uses("chainid", "DOMAIN_SEPARATOR", "nonces")),
    _f("sol-signature-malleable", "signature-malleability", "MEDIUM", 0.7, lambda f: f.calls("ecrecover") & ~f.file_uses("ECDSA") & ~f.has("tests", r"\bs\b")),
    _f("sol-tx-origin", "tx-origin", "HIGH", 0.8, lambda f: f.has("tests", r"\btx\.origin\b")),
    _f("sol-open-init", "unprotected-init", "HIGH", 0.85, lambda f: f.has("name", "^initialize$") & ~f.has("all", "(?i)initializer|initializing|initialized")),
    _f("sol-selfdestruct", "selfdestruct", "CRITICAL", 0.8, lambda f: f.calls("selfdestruct", "suicide") & ~f.guarded),
    _f("sol-delegatecall", "delegatecall", "HIGH", 0.7, lambda f: f.calls("delegatecall") & ~f.guarded),
    _f("sol-deprecated", "deprecated", "LOW", 0.9, lambda f: f.calls("suicide", "sha3", "callcode") | f.has("body", r"\bthrow\s*;|\bmsg\.gas\b|\bblock\.blockhash\b")),
    _f("sol-storage-pointer", "uninitialized-storage", "HIGH", 0.7, lambda f: f.before(5) & f.has("body", r"(?:^|[;{}])\s*[A-Z]\w*(?:\s+storage)?\s+\w+\s*;")),
    _f("sol-sstore", "arbitrary-storage-write", "HIGH", 0.65, lambda f: f.has("body", r"\bsstore\s*\(\s*[a-zA-Z_]\w*\s*,")),
    _f("sol-packed-hash", "hash-collision", "MEDIUM", 0.7, lambda f: f.calls("encodePacked") & f.calls("keccak256") & (F.size(F.regexp_extract_all(f.texts["head"], F.lit(_DYNAMIC), F.lit(0))) >= 2)),
    _f("sol-fixed-gas", "hardcoded-gas", "LOW", 0.8, lambda f: f.has("body", r"\bgas\s*[:(]\s*\d")),
    _f("sol-typo", "typographical-error", "MEDIUM", 0.6, lambda f: f.has("body", r"[\w\])]\s*=[+!](?!=)\s*\w")),
    _f("sol-short-address", "short-address", "MEDIUM", 0.6, lambda f: f.before(5) & f.has("head", r"\(\s*address\b[^)]{0,500},\s*uint") & f.assigns() & ~f.uses("data") & ~f.guarded),
    _f("sol-approve-race", "front-running", "MEDIUM", 0.7, lambda f: f.has("name", "^approve$") & f.file_uses("transferFrom") & f.assigns() & ~f.has("tests", r"[=!]=\s*0")),
    _f("sol-default-visibility", "default-visibility", "LOW", 0.85, lambda f: f.before(5) & f.has("head", "^function") & ~f.has("head", r"\b(?:public|private|internal|external)\b")),
    _f("sol-payout", "uncontrolled-payout", "HIGH", 0.7, lambda f: f.has("head", r"\b(?:public|external)\b") & f._any("paid", ("amount", "_amount", "value", "_value", "wad", "sum")) & ~f.has("tests", "[<>]") & ~f.has("body", "-=") & ~f.guarded),
    _d("sol-floating-pragma", "floating-pragma", "LOW", 0.9, lambda f: f.has("file", r"pragma\s+solidity\s*+[^;]{0,200}[\^><]")),
    _d("sol-rtl", "rtl-override", "HIGH", 0.95, lambda f: f.has("raw", chr(0x202E))),
    _d("sol-private-data", "private-data", "LOW", 0.6, lambda f: f.has("file", r"(?i)\bprivate\s++(?=\w*(?:password|secret|seed|mnemonic))\w++\s*+[;=]")),
    _d("sol-balance-equality", "strict-balance-equality", "MEDIUM", 0.75, lambda f: f.has("equal", r"this\)?\.balance")),
    _d("sol-timestamp", "timestamp-dependence", "MEDIUM", 0.7, lambda f: f.has("equal", r"block\.timestamp|\bnow\b")),
    _d("sol-open-proxy", "proxy-upgrade", "CRITICAL", 0.85, lambda f: f.uses("fallback") & f.uses("delegatecall") & f.has("file", r"function\s+upgrade\w*+\s*+\([^)]{0,500}\)\s*(?:public|external)\s*\{")),
    _f("vy-reentrancy", "reentrancy", "HIGH", 0.8, lambda f: f.calls("raw_call") & (F.size(f.texts["late"]) > 0), "vyper"),
    _f("vy-unguarded-role", "access-control", "HIGH", 0.8, lambda f: f.has("name", f"^(?:{'|'.join(_POWERS)})(?![a-z])") & ~f.has("tests", r"msg\.sender"), "vyper"),
    _f("vy-unchecked-transfer", "unchecked-external-call", "LOW", 0.5, lambda f: f.calls("transfer", "approve") & ~f.uses("assert"), "vyper"),
    _unless("move", "move-missing-acquires", "missing-acquires", "MEDIUM", 0.6, "borrow_global borrow_global_mut", "acquires"),
    _d("move-copy-struct", "access-control", "MEDIUM", 0.6, lambda f: f.has("file", r"struct\s+\w+\s+has\b[^{]{0,300}\bcopy\b"), "move"),
    _unless("move", "move-unchecked-take", "denial-of-service", "LOW", 0.5, "move_from", "exists"),
    _unless("cairo", "cairo-handler-replay", "signature-replay", "MEDIUM", 0.6, "l1_handler", "nonce consumed processed"),
    _d("cairo-randomness", "randomness", "MEDIUM", 0.6, lambda f: f.uses("get_block_timestamp") & f.has("file", "%"), "cairo"),
    _d("clar-tx-sender", "access-control", "MEDIUM", 0.6, lambda f: f.has("file", r"is-eq\s+tx-sender"), "clarity"),
    _d("clar-panic", "denial-of-service", "MEDIUM", 0.5, lambda f: f.has("file", r"\(unwrap(?:-err)?-panic\b"), "clarity"),
    _d("clar-open-set", "access-control", "MEDIUM", 0.6, lambda f: f.has("file", r"\((?:var|map)-set\s") & ~f.has("file", "tx-sender|contract-caller"), "clarity"),
    _unless("func", "func-bounce", "denial-of-service", "MEDIUM", 0.6, "send_raw_message send_message", "bounced is_bounced bounce"),
    _d("func-sender", "access-control", "HIGH", 0.7, lambda f: f.uses("recv_internal") & f.uses("send_raw_message", "set_data") & ~f.uses("sender_address", "sender", "equal_slices"), "func"),
    _d("func-parse", "arithmetic", "LOW", 0.4, lambda f: f.uses("load_uint") & ~f.uses("end_parse"), "func"),
    _unless("solana", "sola-account-info", "access-control", "HIGH", 0.7, "AccountInfo", "has_one constraint seeds owner"),
    _unless("solana", "sola-lamports", "arithmetic", "MEDIUM", 0.6, "try_borrow_mut_lamports"),
    _unless("solana", "sola-unsigned-write", "access-control", "HIGH", 0.7, "set_inner try_borrow_mut_data", "Signer is_signer"),
    _d("ts-zero-slippage", "slippage", "HIGH", 0.7, lambda f: f.has("file", r"(?i)\b(?=\w*min)(?=\w*out)\w++\s*+[:=]\s*+0\b"), "ts-sdk"),
    _d("ts-unlimited-approval", "unlimited-approval", "MEDIUM", 0.7, lambda f: f.uses("approve") & f.uses("MaxUint256", "maxUint256", "MAX_UINT256"), "ts-sdk"),
    _d("ts-key", "secret-leak", "CRITICAL", 0.8, lambda f: f.has("file", r"[\"'`](?:0x)?[0-9a-fA-F]{64}[\"'`]") & f.has("file", r"(?i)private_?key|mnemonic"), "ts-sdk"),
    _d("ts-random", "randomness", "HIGH", 0.7, lambda f: f.has("file", r"\bMath\.random\b") & f.has("file", r"(?i)nonce|salt|seed|secret"), "ts-sdk"),
    _d("huff-unchecked", "unchecked-external-call", "HIGH", 0.6, lambda f: f.uses("call", "delegatecall", "staticcall") & ~f.uses("iszero", "jumpi"), "huff"),
    _unless("huff", "huff-selfdestruct", "selfdestruct", "CRITICAL", 0.8, "selfdestruct"),
    _d("yul-unchecked", "unchecked-external-call", "HIGH", 0.6, lambda f: f.has("file", r"\bpop\s*\(\s*\w*call\s*\("), "yul"),
    _d("ink-caller", "access-control", "HIGH", 0.6, lambda f: f.uses("ink") & f.has("file", r"self\.(?:owner|admin)\s*=(?!=)") & ~f.uses("caller"), "ink"),
    _d("cw-sender", "access-control", "HIGH", 0.6, lambda f: f.uses("entry_point", "cosmwasm_std") & f.uses("save", "update") & ~f.has("file", r"\binfo\.sender\b"), "cosmwasm"),
    _d("sub-origin", "access-control", "HIGH", 0.6, lambda f: f.uses("pallet", "decl_module") & f.uses("call", "origin") & ~f.uses("ensure_signed", "ensure_root", "ensure_origin"), "substrate"),
    _d("go-panic", "denial-of-service", "MEDIUM", 0.5, lambda f: f.uses("panic") & f.uses("BeginBlock", "EndBlock", "BeginBlocker", "EndBlocker", "Keeper"), "go"),
    _d("scilla-sender", "access-control", "HIGH", 0.6, lambda f: f.has("file", r"(?i)transition\s+(?:set|update|change)") & ~f.uses("_sender", "_origin"), "scilla"),
    _unless("michelson", "mich-sender", "access-control", "MEDIUM", 0.6, "SET_DELEGATE TRANSFER_TOKENS", "SENDER SOURCE"),
    _d("wat-grow", "denial-of-service", "LOW", 0.5, lambda f: f.has("file", r"memory\.grow"), "webassembly"),
)
_EXTRA: list[CodeRule] = []


def register_rules(rules: list[CodeRule]) -> None:
    """Add own rules to every later scan."""
    _EXTRA.extend(rules)


def _fires(rule: CodeRule, asked: Facts) -> Column:
    out = F.col("lang") == rule.language
    for wanted, conditions in ((True, rule.has), (False, rule.lacks)):
        for c in conditions:
            holds = c(asked) if callable(c) else asked.has(*c)
            out = out & (holds if wanted else ~holds)
    return out


def _rows(rules, asked: Facts) -> Column:
    found = []
    for r in rules:
        row = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).cast("double").alias("confidence"), F.lit(SWC.get(r.category)).alias("swc_id"))
        found.append(F.when(_fires(r, asked), row))
    return F.explode(F.array_compact(F.array(*found)))


def scan_code(files: DataFrame, rules: tuple[CodeRule, ...] | None = None) -> DataFrame:
    """Hits of the catalog on files (doc_id, text, lang): function (null for
    document rules), line, rule_id, category, severity, confidence, swc_id."""
    rules = tuple(rules or CODE_RULES) + tuple(_EXTRA)
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = files.select("doc_id", "lang", text.alias("raw"), clean_code(text, F.col("lang")).alias("file"))
    minor = F.regexp_extract("file", r"pragma\s+solidity[^0-9;]{0,100}0\.(\d{1,4})", 1).try_cast("int")
    clean = clean.select("*", F.array_distinct(F.regexp_extract_all("file", F.lit(_NAME), F.lit(0))).alias("file_words"), minor.alias("minor"))
    parts = []
    documents = [r for r in rules if r.scope == "D"]
    if documents:
        d = clean.select("*", *[c.alias(k) for k, c in facts(F.col("file"), F.col("file")).items()])
        known = {k: F.col(k) for k in (*facts(F.col("file"), F.col("file")), "file", "raw", "file_words", "minor")} | dict.fromkeys(("name", "head", "body", "all"), F.col("file"))
        x = d.select("doc_id", F.lit(None).cast("string").alias("function"), F.lit(1).alias("line"), _rows(documents, Facts(known)).alias("r"))
        parts.append(x.select("doc_id", "function", "line", "r.*"))
    functions = [r for r in rules if r.scope == "F"]
    if functions:
        ship(files.sparkSession)
        f = clean.select("*", F.explode(function_list("file", "lang")).alias("f")).select("*", "f.*")
        f = f.withColumn("all", F.concat_ws(" ", "signature", "body"))
        own = facts(F.col("body"), F.col("all")) | {
            "taken": F.regexp_extract_all("body", F.lit(rf"{_LEFT}({_NAME})\s*+=\s*+(?:payable\s*\(\s*)?msg\.sender\b"), F.lit(1)),
            "paid": F.regexp_extract_all("body", F.lit(rf"(?:transfer|send|safeTransfer)\s*+\((?:[^;]{{0,300}},)?\s*({_NAME})\s*+\)"), F.lit(1)),
        }
        f = f.select("*", *[c.alias(k) for k, c in own.items()])
        known = {k: F.col(k) for k in (*own, "name", "body", "all", "file", "raw", "file_words", "minor")} | {"head": F.col("signature")}
        x = f.select("doc_id", F.col("name").alias("function"), F.col("first_line").alias("line"), _rows(functions, Facts(known)).alias("r"))
        parts.append(x.select("doc_id", "function", "line", "r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
