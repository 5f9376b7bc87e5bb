"""Code-shaped text: canonical statements, function bodies, properties.

Canonical forms are column expressions.  Only finding the extent of a function
needs a parser, which runs per file in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from auditspark.shared import written
from auditspark.shipping import ship

# Words of the language that renaming must not touch.
KEYWORDS = frozenset(
    "pragma solidity contract interface library abstract is using for function modifier constructor fallback receive returns return if else while do break continue "
    "uint uint8 uint16 uint32 uint64 uint128 uint256 int int8 int16 int32 int64 int128 int256 address bool string bytes bytes1 bytes2 bytes4 bytes8 bytes16 bytes32 "
    "mapping memory storage calldata external public internal private payable pure view virtual override immutable constant new delete emit require assert revert try catch "
    "true false this super self msg block tx abi unchecked assembly".split()
)
_PIECE = "[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_ \\t\\n\\r]"


def canonical(text: Column, own_name: Column | None = None) -> Column:
    """Identifiers as ID1, ID2 ... by first appearance, strings as STR, keywords kept."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)/\\*.*?\\*/", " "), "//[^\\n]*", " ")
    plain = F.regexp_replace(plain, "\"[^\"\\n]*\"|'[^'\\n]*'", " STR ")
    pieces = F.regexp_extract_all(plain, F.lit(_PIECE), F.lit(0))
    keep = F.array(*[F.lit(k) for k in sorted(KEYWORDS | {"STR"})])
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def rename(ps: Column) -> Column:
        names = F.array_except(F.array_distinct(F.filter(ps, lambda x: x.rlike("^[A-Za-z_]"))), keep)

        def one(x, ns):
            at = F.array_position(ns, x)
            own = F.when(x == own_name, F.lit("FN")) if own_name is not None else F.lit(None).cast("string")
            return F.coalesce(own, F.when(at > 0, F.concat(F.lit("ID"), at.cast("string"))).otherwise(x))

        return bind(names, lambda ns: F.transform(ps, lambda x: one(x, ns)))

    return F.array_join(bind(pieces, rename), " ")


# A string or a comment that does not end goes on to the end of its line or of the text,
# so that no place is read twice.
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+"
_SKIPPED = re.compile(rf"\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?|{_BLOCK}|//[^\n]*", re.S)
_SKIPPED_RUST = re.compile(rf"\"(?:[^\"\\]++|\\.)*+\"?|'(?:\\[^\n]|[^'\\\n])'|{_BLOCK}|//[^\n]*", re.S)
# Parentheses that close at most four deep are one piece; each place is read at most once a depth.
_CLOSED = r"\([^()]*+\)"
for _ in range(3):
    _CLOSED = rf"\((?:[^()]++|{_CLOSED})*+\)"
_CUT = re.compile(rf"{_CLOSED}|[(){{}};]")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_COMMENT = re.compile(rf"{_BLOCK}|//[^\n]*")


def _statements(text: str) -> list[str]:
    text = _STRING.sub("STR", _COMMENT.sub(" ", text))
    depth, start, out = 0, 0, []
    for m in _CUT.finditer(text):
        if m[0] in ("(", ")"):
            depth = depth + 1 if m[0] == "(" else max(0, depth - 1)
        elif not depth and m[0][0] != "(":
            out.append(text[start : m.start()])
            start = m.end()
    return [x for part in [*out, text[start:]] if (x := " ".join(part.split()))]


#: Texts of an Arrow batch that are Python objects at a time.
FEW = 64


@F.arrow_udf(ArrayType(StringType()))
def statements(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Coarse statements of a body without comments, strings as STR: cut at
    semicolons and braces outside of parentheses of any depth, in one pass."""
    for b in bodies:
        for at in range(0, len(b), FEW):
            yield pa.array([_statements(x or "") for x in b.slice(at, FEW).to_pylist()], pa.list_(pa.string()))


def statement_multiset(body: Column, own_name: Column | None = None) -> Column:
    return F.array_sort(F.transform(statements(body), lambda s: canonical(s, own_name)))


def change_kind(old_name: Column, old: Column, new_name: Column, new: Column) -> Column:
    """identical, renamed, reshuffled, grown or changed."""
    a, b = canonical(old, old_name), canonical(new, new_name)
    sa, sb = statement_multiset(old, old_name), statement_multiset(new, new_name)
    squeeze = lambda c: F.btrim(F.regexp_replace(c, "\\s+", " "))
    return F.when((old_name == new_name) & (squeeze(old) == squeeze(new)), "identical").when(a == b, "renamed").when(sa == sb, "reshuffled").when(F.size(F.array_except(sa, sb)) == 0, "grown").otherwise("changed")



def word_of(words: str, not_after: str) -> str:
    """One of some words that follows none of the characters ``not_after``.  It begins with
    its letters and looks back from behind the first, as Python leaps to letters only."""
    return "|".join(rf"{w[0]}(?<![{not_after}]{w[0]}){w[1:]}" for w in words.split("|"))


_HEAD = re.compile(rf"({word_of('function|modifier|constructor|fallback|receive', r'\w')})\b\s*([A-Za-z_]\w*)?\s*\(")
_PY_HEAD = re.compile(r"^([ \t]*)def\s+([A-Za-z_]\w*)\s*\(", re.M)
_SCHEMA = "doc_id long, name string, kind string, signature string, body string, first_line int, last_line int"


# How functions begin in languages with braces.
_HEADS = {
    "move": r"\b(fun)\s+([A-Za-z_]\w*)\s*(?:<[^>(]*>)?\s*\(",
    "rust": r"\b(fn)\s+([A-Za-z_]\w*)\s*(?:<[^>(]*>)?\s*\(",
    "go": r"\b(func)\s+(?:\([^()]*\)\s*)?([A-Za-z_]\w*)\s*\(",
    "huff": r"#define\s+(macro|fn)\s+([A-Za-z_]\w*)\s*\(",
    "yul": r"\b(function)\s+([A-Za-z_]\w*)\s*\(",
}
_HEADS |= dict.fromkeys(("solana", "cosmwasm", "ink", "substrate"), _HEADS["rust"])
_HEADS = {lang: re.compile(p) for lang, p in _HEADS.items()}
_SCILLA = re.compile(r"^[ \t]*(transition|procedure)[ \t]+([A-Za-z_]\w*)[^\n]*", re.M)


def _at_or_after(places: list[int], at: int, none: int) -> int:
    i = bisect_left(places, at)
    return places[i] if i < len(places) else none


def braced_functions(source: str, lang: str = "solidity"):
    """(name, kind, signature, body, first line, last line); comments are blanked, what
    strings hold is no bracket.  Brackets are matched once for the file, so time is
    linear in it."""
    skipped = _SKIPPED_RUST if _HEADS.get(lang) is _HEADS["rust"] else _SKIPPED
    blank = lambda m: "\n".join(" " * len(x) for x in m[0].split("\n"))
    text = skipped.sub(lambda m: blank(m) if m[0][0] == "/" else m[0], source)
    shape = skipped.sub(blank, source)
    lines = [m.start() for m in re.finditer("\n", text)]
    opens, ends, stack, closes = [], [m.start() for m in re.finditer(";", shape)], [], {}
    for m in re.finditer(r"[{}]", shape):
        if m[0] == "{":
            opens.append(m.start())
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.end()
    for m in _HEADS.get(lang, _HEAD).finditer(shape):
        opening, stop = _at_or_after(opens, m.end(), -1), _at_or_after(ends, m.end(), len(text))
        if opening < 0 or stop < opening:
            continue  # a declaration without a body
        at = closes.get(opening, len(text))
        yield m[2] or m[1], m[1], text[m.start() : opening].strip(), text[opening:at], bisect_left(lines, m.start()) + 1, bisect_left(lines, at) + 1


def ended_functions(source: str, lang: str = "scilla"):
    """Functions that go on to a line with ``end`` alone."""
    text = re.sub(r"\(\*.*?(?:\*\)|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    stops = [m.end() for m in re.finditer(r"^[ \t]*end[ \t]*$", text, re.M)]
    lines = [m.start() for m in re.finditer("\n", text)]
    for m in _SCILLA.finditer(text):
        at = _at_or_after(stops, m.end(), len(text))
        yield m[2], m[1], m[0].strip(), text[m.end() : at], bisect_left(lines, m.start()) + 1, bisect_left(lines, at) + 1


def indented_functions(source: str):
    """Functions that end before the next line that stands no deeper than their head."""
    lines = source.split("\n")
    breaks = [m.start() for m in re.finditer("\n", source)]
    depth = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    last_of, before, stack = {}, 0, []  # of lines not yet ended, the innermost last
    for n, d in enumerate([*depth, 0]):
        if d < 0:
            continue
        while stack and depth[stack[-1]] >= d:
            last_of[stack.pop()] = before
        if n < len(lines):
            stack.append(n)
            before = n + 1
    for m in _PY_HEAD.finditer(source):
        first = bisect_left(breaks, m.start()) + 1
        last = last_of.get(first - 1, first)
        yield m[2], "def", lines[first - 1].strip(), "\n".join(lines[first:last]), first, last


_INDENTED = ("vyper", "cairo", "python")


def functions_of(text: str, lang: str, indented: tuple[str, ...] = _INDENTED):
    """Functions of one text, by the way its language bounds them."""
    return indented_functions(text) if lang in indented else ended_functions(text) if lang == "scilla" else braced_functions(text, lang)


def extract_functions(files: DataFrame, indented: tuple[str, ...] = _INDENTED) -> DataFrame:
    """Functions of files (doc_id, text, lang)."""
    ship(files.sparkSession)

    def parse(batches):
        for b in batches:
            for at in range(0, b.num_rows, FEW):
                part, out = b.slice(at, FEW), []
                for i, text, lang in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    out += [(i, *f) for f in functions_of(text or "", lang, indented)]
                names = ["doc_id", "name", "kind", "signature", "body", "first_line", "last_line"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("doc_id", "text", "lang").mapInArrow(parse, _SCHEMA)


_COLUMNS = ["name", "kind", "signature", "body", "first_line", "last_line"]


@F.arrow_udf(ArrayType(StructType([StructField(n, IntegerType() if n.endswith("_line") else StringType()) for n in _COLUMNS])))
def function_list(files: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Rows of ``extract_functions`` inside the row of a text and its language, so that
    nothing has to be joined to them.  The caller sees to it that the package is shipped."""
    kind = pa.list_(pa.struct([(n, pa.int32() if n.endswith("_line") else pa.string()) for n in _COLUMNS]))
    for texts, langs in files:
        for at in range(0, len(texts), FEW):
            part = zip(texts.slice(at, FEW).to_pylist(), langs.slice(at, FEW).to_pylist(), strict=True)
            yield pa.array([[dict(zip(_COLUMNS, f, strict=True)) for f in functions_of(text or "", lang)] for text, lang in part], kind)


_SEND = "\\.call\\{|\\.call\\.value|\\.transfer\\(|\\.send\\("
_WRITE = "(?<![=!<>.A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)(?:\\[[^\\]]*\\])*\\s*[-+*/]?=(?!=)"


def reentrancy_vulnerable(body: Column) -> Column:
    """Sends value before its last write, and has no guard."""
    sends = body.rlike(_SEND)
    guarded = body.rlike("nonReentrant|ReentrancyGuard|_status|mutex|locked")
    after = F.regexp_extract(body, f"(?s)(?:{_SEND})(.*)$", 1)
    return sends & ~guarded & (after.rlike(_WRITE) | ~body.rlike(_WRITE))


def access_vulnerable(signature: Column, body: Column) -> Column:
    """Reachable from outside, moves value or writes, and checks no caller."""
    reachable = signature.rlike("\\b(public|external)\\b") & ~signature.rlike("\\b(view|pure)\\b")
    acts = body.rlike(_SEND) | body.rlike(_WRITE)
    guarded = F.concat_ws(" ", signature, body).rlike("onlyOwner|onlyRole|only[A-Z]|require\\s*\\(\\s*msg\\.sender|_checkOwner|_checkRole|hasRole|auth\\b")
    return reachable & acts & ~guarded


_DECLARED = "\\b(?:u?int\\d*|address|bool|string|bytes\\d*|mapping|[A-Z]\\w*)(?:\\[\\d*\\])*(?:\\s+(?:memory|storage|calldata|payable))*\\s+([A-Za-z_]\\w*)\\s*(?=[=;,)])"


def state_writes(function: Column) -> Column:
    """Names that a function (signature and body) assigns and does not declare."""
    written, declared = (F.regexp_extract_all(function, F.lit(p), F.lit(1)) for p in (_WRITE, _DECLARED))
    return F.array_except(written, declared)


# Calls that read balances.
_NO_VARIABLE = sorted(KEYWORDS | {"sender", "origin"})
_ASSIGNED = "(?<![A-Za-z0-9_$.])([A-Za-z_][A-Za-z0-9_]*)\\s*=(?!=)\\s*([^;{}]+);"
_CALLER = "msg.sender"
_FROM_STATE = "\\[|balanceOf\\(|allowance\\("


def parameters(signature: Column) -> Column:
    """Names of the parameters in a signature, in order."""
    inside = F.regexp_extract(signature, "\\(([^()]*)\\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_extract(x, "[A-Za-z_\\]][A-Za-z0-9_\\[\\]]*\\s.*?([A-Za-z_][A-Za-z0-9_]*)\\s*$", 1)), lambda x: x != "")


def assignments(functions: DataFrame) -> DataFrame:
    """What parameters can flow through inside functions (doc_id, name, signature,
    body, and ``state``, an array of the contract's state variables): doc_id, fn,
    target, source, killed.

    A name is numbered by the assignment that gave it its value (``y#2``), so that
    a later one takes its influence away; what an assignment reads is the nearest
    one before it, in a loop's first line the last one.  The last value of a name
    has the bare name besides.  Parameters and the caller are rows without a target and keep
    their value.  Null signatures and bodies have none;
    what strings hold is not read.
    """
    from pyspark.sql import Window

    f = functions.select("doc_id", F.col("name").alias("fn"), F.regexp_extract_all(F.regexp_replace(F.coalesce("body", F.lit("")), _STRING.pattern, "STR"), F.lit(_ASSIGNED), F.lit(0)).alias("texts"), "state", parameters(F.coalesce("signature", F.lit(""))).alias("params"))
    f = written(f, "assignments")  # read three times below; bodies are read once
    given = f.select("doc_id", "fn", F.lit(None).cast("string").alias("target"), F.explode(F.array_append("params", F.lit(_CALLER))).alias("source"), F.lit(False).alias("killed"))
    a = f.select("doc_id", "fn", "params", "state", F.posexplode("texts").alias("place", "text"))
    a = a.select("*", F.regexp_extract("text", _ASSIGNED, 1).alias("name"), F.regexp_extract("text", _ASSIGNED, 2).alias("value")).where(~F.array_contains("params", F.col("name")))
    names = F.array_distinct(F.regexp_extract_all("value", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    read = F.array_except(names, F.array(*[F.lit(w) for w in [*_NO_VARIABLE, "STR"]]))
    a = a.withColumn("killed", F.col("value").rlike(_FROM_STATE) | F.coalesce(F.arrays_overlap(names, "state"), F.lit(False))).withColumn("read", F.when(F.col("value").rlike("msg[.]sender|tx[.]origin"), F.array_append(read, F.lit(_CALLER))).otherwise(read))
    # One line of writes (kind 1) and reads (kind 0) of each name, by place.
    line = a.select("doc_id", "fn", "place", "killed", F.explode(F.concat(F.transform("read", lambda r: F.struct(F.lit(0).alias("kind"), r.alias("of"), F.col("name").alias("into"))), F.array(F.struct(F.lit(1).alias("kind"), F.col("name").alias("of"), F.col("name").alias("into"))))).alias("e")).select("doc_id", "fn", "place", "killed", "e.*")
    wrote = F.when(F.col("kind") == 1, F.col("place"))
    of = Window.partitionBy("doc_id", "fn", "of")
    line = line.withColumn("before", F.last(wrote, True).over(of.orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, -1))).withColumn("newest", F.max(wrote).over(of))
    numbered = lambda name, place: F.when(place.isNull(), name).otherwise(F.concat_ws("#", name, place.cast("string")))
    flows = line.where("kind = 0").select("doc_id", "fn", numbered(F.col("into"), F.col("place")).alias("target"), numbered(F.col("of"), F.coalesce("before", "newest")).alias("source"), "killed")
    last = line.where((F.col("kind") == 1) & (F.col("place") == F.col("newest"))).select("doc_id", "fn", F.col("of").alias("target"), numbered(F.col("of"), F.col("place")).alias("source"), F.lit(False).alias("killed"))
    return given.unionByName(flows).unionByName(last)


def classify_finding(title: Column, description: Column) -> Column:
    """Which check a finding is for, by its words: reentrancy, access-control or generic."""
    # The words.
    words = F.lower(F.concat_ws(" ", title, description))
    return F.when(words.rlike("reentrancy|re-entrancy|reentrant"), "reentrancy").when(words.rlike("access control|onlyowner|unauthorized|privilege|missing check"), "access-control").otherwise("generic")
