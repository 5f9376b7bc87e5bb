"""Source code read by its language: comments, contracts, functions, calls.

``clean_code`` is a column expression: a text is cut into strings, comments and what
lies between, so that a comment's mark inside a string is no comment.  The shape of
contracts needs matching brackets, which one pass per file finds in Arrow batches;
everything that is asked of contracts is joins on the tables that come out.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions.code import word_of
from auditspark.shipping import ship

# Strings and comments of the languages.  Every pattern that has begun ends
# at the latest with its line or its text, so that no place is read twice.
_DOUBLE = r'"(?:[^"\\\n]++|\\.)*+"?'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'?"
_LONG = r'"(?:[^"\\]++|\\.)*+"?'
_CHAR = r"'(?:\\[^\n]|[^'\\\n])'"
_BACKTICK = r"`(?:[^`\\]++|\\.)*+`?"
_RAW = r"`[^`]*+`?"
_TRIPLE = r'"""[\s\S]*?(?:"""|\z)' + "|'''[\\s\\S]*?(?:'''|\\z)"
_SLASHES = r"//[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+"
_HASH = r"#[^\n]*+"
_SEMICOLONS = r";;[^\n]*+"
_ML = r"\(\*[\s\S]*?(?:\*\)|\z)"
_WAT = r"\(;[\s\S]*?(?:;\)|\z)"
_FUNC = r"\{-[\s\S]*?(?:-\}|\z)"
_C_LIKE = ((_DOUBLE, _SINGLE), (_SLASHES, _BLOCK))
_RUST = ((_CHAR, _LONG), (_SLASHES, _BLOCK))
LEXICON = {
    "solidity": _C_LIKE, "yul": _C_LIKE, "huff": _C_LIKE, "cairo": _C_LIKE, "move": ((_DOUBLE,), (_SLASHES, _BLOCK)), "func": ((_DOUBLE,), (_SEMICOLONS, _FUNC, _SLASHES, _BLOCK)),
    "rust": _RUST, "solana": _RUST, "cosmwasm": _RUST, "ink": _RUST, "substrate": _RUST,
    "go": ((_DOUBLE, _SINGLE, _RAW), (_SLASHES, _BLOCK)), "ts-sdk": ((_DOUBLE, _SINGLE, _BACKTICK), (_SLASHES, _BLOCK)),
    "vyper": ((_TRIPLE, _DOUBLE, _SINGLE), (_HASH,)), "python": ((_TRIPLE, _DOUBLE, _SINGLE), (_HASH,)),
    "clarity": ((_DOUBLE,), (_SEMICOLONS,)), "scilla": ((_DOUBLE,), (_ML,)), "michelson": ((_DOUBLE,), (_HASH, _BLOCK)), "webassembly": ((_DOUBLE,), (_SEMICOLONS, _WAT)),
}
_BEGINS = {_SLASHES: "//", _BLOCK: "/*", _HASH: "#", _SEMICOLONS: ";;", _ML: "(*", _WAT: "(;", _FUNC: "{-"}


def _cleaned(text: Column, strings: tuple[str, ...], comments: tuple[str, ...]) -> Column:
    marks = "".join(sorted({_BEGINS[c][0] for c in comments} | {s[0] for x in strings for s in x.split("|")}))
    stops = re.sub(r"([\\\]\[^-])", r"\\\1", marks)
    # A comment in group 1, else what stays in group 0.
    pieces = F.regexp_extract_all(text, F.lit(f"{'|'.join((*strings, *comments))}|[^{stops}]++|[{stops}]"), F.lit(0))

    def piece(p: Column) -> Column:
        comment = F.lit(False)
        for c in comments:
            begins = p.startswith(_BEGINS[c])
            comment = comment | (begins & (F.length(p) > 1) if _BEGINS[c] != "#" else begins)
        breaks = F.regexp_replace(p, "[^\n]+", "")
        one_line = F.lit(False)
        for c in comments:
            if c in (_SLASHES, _HASH, _SEMICOLONS):
                one_line = one_line | p.startswith(_BEGINS[c])
        return F.when(~comment, p).when(one_line, "").when(breaks == "", " ").otherwise(breaks)

    return F.array_join(F.transform(pieces, piece), "")


def clean_code(text: Column, lang: Column) -> Column:
    """Code without comments: a block comment becomes its line breaks (a space if it has
    none), a line comment goes, strings stay, so every line keeps its number.  A comment
    that does not end goes on to the end.  Texts of other languages stay as they are;
    null is the empty text.  A string ends with its line where the language says so."""
    whole = F.coalesce(text, F.lit(""))
    out = whole
    for lexicon in dict.fromkeys(LEXICON.values()):
        of = [k for k, v in LEXICON.items() if v == lexicon]
        marks = F.lit(False)
        for c in lexicon[1]:
            marks = marks | F.contains(whole, F.lit(_BEGINS[c]))
        out = F.when(lang.isin(*of) & marks, _cleaned(whole, *lexicon)).otherwise(out)
    return out


# --- contracts


_STRINGS = re.compile(f"{_DOUBLE}|{_SINGLE}")
_NAME = r"[A-Za-z_$][\w$]*+"
_CONTRACT = re.compile(rf"({word_of(r'abstract\s+contract|contract|interface|library', r'\w$.')})\s+({_NAME})\s*(?:\bis\b([^{{;]*+))?\{{")
_FUNCTION = re.compile(rf"({word_of('function|modifier|constructor|fallback|receive', r'\w$.')})(?![\w$])\s*({_NAME})?\s*(?=[({{])")
_CALL = re.compile(rf"(?<![\w$])({_NAME})\s*(\{{[^{{}};]*+\}}\s*)?\(")
_RECEIVER = re.compile(r"[\w$\])]\s*\.\s*$")
_VARIABLE = re.compile(rf"^\s*(mapping\b.*\)|{_NAME}(?:\.{_NAME})*(?:\s*\[[^\]]*\])*)((?:\s+(?:public|private|internal|constant|immutable|override|transient))*)\s+({_NAME})\s*(?:=.*)?$", re.S)
_NO_TYPE = frozenset("using event error return returns import pragma emit require delete throw revert struct enum function modifier is else if for while type new".split())
_NO_CALL = frozenset("if for while require assert revert return function catch returns mapping emit".split())
#: Calls inside more calls than this are not read; no compiler takes them.
DEEPEST = 64


def _pairs(text: str, marks: str) -> dict[int, int]:
    """Place of each opening mark to that of its closing one (or the end)."""
    stack, found = [], {}
    for m in re.finditer(f"[{re.escape(marks)}]", text):
        if m[0] == marks[0]:
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
    return found | dict.fromkeys(stack, len(text))


def _parts(text: str, start: int, stop: int, closes: dict[int, int]) -> list[str]:
    """The arguments between two parentheses."""
    out, at, i = [], start, start
    while i < stop:
        c = text[i]
        if c in "([{" and i in closes:
            i = min(closes[i], stop)
        elif c == ",":
            out.append(text[at:i])
            at = i + 1
        i += 1
    last = text[at:stop]
    return [*out, last] if out or last.strip() else []


def _words(text: str) -> list[str]:
    """Names of an expression in order, an index being no part of its value; ``msg.sender``
    and ``msg.value`` are one name."""
    flat = re.sub(r"\[[^\[\]]*+\]", "[]", text)
    found = re.findall(rf"(?:msg|tx|block)\s*\.\s*{_NAME}|{_NAME}", flat)
    return list(dict.fromkeys(w.replace(" ", "") for w in found)) + (["[]"] if "[]" in flat else [])


def _calls(shape: str, start: int, stop: int, closes: dict[int, int], line) -> list[dict]:
    out, around = [], []
    for m in _CALL.finditer(shape, start, stop):
        opening = m.end() - 1
        end = min(closes[opening], stop)
        while around and around[-1] < m.start():
            around.pop()
        around.append(end)
        if m[1] in _NO_CALL or len(around) > DEEPEST:
            continue
        value = re.search(r"\bvalue\s*:\s*([^,}]+)", m[2] or "")
        before = _RECEIVER.search(shape, max(start, m.start() - 40), m.start())
        out.append({"callee": m[1], "on": bool(before), "value": _words(value[1]) if value else None, "args": [_words(a) for a in _parts(shape, opening + 1, end, closes)], "line": line(m.start())})
    return out


def _parse(source: str):
    """Contracts of a Solidity text without comments."""
    shape = _STRINGS.sub(lambda m: m[0][0] + " " * (len(m[0]) - 1), source)
    braces = _pairs(shape, "{}")
    closes = _pairs(shape, "()") | _pairs(shape, "[]") | braces
    breaks = [m.start() for m in re.finditer("\n", shape)]
    opens, ends = sorted(braces), [m.start() for m in re.finditer(";", shape)]
    line = lambda at: bisect_left(breaks, at) + 1
    heads = list(_FUNCTION.finditer(shape))
    places = [m.start() for m in heads]
    after = 0
    for c in _CONTRACT.finditer(shape):
        first, stop = c.end(), braces[c.end() - 1]
        if c.start() < after:
            continue
        after = stop
        listed = c[3] or ""
        bases = [b[1].rpartition(".")[2] for x in _parts(listed, 0, len(listed), _pairs(listed, "()")) if (b := re.match(r"\s*([\w$.]+)", x))]
        functions, covered = [], first
        for m in heads[bisect_left(places, first) : bisect_left(places, stop)]:
            if m.start() < covered:
                continue
            i, j = bisect_left(opens, m.end()), bisect_left(ends, m.end())
            opening = opens[i] if i < len(opens) and opens[i] < stop else None
            end = ends[j] if j < len(ends) and ends[j] < stop else stop
            listed = shape[m.end()] == "("
            inside = (m.end(), closes.get(m.end(), m.end())) if listed else (m.end(), m.end())
            body = opening is not None and opening < end
            last = braces[opening] if body else end
            parameters = [p.split()[-1] if len(p.split()) > 1 else "" for p in _parts(shape, inside[0] + 1, inside[1], closes)] if listed else []
            functions.append(
                {
                    "name": m[2] or m[1] if m[1] != "function" else m[2] or "fallback", "kind": m[1], "line": line(m.start()), "params": parameters, "signature": source[m.start() : opening if body else end].strip(),
                    "body": source[opening : last + 1] if body else None, "calls": _calls(shape, opening, last, closes, line) if body else [],
                }
            )
            covered = last
        state, at = [], first
        while at < stop:  # what stands between the functions, statement by statement
            i, j = bisect_left(opens, at), bisect_left(ends, at)
            opening = opens[i] if i < len(opens) and opens[i] < stop else stop
            end = ends[j] if j < len(ends) and ends[j] < stop else stop
            if opening < end:
                at = braces[opening] + 1
                continue
            if (v := _VARIABLE.match(shape[at:end])) and re.match(r"\w+", v[1])[0] not in _NO_TYPE:
                seen = re.search(r"\b(public|private|internal)\b", v[2])
                state.append({"name": v[3], "type": " ".join(v[1].split()), "visibility": seen[1] if seen else "internal", "line": line(at + v.start(3))})
            at = end + 1
        yield {"contract": c[2], "kind": c[1].split()[-1], "line": line(c.start()), "bases": bases, "state": state, "functions": functions}


_SCHEMA = (
    "doc_id long, contract string, kind string, line int, bases array<string>, state array<struct<name: string, type: string, visibility: string, line: int>>, functions array<struct<name: string, kind: string, line: int, params: array<string>, "
    "signature: string, body: string, calls: array<struct<callee: string, on: boolean, value: array<string>, args: array<array<string>>, line: int>>>>"
)


def contracts(files: DataFrame) -> DataFrame:
    """Contracts of Solidity files (doc_id, text): kind, line, bases as declared, state
    variables, functions with their parameters, signature, body and calls (``on``:
    of something; ``value``: names in the value it sends; ``args``: names in each
    argument).  Comments are taken out first and lines stay; null texts and texts without
    a contract have no row; a bracket that stays open closes with the text."""
    ship(files.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("contract", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("bases", pa.list_(pa.string())), ("state", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("visibility", pa.string()), ("line", pa.int32())])))])
    call = pa.struct([("callee", pa.string()), ("on", pa.bool_()), ("value", pa.list_(pa.string())), ("args", pa.list_(pa.list_(pa.string()))), ("line", pa.int32())])
    function = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("params", pa.list_(pa.string())), ("signature", pa.string()), ("body", pa.string()), ("calls", pa.list_(call))])
    kinds = kinds.append(pa.field("functions", pa.list_(function)))

    def parse(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [{"doc_id": i} | c for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for c in _parse(text)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    clean = clean_code(F.col("text"), F.lit("solidity"))
    return files.where("text IS NOT NULL").select("doc_id", clean.alias("text")).mapInArrow(parse, _SCHEMA)
