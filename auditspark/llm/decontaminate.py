"""Operator 5: benchmark decontamination by template canonicalisation.

A text becomes canonical tokens: punctuation around words goes, all is
lower-cased, and numbers (digits or words), units after a number and runs of names
inside a sentence turn into typed placeholders, each with the words it stands for.
Windows of canonical tokens of documents and of benchmark items meet in a hash
join.  The windows of a document that lie at one offset from an item are an
alignment; its slots must be filled consistently (one value of the item always
stands for one value of the document), else only its windows with the item's own
values count.  So a question with other numbers or names is found, and prose
that only shares a pattern is not.  Windows made mostly of placeholders tell little;
they count where one alignment has all windows of an item.  A name that opens an item
cannot be told from another first word; items are also read without that word.  Windows of plain lower-cased words meet in
the same way, so items that are short or made of numbers, names or capitals are
found where they are repeated.  All of it is DataFrame functions: texts are
rewritten as a whole and windows are rows of words, made and hashed in generated
code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import fields_of, packed, small, table, written

#: Tokens of a window; items with fewer use windows of their own length.
WINDOW = 8
#: Items with fewer canonical tokens have no template: they are found word for word only.
#: (Three or four tokens with a placeholder, as in "add 3 and 4", are ordinary prose.)
LEAST_TEMPLATE = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5

# Punctuation stripped from words, marks that end a sentence, units of measure, and numbers in words.
MARKS = ".,;:!?\"'()[]{}<>|#$%&*+=/\\_~^`€£-"
ENDS = ".!?:"
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years percent dollar dollars cent cents euro euros pound pounds mph kmh degree degrees watt watts w kw kwh v volt volts"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
#: First characters of placeholders, of a word that opens a sentence, and between
#: the words of a name.  In texts they count as white space.
OPENS, NUM, UNIT, NAME, GLUE = "\x01", "\x02", "\x03", "\x04", "\x05"
_OWN = OPENS + NUM + UNIT + NAME + GLUE

_S = " \\t\\n\\x0B\\f\\r"
_M = "".join("\\" + c if c.isascii() else c for c in MARKS)
#: What stands between two words: a run of punctuation and white space with white
#: space in it.  A match begins where a run begins, so long runs are read once;
#: a lone space, which stays, begins none.
_BEGIN = f"[{_M}{_S}](?:(?<=[^ ])|(?=[{_M}{_S}]))(?<![{_M}{_S}]{{2}})"
_REST = f"(?:(?<=[{_S}])|[{_M}]*+[{_S}])[{_M}{_S}]*+"
_BREAK = _BEGIN + _REST
_STOP = f"{_BEGIN}(?:(?<=[{ENDS}])|(?=[{_M}{_S}]*?[{ENDS}])){_REST}"


def _spaced(text: Column, opened: bool) -> Column:
    """Words between single spaces; OPENS stands before those that open a sentence."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(f"[{_OWN}]"), F.translate(text, _OWN, " " * len(_OWN))).otherwise(text)
    text = F.concat(F.lit(". " if opened else " "), text, F.lit(" "))
    return F.regexp_replace(F.regexp_replace(text, _STOP, " " + OPENS), _BREAK, " ")


def _valued(spaced: Column) -> Column:
    """Canonical tokens with their values: a placeholder goes before the words it stands for."""
    out = F.regexp_replace(spaced, f"(?<=[ {OPENS}])(?:[0-9][^ ]*+|(?=[a-zA-Z])(?i:{'|'.join(NUMBERS)})(?= ))", NUM + "$0")
    out = F.regexp_replace(out, f"{NUM}[^ ]*+ (?=(?i:{'|'.join(UNITS)}) )", "$0" + UNIT)
    out = F.regexp_replace(out, " (?=\\p{Lu})", " " + NAME)
    out = F.regexp_replace(out, f"({NAME}[^ ]*+) (?={NAME})", "$1" + GLUE)
    return F.trim(F.lower(F.replace(out, F.lit(OPENS), F.lit(""))))


def _canon(valued: Column) -> Column:
    return F.regexp_replace(valued, f"([{NUM}{UNIT}{NAME}])[^ ]*+", "$1")


def _words(valued: Column) -> Column:
    return F.replace(F.regexp_replace(valued, f"[{NUM}{UNIT}{NAME}]", ""), F.lit(GLUE), F.lit(" "))


def _slot(token: Column) -> Column:
    return token.isin(NUM, UNIT, NAME)


def _shifted(array: str, name: str, width: int = WINDOW) -> list[Column]:
    """The array and its tails: zipped, entry i holds the window that starts there."""
    return [F.slice(array, F.lit(k + 1), F.size(array)).alias(f"{name}{k}") for k in range(width)]


def _key(names: list[str], literal: bool) -> Column:
    """Hash of a window; null where the text ends before it does."""
    return F.when(F.col(names[-1]).isNotNull(), F.xxhash64(F.lit(int(literal)), *[F.col(c) for c in names]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, version, literal, width, at, form, own, key, rich, spoken, total,
    riches of the windows of every item.

    ``form`` is what a document must hold there, ``own`` the item's words.  The
    version ``opened`` reads the item's first word as the opening of a sentence,
    ``continued`` as standing inside one (left out if that is the same), ``headless``
    leaves it out if it is a capital one, ``words`` (``literal``) has the lower-cased
    words.  A window is ``rich`` if at least half of its tokens are words.  A version
    is ``spoken`` if any of its tokens is a word.  ``total`` counts windows, ``riches``
    rich ones.
    """
    items = benchmark.select("item_id", *[_spaced(F.col("text"), o).alias(n) for o, n in ((True, "s"), (False, "c"))]).distinct()
    items = items.select("item_id", _valued(F.col("s")).alias("o"), _valued(F.col("c")).alias("c")).withColumn("w", _words(F.col("o")))
    versions = [
        items.select("item_id", F.lit("opened").alias("version"), F.split("o", " ").alias("own")),
        items.where("c <> o").select("item_id", F.lit("continued").alias("version"), F.split("c", " ").alias("own")),
        items.where("c <> o").select("item_id", F.lit("headless").alias("version"), F.slice(F.split("o", " "), F.lit(2), F.size(F.split("o", " "))).alias("own")),
        items.select("item_id", F.lit("words").alias("version"), F.split("w", " ").alias("own")),
    ]
    every = versions[0].unionByName(versions[1]).unionByName(versions[2]).unionByName(versions[3]).where("size(own) > 0").where(F.element_at("own", 1) != "")
    literal = F.col("version") == "words"
    every = every.where(literal | (F.size("own") >= LEAST_TEMPLATE)).withColumn("width", F.least(F.size("own"), F.lit(WINDOW)))
    spoken = F.exists("own", lambda x: ~_slot(_canon(x)))
    cut = every.select("item_id", "version", literal.alias("literal"), "width", "own", spoken.alias("spoken"), F.explode(F.sequence(F.lit(1), F.size("own") - F.col("width") + 1)).alias("at"))
    cut = cut.withColumn("own", F.slice("own", F.col("at"), F.col("width"))).withColumn("form", F.when(F.col("literal"), F.col("own")).otherwise(F.transform("own", _canon)))
    cut = cut.withColumn("rich", F.col("literal") | (2 * F.size(F.filter("form", lambda x: ~_slot(x))) >= F.col("width")))
    keys = [F.xxhash64(F.col("literal").cast("int"), *[F.get("form", F.lit(k)) for k in range(w)]) for w in range(1, WINDOW + 1)]
    cut = cut.withColumn("key", F.element_at(F.array(*keys), F.col("width")))
    total = cut.groupBy("item_id", "version").agg(F.count_distinct("at").alias("total"), F.count_distinct(F.when(F.col("rich"), F.col("at"))).alias("riches"))
    same = F.col("c.item_id").eqNullSafe(F.col("t.item_id")) & (F.col("c.version") == F.col("t.version"))
    return cut.alias("c").join(total.alias("t"), same).select("c.*", "t.total", "t.riches")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")


def candidates(docs: DataFrame, windows: DataFrame, widths: dict[bool, list[int]], n: int) -> DataFrame:
    """doc_id and digest of the documents with a window whose key is an item's."""
    valued = _identified(docs).select("doc_id", "digest", _valued(_spaced(F.col("text"), True)).alias("v"))
    arrays = valued.select("doc_id", "digest", F.split(_canon(F.col("v")), " ").alias("c"), F.split(_words(F.col("v")), " ").alias("w"))
    kinds = [(lit, name, widths[lit]) for lit, name in ((False, "c"), (True, "w")) if widths.get(lit)]
    rows = arrays.select("doc_id", "digest", F.inline(F.arrays_zip(*[x for _, name, of in kinds for x in _shifted(name, name, max(of))])))
    keys = F.array(*[_key([f"{name}{k}" for k in range(w)], lit) for lit, name, of in kinds for w in of])
    found = rows.select("doc_id", "digest", F.explode(keys).alias("key")).where("key is not null")
    return found.join(small(windows.select("key").distinct(), 16, n), "key", "left_semi").select("doc_id", "digest").distinct()


def matched_windows(docs: DataFrame, windows: DataFrame, widths: dict[bool, list[int]], n: int) -> DataFrame:
    """Windows of documents that equal the form of a window of an item, token by
    token: doc_id, digest, item_id, version, literal, rich, spoken, total, riches, at,
    shift, slots (canon, item, doc)."""
    valued = _identified(docs).select("doc_id", "digest", _valued(_spaced(F.col("text"), True)).alias("v"))
    arrays = valued.select("doc_id", "digest", F.split(_canon(F.col("v")), " ").alias("c"), F.split("v", " ").alias("v"), F.split(_words(F.col("v")), " ").alias("w"))
    parts = []
    for literal, form, value in ((False, "c", "v"), (True, "w", "w")):
        if not widths.get(literal):
            continue
        most = max(widths[literal])
        rows = arrays.select("doc_id", "digest", F.posexplode(F.arrays_zip(*_shifted(form, "t", most), *_shifted(value, "u", most))).alias("place", "x"))
        rows = rows.select("doc_id", "digest", "place", "x.*")
        for w in widths[literal]:
            whole = rows.where(F.col(f"t{w - 1}").isNotNull())
            parts.append(whole.select("doc_id", "digest", "place", F.lit(literal).alias("literal"), F.array(*[f"t{k}" for k in range(w)]).alias("form"), F.array(*[f"u{k}" for k in range(w)]).alias("doc"), _key([f"t{k}" for k in range(w)], literal).alias("key")))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    # Windows meet by their hash first, which is narrow, so only those that match move as words.
    placed = placed.join(small(windows.select("key").distinct(), 16, n), "key", "left_semi")
    hits = placed.join(small(windows.drop("key", "width"), 900, n), ["literal", "form"])
    slots = F.filter(F.arrays_zip(F.col("form").alias("canon"), F.col("own").alias("item"), F.col("doc").alias("doc")), lambda x: _slot(x["canon"]))
    return hits.select("doc_id", "digest", "item_id", "version", "literal", "rich", "spoken", "total", "riches", "at", (F.col("place") + 1 - F.col("at")).alias("shift"), slots.alias("slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``contaminated`` with the digest of the text, which with doc_id names the row."""
    windows = written(item_windows(benchmark), "item-windows")
    counts = windows.groupBy("literal", "width").agg(F.count("*").alias("n")).collect()  # at most 2 x WINDOW rows
    n, widths = sum(r["n"] for r in counts), {lit: sorted(r["width"] for r in counts if r["literal"] == lit) for lit in (False, True)}
    widths = widths if n else {False: [WINDOW], True: [WINDOW]}
    some = written(candidates(docs, windows, widths, n).select(F.col("doc_id").alias("id"), F.col("digest").alias("of")), "leak-candidates")
    row = docs.select("doc_id", "text")
    near = row.join(small(some, 24), row["doc_id"].eqNullSafe(some["id"]) & (F.xxhash64("text") == some["of"]), "left_semi").distinct()
    hits = written(matched_windows(near, windows, widths, n), "window-hits")
    place = ["doc_id", "digest", "item_id", "version", "shift"]
    filled = hits.where("not literal").select(*place, F.explode("slots").alias("s")).select(*place, "s.canon", "s.item", "s.doc")
    each = filled.groupBy(*place, "canon", "item").agg((F.min("doc") != F.max("doc")).alias("torn"))
    state = each.groupBy(*place).agg(F.bool_or("torn").alias("torn"), F.count("*").alias("slots"))
    whole = hits.where("not literal").groupBy(*place).agg((F.count_distinct("at") == F.max("total")).alias("whole"))
    own = F.forall("slots", lambda s: s["item"] == s["doc"])
    rows = hits.select(*place, "at", "literal", "rich", "spoken", "total", "riches", own.alias("own")).distinct().alias("r")
    same = F.lit(True)
    for c in place:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    within = F.lit(True)
    for c in place:
        within = within & F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}"))
    joined = rows.join(state.alias("s"), same, "left").join(whole.alias("a"), within, "left")
    joined = joined.select("r.*", F.coalesce("s.torn", F.lit(False)).alias("torn"), F.coalesce("s.slots", F.lit(0)).alias("slots"), F.coalesce("a.whole", F.lit(False)).alias("whole"))
    good = joined.where(F.col("literal") | F.col("own") | ((F.col("rich") | F.col("whole") & F.col("spoken")) & ~F.col("torn")))
    by = good.groupBy("doc_id", "digest", "item_id", "version").agg(
        F.count_distinct("at").alias("places"), F.count_distinct(F.when(F.col("rich"), F.col("at"))).alias("found"), F.max("total").alias("total"), F.max("riches").alias("riches"), F.max("slots").alias("slots")
    )
    among_rich = (F.col("riches") > 0) & (F.col("found") * F.col("total") > F.col("places") * F.col("riches"))
    by = by.select("doc_id", "digest", "item_id", "version", F.when(among_rich, F.col("found")).otherwise(F.col("places")).alias("matched"), F.when(among_rich, F.col("riches")).otherwise(F.col("total")).alias("total"), "slots")
    best = by.withColumn("share", F.col("matched") / F.col("total")).groupBy("doc_id", "digest", "item_id").agg(F.max(F.struct("share", "matched", "total", "slots", "version")).alias("b"))
    return best.where(F.col("b.share") >= coverage).select("doc_id", "digest", "item_id", "b.matched", "b.total", F.col("b.share").alias("coverage"), "b.slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, matched, total, coverage, slots of every document that
    holds at least ``coverage`` of the windows of one version of an item.

    A window of canonical tokens counts if the document has the item's own values
    in its slots, or if it is rich in words or its alignment has all windows of the
    item, and the slots of its alignment are filled consistently; the share is taken of all windows or of the rich ones,
    whichever is larger.  A window of words counts wherever it stands.
    ``matched``, ``total`` and ``slots`` (distinct slot values of the item in the
    alignment) are of the version with the largest share (ties: more windows).

    Null and empty texts, items without a word and an empty table of documents or
    of items match nothing.  Texts of any length are read whole; memory of a task
    grows with the words of one text.  Items of any length are matched; those of
    fewer than ``LEAST_TEMPLATE`` tokens only word for word.  Rows that repeat a
    doc_id and its text count as one document, rows with one doc_id and different
    texts as several; rows that repeat an item_id and its text count as one
    item, different texts of one item_id share its windows.  A null doc_id or
    item_id is a value like others.  Other columns are not used.
    """
    return leaks(docs, benchmark, coverage).drop("digest")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, columns as they were.

    Every row is judged by its own text, also where doc_id is null or repeated;
    clean rows stay, and so do repeats of them.
    """
    gone = written(leaks(docs, benchmark, coverage).select("doc_id", "digest").distinct(), "contaminated").alias("g")
    rows = packed(docs, id=F.col("doc_id"), of=F.xxhash64("text")).alias("d")
    return fields_of(rows.join(small(gone, 24), F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.of") == F.col("g.digest")), "left_anti"), docs)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, matched, total, coverage, slots of every leak."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    """The same by rows of tokens: every word is a row, names are islands of rows,
    and windows are gathered by position."""
    marks = "".join("\\" + c if c.isascii() else c for c in MARKS).replace("'", "''")
    space = " \\t\\n\\x0B\\f\\r"
    gap = f"[{marks}{space}]*[{space}][{marks}{space}]*"
    units = ", ".join(f"'{u}'" for u in UNITS)
    own = " || ".join(f"chr({ord(c)})" for c in _OWN)
    number = f"(regexp_matches(w, '^[0-9]') OR lower(w) IN ({', '.join(repr(x) for x in NUMBERS)}))"

    def tokens(name, key, source, start):
        return f"""
{name}_t AS (SELECT DISTINCT {key}, '{start}' || translate(coalesce(text, ''), {own}, '     ') || ' ' AS x FROM {source}),
{name}_w AS (SELECT {key}, unnest(range(1, len(ws))) AS i, ws, gs FROM (SELECT {key}, string_split_regex(x, '{gap}')[2:] AS ws, regexp_extract_all(x, '{gap}') AS gs FROM {name}_t)),
{name}_r AS (SELECT {key}, i, ws[i] AS w, regexp_matches(gs[i], '[{ENDS}]') AS opens FROM {name}_w),
{name}_k AS (SELECT *, CASE WHEN {number} THEN 'N' WHEN lag({number}) OVER p AND NOT opens AND lower(w) IN ({units}) THEN 'U' WHEN NOT opens AND regexp_matches(w, '^\\p{{Lu}}') THEN 'P' ELSE 'W' END AS k
  FROM {name}_r WINDOW p AS (PARTITION BY {key} ORDER BY i)),
{name}_g AS (SELECT *, sum(CASE WHEN k = 'P' AND before = 'P' THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS j FROM (SELECT *, lag(k) OVER (PARTITION BY {key} ORDER BY i) AS before FROM {name}_k)),
{name}_c AS (SELECT {key}, j, any_value(k) AS k, string_agg(lower(w), ' ' ORDER BY i) AS v FROM {name}_g GROUP BY ALL),
{name} AS (SELECT {key}, list(CASE WHEN k = 'W' THEN v ELSE '<' || k || '>' END ORDER BY j) AS c, list(v ORDER BY j) AS v FROM {name}_c GROUP BY ALL),
{name}_l AS (SELECT {key}, list(lower(w) ORDER BY i) AS v FROM {name}_r GROUP BY ALL)"""

    return f"""
WITH d0 AS (SELECT doc_id, hash(coalesce(text, '')) AS d, text FROM documents), {tokens("dt", "doc_id, d", "d0", ". ").lstrip()},
{tokens("bo", "item_id", "benchmark", ". ").lstrip()}, {tokens("bc", "item_id", "benchmark", " ").lstrip()},
bv AS (SELECT item_id, 'opened' AS version, c, v FROM bo UNION ALL SELECT bc.item_id, 'continued', bc.c, bc.v FROM bc JOIN bo ON bc.item_id = bo.item_id WHERE bc.c <> bo.c OR bc.v <> bo.v
  UNION ALL SELECT bc.item_id, 'headless', bo.c[2:], bo.v[2:] FROM bc JOIN bo ON bc.item_id = bo.item_id WHERE bc.c <> bo.c OR bc.v <> bo.v UNION ALL SELECT item_id, 'words', v, v FROM bo_l),
bw AS (SELECT item_id, version, c, v, least(len(c), {WINDOW}) AS width FROM bv WHERE version = 'words' OR len(c) >= {LEAST_TEMPLATE}),
bp AS (SELECT *, unnest(range(1, len(c) - width + 2)) AS pos FROM bw),
bx AS (SELECT item_id, version, width, pos, c[pos:pos + width - 1] AS form, v[pos:pos + width - 1] AS own FROM bp),
by_window AS (SELECT *, version = 'words' OR 2 * len(list_filter(form, lambda x: x NOT IN ('<N>', '<U>', '<P>'))) >= width AS rich FROM bx),
spo AS (SELECT item_id, version, bool_or(len(list_filter(form, lambda x: x NOT IN ('<N>', '<U>', '<P>'))) > 0) AS spoken FROM bx GROUP BY ALL),
b AS (SELECT by_window.*, spoken, count(*) OVER q AS total, count(*) FILTER (rich) OVER q AS riches FROM by_window JOIN spo ON by_window.item_id IS NOT DISTINCT FROM spo.item_id AND by_window.version = spo.version WINDOW q AS (PARTITION BY by_window.item_id, by_window.version)),
ww AS (SELECT DISTINCT width, version = 'words' AS lit FROM b),
dp AS (SELECT doc_id, d, FALSE AS lit, c, v, width, unnest(range(1, len(c) - width + 2)) AS place FROM dt JOIN ww ON NOT lit AND len(c) >= width
  UNION ALL SELECT doc_id, d, TRUE, v, v, width, unnest(range(1, len(v) - width + 2)) FROM dt_l JOIN ww ON lit AND len(v) >= width),
dx AS (SELECT doc_id, d, lit, place, c[place:place + width - 1] AS form, v[place:place + width - 1] AS own FROM dp),
hit AS (SELECT DISTINCT doc_id, d, item_id, version, lit, rich, spoken, total, riches, pos, place - pos AS shift, dx.form AS form, b.own AS bo, dx.own AS mine FROM dx JOIN b ON dx.form = b.form AND lit = (version = 'words')),
sl AS (SELECT doc_id, d, item_id, version, shift, form, bo, mine, unnest(range(1, len(form) + 1)) AS j FROM hit WHERE NOT lit),
sv AS (SELECT doc_id, d, item_id, version, shift, form[j] AS f, bo[j] AS bi, count(DISTINCT mine[j]) AS values FROM sl WHERE form[j] IN ('<N>', '<U>', '<P>') GROUP BY ALL),
st AS (SELECT doc_id, d, item_id, version, shift, max(values) > 1 AS torn, count(*) AS slots FROM sv GROUP BY ALL),
wh AS (SELECT doc_id, d, item_id, version, shift, count(DISTINCT pos) = max(total) AS whole FROM hit WHERE NOT lit GROUP BY ALL),
good AS (SELECT h.*, coalesce(slots, 0) AS slots FROM hit h LEFT JOIN st USING (doc_id, d, item_id, version, shift) LEFT JOIN wh USING (doc_id, d, item_id, version, shift) WHERE lit OR bo = mine OR (rich OR coalesce(whole, FALSE) AND spoken) AND NOT coalesce(torn, FALSE)),
s AS (SELECT doc_id, d, item_id, version, count(DISTINCT pos) AS places, count(DISTINCT pos) FILTER (rich) AS found, max(total) AS total, max(riches) AS riches, max(slots) AS slots FROM good GROUP BY ALL),
m AS (SELECT doc_id, d, item_id, version, slots, unnest([{{'m': places, 't': total}}, {{'m': found, 't': riches}}]) AS x FROM s),
best AS (SELECT doc_id, d, item_id, max({{'s': x.m / x.t, 'm': x.m, 't': x.t, 'slots': slots}}) AS b FROM m WHERE x.t > 0 GROUP BY ALL)
SELECT doc_id, item_id, b.m AS matched, b.t AS total, b.s AS coverage, b.slots AS slots FROM best WHERE b.s >= {COVERAGE}
"""


OP5_SQL = _oracle()
