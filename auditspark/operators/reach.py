"""Reachability by visibility, inheritance, interfaces and taint over functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.operators.graph import _grown, _within, _written

# What makes a function callable from outside, and internal, per language.
_OPEN = {"vyper": "@external|@public|@payable", "move": "public\\s+entry|entry\\s+fun|public\\s+fun", "cairo": "#\\[external|#\\[abi|@external|@view", "clarity": "define-public|define-read-only"}
_CLOSED = {"vyper": "@internal|@private", "move": "public\\s*\\(friend\\)|^\\s*fun\\b", "cairo": "@internal", "clarity": "define-private"}


def visibility_reach(functions: DataFrame) -> DataFrame:
    """``reach`` of functions (lang, signature) by their declaration: reachable or
    unknown.  It never rejects: an internal function may be called."""
    lang, sig = F.col("lang"), F.col("signature")
    opened, closed = F.lit(False), F.lit(False)
    for k in _OPEN:
        opened = opened | ((lang == k) & sig.rlike(_OPEN[k]))
        closed = closed | ((lang == k) & sig.rlike(_CLOSED[k]))
    return functions.withColumn("reach", F.when(opened, "reachable").otherwise("unknown")).withColumn("declared", F.when(opened, "open").when(closed, "closed").otherwise("none"))


def reach_dispatch(functions: DataFrame, solidity: DataFrame) -> DataFrame:
    """Call-graph verdicts for solidity, declarations for the languages that have
    them, unknown for the rest."""
    other = visibility_reach(functions.where(F.col("lang") != "solidity")).select("node", F.when(F.col("lang").isin(*_OPEN), F.col("reach")).otherwise("unknown").alias("verdict"))
    return solidity.select("node", "verdict").unionByName(other)


def corroborate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two backends' verdicts by node: agreement is strong, reachable rescues."""
    j = first.select("node", F.col("verdict").alias("a")).join(second.select("node", F.col("verdict").alias("b")), "node", "left")
    verdict = F.when((F.col("a") == "reachable") | (F.col("b") == "reachable"), "reachable").when((F.col("a") == "not_reachable") & (F.coalesce("b", F.lit("not_reachable")) == "not_reachable"), "not_reachable").otherwise("unknown")
    return j.select("node", verdict.alias("verdict"), (F.col("a") == F.col("b")).alias("agree"))


def inheritance_edges(files: DataFrame) -> DataFrame:
    """contract -> base of files (doc_id, text)."""
    heads = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?:contract|interface|library)\\s+\\w+\\s+is\\s+[^{]+\\{"), F.lit(0))
    h = files.select("doc_id", F.explode(heads).alias("h"))
    bases = F.split(F.regexp_replace(F.regexp_extract("h", "\\bis\\s+([^{]+)\\{", 1), "\\([^)]*\\)", ""), ",")
    e = h.select("doc_id", F.regexp_extract("h", "(?:contract|interface|library)\\s+(\\w+)", 1).alias("contract"), F.explode(bases).alias("base"))
    return e.select("doc_id", "contract", F.regexp_replace("base", "\\s+", "").alias("base")).where("base <> ''").distinct()


def external_interfaces(files: DataFrame, most: int = 15) -> DataFrame:
    """doc_id, calls: the first ``Type.function`` a file calls through an address
    cast or a typed variable."""
    text = F.coalesce("text", F.lit(""))
    cast = files.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("\\b([A-Z]\\w*\\([\\w.\\[\\]]+\\)\\.\\w+)\\s*[({]"), F.lit(1))).alias("c"))
    cast = cast.select("doc_id", F.regexp_replace("c", "\\([^)]*\\)", "").alias("call"))
    types = files.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("\\b([A-Z]\\w*\\s+(?:public\\s+|private\\s+|internal\\s+|immutable\\s+)*[a-z]\\w*)\\s*[;=,)]"), F.lit(1))).alias("d"))
    types = types.select("doc_id", F.element_at(F.split("d", "\\s+"), 1).alias("type"), F.element_at(F.split("d", "\\s+"), -1).alias("var")).distinct()
    uses = files.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("\\b([a-z]\\w*\\.\\w+)\\s*[({]"), F.lit(1))).alias("u"))
    uses = uses.select("doc_id", F.split_part("u", F.lit("."), F.lit(1)).alias("var"), F.split_part("u", F.lit("."), F.lit(2)).alias("fn"))
    typed = uses.join(types, ["doc_id", "var"]).select("doc_id", F.concat_ws(".", "type", "fn").alias("call"))
    return cast.unionByName(typed).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("call")), 1, most).alias("calls"))


def taint_flows(entries: DataFrame, calls: DataFrame, sinks: DataFrame, most_hops: int | None = None) -> DataFrame:
    """Parameters that reach a sink through internal calls: one flow per entry and
    parameter, to the nearest sink.

    ``entries``: file, fn, param (a position or a name).  ``calls``: file, caller,
    caller_param, callee, callee_param.  ``sinks``: file, fn, param, sink.  Frontier
    joins on (file, function, parameter) until nothing is new; an entry that has met a
    sink goes no further.  If ``most_hops`` is given and does not suffice, it raises.
    """
    key = ["file", "fn", "param"]
    front = _written(entries.select("file", F.col("fn").alias("entry"), F.col("param").alias("entry_param"), "fn", "param").distinct().withColumn("hops", F.lit(0)))
    seen, hop = front, 0
    c = calls.select("file", F.col("caller").alias("fn"), F.col("caller_param").alias("param"), "callee", "callee_param")
    while True:
        hop += 1
        done = front.join(sinks, key, "left_semi").select("file", "entry", "entry_param").distinct()
        step = front.join(done, ["file", "entry", "entry_param"], "left_anti").join(c, key).select("file", "entry", "entry_param", F.col("callee").alias("fn"), F.col("callee_param").alias("param")).distinct()
        new = _written(step.join(seen.drop("hops"), ["file", "entry", "entry_param", "fn", "param"], "left_anti").withColumn("hops", F.lit(hop)))
        if new.isEmpty():
            break
        _within(hop, most_hops)
        seen, front = _grown(seen, new.select(seen.columns), hop), new.select(seen.columns)
    hit = seen.join(sinks, key)
    return hit.groupBy("file", "entry", "entry_param").agg(F.min_by(F.struct("fn", "sink", "hops"), F.struct("hops", "fn", "sink")).alias("x")).select("file", "entry", "entry_param", "x.*")


def local_influence(statements: DataFrame) -> DataFrame:
    """Names that parameters influence inside a function: doc_id, fn, name, param.

    ``statements``: doc_id, fn, target, source (a name the assignment reads) and
    ``killed`` (the value comes from state or an index), as ``code.assignments``
    gives them.  Parameters are rows whose target is null.  Names are followed one
    assignment a round, until no new one is found.
    """
    statements = _written(statements)
    known = _written(statements.where("target IS NULL").select("doc_id", "fn", F.col("source").alias("name"), F.col("source").alias("param")).distinct())
    flow = statements.where("target IS NOT NULL AND NOT killed").select("doc_id", "fn", F.col("source").alias("name"), "target")
    front = known
    while True:
        step = front.join(flow, ["doc_id", "fn", "name"]).select("doc_id", "fn", F.col("target").alias("name"), "param").distinct()
        new = _written(step.join(known, ["doc_id", "fn", "name", "param"], "left_anti"))
        if new.isEmpty():
            break
        known, front = known.unionByName(new), new
    return known


#: A word list of up to this many words is an operand of the plan, a larger one is joined.
LIST_WORDS = 10_000


def mnemonic_scan(files: DataFrame, words: DataFrame, least: int = 12, list_words: int = LIST_WORDS) -> DataFrame:
    """Runs of ``least`` or more lower-case words that all stand in a word list:
    doc_id, start (word number), length.

    A list (``word``) of up to ``list_words`` words, counted first, is looked up inside
    each text's row, without a shuffle or a row for each word.  A larger one is joined by
    equality, and the places that it leaves meet per text.
    """
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def islands(places: Column) -> Column:
        first = F.filter(places, lambda x, i: ~F.get(places, i - 1).eqNullSafe(x - 1))
        last = F.filter(places, lambda x, i: ~F.get(places, i + 1).eqNullSafe(x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).cast("long").alias("length")))

    split = F.split(F.coalesce("text", F.lit("")), "[^a-z]+")
    known = words.where("word <> ''").select("word").distinct()
    listed = [r["word"] for r in known.limit(list_words + 1).collect()]
    if len(listed) <= list_words:
        found = F.array_compact(F.transform(split, lambda w, i: F.when(w.isin(*listed), i)))
        runs = files.select("doc_id", bind(found, islands).alias("runs"))
    else:
        w = files.select("doc_id", F.posexplode(split).alias("n", "word")).where("word <> ''")
        hit = w.join(known, "word", "left_semi")
        runs = hit.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("n")).select("doc_id", bind(F.col("n"), islands).alias("runs"))
    return runs.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*").where(F.col("length") >= least)


def tier_limit(rows: DataFrame, tiers: dict[str, int], key: str, tier: Column, order: list[str]) -> DataFrame:
    """The rows of each key that its tier allows (negative: no limit)."""
    from pyspark.sql import Window

    limit = F.coalesce(F.create_map(*[F.lit(x) for p in tiers.items() for x in p])[tier], F.lit(0))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("_l", limit).where((F.col("_l") < 0) | (F.col("_n") <= F.col("_l"))).drop("_n", "_l")
