"""Operator 11: how far the sources of a language diverge in their words.

Late string materialization: what is counted and shuffled are 8-byte digests of
terms.  Only for digests that can be kept (frequent enough, which a collision can
but overstate) the smallest and the largest string behind a digest are found; where
they differ, the digest is split by a second one and its terms are counted again.
Text is joined back just for the terms of the result.

A pair of sources is compared over all kept terms, those that neither has
included.  A term is one row with its counts by source; a task adds the values of
the pairs up in blocks of sources, so no pair of a term is ever a row.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.common import few_rows, ship, small, table, written

#: A kept term occurs in at least this many documents of its language.
MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Sources of a language are compared in blocks of this many, and a task holds the
#: sums of at most so many pairs of blocks before it passes them on.
BLOCK = 256
HELD = 16
#: Counts of so many different (group, term) entries are held by a task at most.
ENTRIES = 1 << 18

#: Bytes that end a term become spaces, A-Z become small letters; all bytes of
#: characters beyond ASCII stay.
_TERM_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def _digest(term: bytes, seed: int, bits: int) -> int:
    """The leading ``bits`` of a term's hash as a signed long."""
    d = xxhash.xxh64_intdigest(term, seed) >> 64 - bits
    return d - (1 << 64) if d >> 63 else d


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _digest_counts(docs: DataFrame, bits: int, split: list[int] | None = None, seed: int = 0) -> DataFrame:
    """``lang``, ``source``, ``digest``, ``part``, ``n``, ``docs``, added up within
    each task as far as ``ENTRIES`` reach.  With ``split``: only terms of these digests,
    ``part`` being their digest by another ``seed``."""
    only = None if split is None else np.array(split, np.int64)

    def rows(held):
        columns = [[] for _ in range(6)]
        for (lang, source), (total, docs) in held.items():
            terms = list(total)
            digest = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64) >> np.uint64(64 - bits)
            digest, n = digest.view(np.int64), np.fromiter(total.values(), np.int64, len(terms))
            found = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            part = np.zeros(len(terms), np.int64)
            if only is not None:
                at = np.flatnonzero(np.isin(digest, only))
                digest, n, found = digest[at], n[at], found[at]
                part = np.array([_digest(terms[i], seed, 64) for i in at.tolist()], np.int64)
            for c, x in zip(columns, (pa.array([lang]).take(pa.array(np.zeros(len(n), np.int64))), pa.array([source]).take(pa.array(np.zeros(len(n), np.int64))), digest, part, n, found), strict=True):
                c.append(x)
        strings = [pa.chunked_array(c, pa.string()).combine_chunks() for c in columns[:2]]
        return pa.RecordBatch.from_arrays([*strings, *(pa.array(np.concatenate(c)) for c in columns[2:])], ["lang", "source", "digest", "part", "n", "docs"])

    def count(batches):
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for b in few_rows(batches):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                total, docs = held[lang, source]
                terms, before = _terms(text), len(docs)
                total.update(terms)
                docs.update(set(terms))
                size += len(docs) - before
            if size >= ENTRIES:
                yield rows(held)
                held.clear()
                size = 0
        if size:
            yield rows(held)

    parts = _named(docs).mapInArrow(count, "lang string, source string, digest long, part long, n long, docs long")
    return parts.groupBy("lang", "source", "digest", "part").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _strings(docs: DataFrame, wanted: DataFrame, bits: int, seeds: dict[int, int]) -> DataFrame:
    """``digest``, ``part``, ``low``, ``high``: the smallest and the largest term behind
    each digest of ``wanted``.  A task names a term once for each ``ENTRIES`` terms."""

    def name(batches):
        seen: set[bytes] = set()
        for b in few_rows(batches):
            new: set[bytes] = set()
            for text in b.column("text").to_pylist():
                new.update(_terms(text))
            new -= seen
            if len(seen) + len(new) > ENTRIES:
                seen.clear()
            seen |= new
            terms = list(new)
            first = [_digest(t, 0, bits) for t in terms]
            part = [_digest(t, seeds[d], 64) if d in seeds else 0 for t, d in zip(terms, first, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(part, pa.int64()), pa.array([t.decode() for t in terms], pa.string())], ["digest", "part", "term"])

    named = _named(docs).select("text").mapInArrow(name, "digest long, part long, term string")
    return named.join(wanted, ["digest", "part"], "left_semi").groupBy("digest", "part").agg(F.min("term").alias("low"), F.max("term").alias("high"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms (``lang``, ``source``, ``digest``, ``part``, ``n``) and
    their strings (``digest``, ``part``, ``term``).  ``bits`` shortens the first digest;
    results do not depend on it.

    The digests that stand for several terms are the only ones that reach the driver.
    Of T terms about T * T / 2**65 do: fewer than three of 10**10 terms.
    """
    seeds: dict[int, int] = {}  # of digests that were split: the seed of their second digest
    counts = written(_digest_counts(docs, bits), "term-counts")
    while True:
        often = counts.groupBy("lang", "digest", "part").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        often = written(often.select("lang", "digest", "part"), "kept-terms")
        wanted = often.select("digest", "part").distinct()
        names = written(_strings(docs, small(wanted, 32, often.count()), bits, seeds), "term-names")
        clash = [r["digest"] for r in names.where("low <> high").select("digest").distinct().collect()]
        if not clash:
            kept = counts.join(often, ["lang", "digest", "part"], "left_semi")
            return written(kept.select("lang", "source", "digest", "part", "n"), "kept-counts"), names.select("digest", "part", F.col("low").alias("term"))
        seed = 1 + max((seeds.get(d, 0) for d in clash), default=0)
        seeds |= dict.fromkeys(clash, seed)
        marked = small(docs.sparkSession.createDataFrame([(d,) for d in clash], "digest long"), 16, len(clash))
        again = _digest_counts(docs, bits, clash, seed)
        counts = written(counts.join(marked, "digest", "left_anti").select(*again.columns).unionByName(again), "term-counts")


def _p(n, total, terms):
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); exact beyond 64 bits."""
    wide = (n.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)"))).cast("long")


def _f(p, q):
    d = p - q
    return F.call_function("div", d * d, p + q)


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """``lang``, ``i``, ``j``, ``value``: sums over all rows of f(p of source i, p of
    source j).  A row has a term's ``at`` (places of sources that have it, from 0),
    ``ps`` (its p there) and ``zeros`` (p of a term that is not there, for all sources)."""

    def add(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            lang, i, j, value = [], [], [], []
            for (g, bi, bj), sums in held.items():
                a, c = np.indices(sums.shape).reshape(2, -1)
                lang += [g] * a.size
                i.append(a + bi * BLOCK)
                j.append(c + bj * BLOCK)
                value.append(sums.ravel())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (i, j, value))], ["lang", "i", "j", "value"])

        for b in few_rows(batches, 512):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            ats, ps, zeros = (b.column(c) for c in ("at", "ps", "zeros"))
            for lang in dict.fromkeys(langs.tolist()):
                rows = np.flatnonzero(langs == lang).tolist()
                zero = zeros[rows[0]].values.to_numpy(zero_copy_only=False)
                dense = np.tile(zero, (len(rows), 1))
                for k, r in enumerate(rows):
                    dense[k, ats[r].values.to_numpy(zero_copy_only=False)] = ps[r].values.to_numpy(zero_copy_only=False)
                for bi in range(0, len(zero), BLOCK):
                    for bj in range(bi, len(zero), BLOCK):
                        key = (lang, bi // BLOCK, bj // BLOCK)
                        x, y = dense[:, bi : bi + BLOCK], dense[:, bj : bj + BLOCK]
                        if key not in held:
                            if len(held) >= HELD:
                                yield out()
                            held[key] = np.zeros((x.shape[1], y.shape[1]), np.int64)
                        for s in range(x.shape[1]):
                            p = x[:, s : s + 1]
                            held[key][s] += ((p - y) ** 2 // (p + y)).sum(axis=0)
        if held:
            yield out()

    sums = vectors.mapInArrow(add, "lang string, i long, j long, value long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank``.

    ``pair``: the distance of a source to each other source of its language, over all
    terms kept in that language.  ``term``: the ``top`` terms that it has more of than
    its language.  Equal values rank by the UTF-8 bytes of the item.

    Null text, lang and source count as the empty string.  Repeated rows count each.
    Texts of any length are read whole.  A group without terms, and a language without
    kept terms, still has its pairs, with value 0 if nothing is kept.  A source that is
    alone in its language has no pairs.  An empty table gives an empty result.  Other
    columns of ``docs`` are not used, so their names cannot clash; there is no doc_id.
    """
    ship(docs.sparkSession)
    counts, names = term_counts(docs, min_docs, bits)
    sources = _named(docs).select("lang", "source").distinct()
    in_lang = Window.partitionBy("lang").orderBy("source")  # a row per source of a language, not per document
    sources = sources.select("lang", "source", (F.row_number().over(in_lang) - 1).alias("place"))
    by_lang = written(counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("in_lang")), "counts-of-languages")
    totals = by_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sources.join(own, ["lang", "source"], "left").join(totals, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = written(groups.withColumn("zero", F.when(F.col("terms") > 0, _p(F.lit(0), F.col("total"), F.col("terms")))), "groups")
    n_groups = groups.count()

    known = counts.join(small(groups.select("lang", "source", "place", "total", "terms"), 96, n_groups), ["lang", "source"])
    known = known.select("lang", "source", "digest", "part", "place", _p(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    vectors = known.groupBy("lang", "digest", "part").agg(F.collect_list(F.struct("place", "p")).alias("v"))  # an entry per source
    zeros = groups.where("terms > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "zero"))).alias("z"))
    zeros = zeros.select("lang", F.col("z.zero").alias("zeros"))
    vectors = vectors.select("lang", F.col("v.place").alias("at"), F.col("v.p").alias("ps")).join(small(zeros, 64, 64 + n_groups), "lang")
    sums = written(_pair_sums(vectors), "pair-sums")
    # Blocks (i, j) and (j, i) have the same sums; only one of them was made.
    both = sums.where(f"j div {BLOCK} > i div {BLOCK}").select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value").unionByName(sums)
    a, b = groups.select("lang", "source", F.col("place").alias("i")), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("j"))
    pairs = a.join(b, "lang").where("i <> j").join(both, ["lang", "i", "j"], "left")  # these pairs are the result
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    lang_p = by_lang.join(small(totals, 64), "lang").select("lang", "digest", "part", _p(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    higher = known.join(lang_p, ["lang", "digest", "part"]).where("p > q").withColumn("value", _f(F.col("p"), F.col("q")))
    best = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))  # tasks keep the first ones before the shuffle
    shown = higher.withColumn("best", best).where(F.col("best") <= top).select("lang", "source", "digest", "part", "value")
    shown = written(shown, "shown-terms")
    texts = shown.join(names, ["digest", "part"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = texts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT nr, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY 1, 2 HAVING count(DISTINCT nr) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM kept GROUP BY 1),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (coalesce(own.total, 0) + 2 * v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) JOIN t USING (lang) LEFT JOIN own USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (in_lang + 2) // (total + 2 * v) AS BIGINT) AS q FROM kept JOIN t USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
