"""Operator 12: Jaccard join on word shingles by signature trees.

A set of shingles has a signature: a bitmap of at least twice as many bits as it has
shingles, every shingle setting one.  Two sets share at most

    bits that both bitmaps have + the smaller of the two excesses

shingles, the excess of a set being its size less the bits of its bitmap.  A node of
a signature tree holds the OR of the bitmaps below it, the largest excess and the
range of sizes, so the same sum bounds the overlap of any two sets below two nodes.
Two trees are walked together from their roots; a pair of nodes whose bound is less
than the smallest sizes below them need is left out with all that is below it.

The trees hang below a level that Spark deals out: all sets that have a token in
their prefix (the first n - ceil(0.8 n) + 1 tokens in one order of all tokens; sets
that link share one of these) are a node of it.  That order puts tokens that occur often
last, so nodes of a passage that many texts quote stay small.  The join runs twice:

* over signatures: which sets, among those that meet in a node, cannot be told apart by
  bound (candidates); connected candidates are a family;
* over whole sets, each sent to its family once: the same walk, then exact overlaps.

Equal sets are one class from the start, so copies cost one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.common import few_rows, ship, small, table, written
from auditspark.llm.components import connected_components

WIDTH = 5
#: Similarity as a percentage.
SIMILAR = 80
#: A node with more sets, or more shingles in all of them, is cut into parts.
PART = 512
PART_TOKENS = 1 << 20
#: Tokens that repeat within some ``HELD`` tokens of a task, from this many repeats on,
#: are ordered last; the bound of their number decides how many repeats that takes.
#: Which ones they are changes only the work, not the result.
OFTEN = 8
OFTEN_BOUND = 1 << 20
#: Tokens in which a task looks for repeats at a time.
HELD = 1 << 22
FAN = 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _tokens(text: str | None, width: int, words_known: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit digests."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:  # one token; the prefix keeps it apart from shingles
        return np.array([xxhash.xxh64_intdigest(b"\n" + b" ".join(words), 42)], np.uint64)
    hashes = []
    for w in words:
        if (h := words_known.get(w)) is None:
            if len(words_known) > 1 << 17:
                words_known.clear()
            h = words_known[w] = xxhash.xxh64_intdigest(w, 42)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):  # each place has a multiplier of its own
        total += h[i : i + n] * (_MIX[i % 5] + np.uint64(2 * (i // 5)))
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    return np.unique(total)


def _bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def _signature(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as 64-bit words."""
    bits = np.zeros(_bits(len(tokens)), np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _narrowed(signature: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has with fewer bits."""
    return np.bitwise_or.reduce(signature.reshape(-1, words), axis=0)


class Tree:
    """Levels of nodes from the leaves (one set each) to the root.  Sets are given by
    rising size; node i of a level stands above nodes FAN * i to FAN * i + FAN - 1."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        excess = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, excess, sizes, sizes)]
        while len(self.levels[-1][1]) > 1:
            bitmaps, excess, low, high = self.levels[-1]
            at = np.arange(0, len(excess), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmaps, at, axis=0), np.maximum.reduceat(excess, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def walk(a: Tree, b: Tree, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (of ``a``, of ``b``) that no bound rules out; with ``a`` is ``b``,
    the first before the second."""
    i = j = np.zeros(1, np.int64)
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    for level in range(max(top_a, top_b), -1, -1):
        la, lb = min(level, top_a), min(level, top_b)
        (ma, ea, low_a, high_a), (mb, eb, low_b, high_b) = a.levels[la], b.levels[lb]
        # 100 * overlap >= similar * (both sizes - overlap), and no overlap exceeds the largest sizes
        need = similar * (low_a[i] + low_b[j])
        stay = (100 + similar) * np.minimum(high_a[i], high_b[j]) >= need
        i, j, need = i[stay], j[stay], need[stay]
        over = np.empty(len(i), np.int64)
        step = max(1, (1 << 20) // ma.shape[1])
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            over[at : at + step] = np.bitwise_count(ma[p] & mb[q]).sum(axis=1, dtype=np.int64)
        over += np.minimum(ea[i], eb[j])
        stay = (100 + similar) * over >= need
        i, j = i[stay], j[stay]
        if level == 0 or not len(i):
            break
        down_a, down_b = FAN if level <= top_a else 1, FAN if level <= top_b else 1
        i = (i[:, None] * down_a + np.repeat(np.arange(down_a), down_b)).ravel()
        j = (j[:, None] * down_b + np.tile(np.arange(down_b), down_a)).ravel()
        stay = (i < len(a.levels[min(level - 1, top_a)][1])) & (j < len(b.levels[min(level - 1, top_b)][1]))
        if a is b:
            stay &= i <= j
        i, j = i[stay], j[stay]
    if a is b:
        i, j = i[i < j], j[i < j]
    return i, j


def _near(sizes: np.ndarray, signatures: list[np.ndarray], similar: int):
    """Arrays of pairs of members that no bound rules out.  Bitmaps have one width in
    a tree: sets are taken with those of their own and, narrowed, of the next width.
    A set that links has at most 5 / 4 as many shingles, so no other width matters
    (for ``similar`` of 50 and more)."""
    words = np.array([len(s) for s in signatures])
    for w in np.unique(words).tolist():
        own, wider = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        own = own[np.argsort(sizes[own], kind="stable")]
        tree = Tree(sizes[own], np.array([signatures[k] for k in own.tolist()]))
        i, j = walk(tree, tree, similar)
        yield own[i], own[j]
        if len(wider):
            wider = wider[np.argsort(sizes[wider], kind="stable")]
            i, j = walk(tree, Tree(sizes[wider], np.array([_narrowed(signatures[k], w) for k in wider.tolist()])), similar)
            yield own[i], wider[j]


def _forest(count: int, sizes, signatures, similar: int, sets=None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members; with ``sets``, links are verified."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in _near(sizes, signatures, similar):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(x), find(y)
            if a == b:
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both < similar * (len(sets[x]) + len(sets[y]) - both):
                    continue
            root[a] = b
            links.append((x, y))
    return links


def _links(slots: DataFrame, similar: int, whole: bool) -> DataFrame:
    """``a``, ``b``: spanning forests of the slots (``members``: class, n, data).  Data
    are whole sets or signatures."""

    def link(batches):
        for b in few_rows(batches, 16):
            a, c = [], []
            for members in b.column("members").to_pylist():
                sizes = np.array([m["n"] for m in members], np.int64)
                data = [np.frombuffer(m["data"], "<u8") for m in members]
                found = _forest(len(members), sizes, [_signature(s) for s in data] if whole else data, similar, data if whole else None)
                a += [members[x]["class"] for x, _ in found]
                c += [members[y]["class"] for _, y in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    dealt = slots.groupBy("cell", "i", "j").agg(F.collect_list(F.struct("class", "n", "data")).alias("members"))  # bounded by the parts
    return dealt.where(F.size("members") > 1).select("members").mapInArrow(link, "a long, b long")


def _joined(cells: DataFrame, data: DataFrame, similar: int, whole: bool) -> DataFrame:
    """``node``, ``root`` of the classes that links within cells connect.

    cells: ``cell``, ``class``, ``n``, each pair once; data: ``class``, ``data``.  A large
    cell is cut into parts.  First each part meets itself and the next one; pairs of parts
    that are not of one component by then meet in a second round.
    """
    stats = cells.groupBy("cell").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("members") / PART), F.ceil(F.col("tokens") / PART_TOKENS)).cast("long")
    large = written(stats.select("cell", parts.alias("parts")).where("parts > 1"), "large-cells")
    n_large = large.count()
    rows = cells.join(small(large, 32, n_large), "cell", "left").withColumn("part", F.coalesce(F.expr("pmod(xxhash64(class, 3), parts)"), F.lit(0)))
    slots = rows.withColumn("i", F.explode(F.when((F.col("part") > 0), F.array("part", F.col("part") - 1)).otherwise(F.array("part"))))
    slots = slots.select("cell", "i", (F.col("i") + 1).alias("j"), "class", "n")
    links = written(_links(slots.join(data, "class"), similar, whole), "links")
    roots = written(connected_components(links), "roots")
    if not n_large:
        return roots
    members = written(rows.where("parts > 1").join(roots.withColumnRenamed("node", "class"), "class", "left").select("cell", "class", "n", "parts", "part", F.coalesce("root", "class").alias("root")), "large-members")
    spans = members.groupBy("cell", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_cells = spans.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("cell")
    a, b = (spans.select("cell", *[F.col(c).alias(f"{c}{k}") for c in ("part", "low", "high")]) for k in "ab")
    pairs = a.join(open_cells, "cell").join(b, "cell").where("parta + 1 < partb AND (lowa <> higha OR lowb <> highb OR lowa <> lowb)")
    pairs = pairs.select("cell", F.col("parta").alias("i"), F.col("partb").alias("j"))
    pairs = written(pairs, "open-parts")
    if pairs.isEmpty():
        return roots
    sides = pairs.select("*", F.explode(F.array("i", "j")).alias("part"))
    second = members.join(sides, ["cell", "part"]).select("cell", "i", "j", "class", "n").join(data, "class")
    more = _links(second, similar, whole).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return written(connected_components(written(more, "links")), "roots")


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.tobytes(), len(t)) for t in sets], np.uint64).view(np.int64)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts.  Rows of documents: ``doc_id``, ``class`` (digest of the
    set), ``n``, ``data`` (signature).  Rows of tokens that repeat within a batch: ``token``,
    ``times``."""

    names = ["doc_id", "class", "n", "data", "token", "times"]

    def repeats(seen):
        token, times = np.unique(np.concatenate(seen), return_counts=True)
        token, times = token[times > 1], times[times > 1]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(times.astype(np.int64))], names)

    def look(batches):
        known: dict[bytes, int] = {}
        seen, held = [], 0
        for b in few_rows(batches):
            sets = [_tokens(text, width, known) for text in b.column("text").to_pylist()]
            sizes = np.array([len(t) for t in sets], np.int64)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(_classes(sets)), pa.array(sizes), pa.array([_signature(t).tobytes() for t in sets], pa.binary()), none, none], names)
            seen += sets
            held += int(sizes.sum())
            if held > HELD:
                yield repeats(seen)
                seen, held = [], 0
        if held:
            yield repeats(seen)

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, class long, n long, data binary, token long, times long")


def _often(repeats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that repeat most, sorted, and how often: at most OFTEN_BOUND."""
    times = written(repeats.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN), "often")
    power = F.floor(F.log2("times")).cast("long").alias("power")
    steps = sorted(((r["power"], r["count"]) for r in times.groupBy(power).count().collect()), reverse=True)  # one row a power of two
    room, least = OFTEN_BOUND, 63
    for at, n in steps:
        if n > room:
            break
        room, least = room - n, at
    rows = times.where(power >= least).toArrow()  # of counted size
    tokens, n = rows.column("token").to_numpy().view(np.uint64), rows.column("times").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _prefixes(docs: DataFrame, width: int, similar: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``token``, ``class``, ``n``: the prefix tokens of every set that is not empty."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def emit(batches):
        known: dict[bytes, int] = {}
        hot, times = shared.value
        done: set[int] = set()
        for b in few_rows(batches):
            sets = [t for text in b.column("text").to_pylist() if len(t := _tokens(text, width, known))]
            out, classes, sizes = [np.zeros(0, np.uint64)], [], []
            for t, c in zip(sets, _classes(sets).tolist(), strict=True):
                if c in done:  # a copy
                    continue
                if len(done) > 1 << 17:
                    done.clear()
                done.add(c)
                n = len(t)
                k = n - -(-similar * n // 100) + 1
                rank = np.zeros(n, np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                    rank = np.where(hot[at] == t, times[at], 0)
                out.append(t[np.argsort(rank, kind="stable")[:k]])  # rare ones first, then by digest
                classes += [c] * k
                sizes += [n] * k
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64())], ["token", "class", "n"])

    return docs.select("text").mapInArrow(emit, "token long, class long, n long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``class``, ``data`` (whole set) of every document."""

    def emit(batches):
        known: dict[bytes, int] = {}
        for b in few_rows(batches):
            sets = [_tokens(text, width, known) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_classes(sets)), pa.array([t.tobytes() for t in sets], pa.binary())], ["class", "data"])

    return docs.select("text").mapInArrow(emit, "class long, data binary")


def jaccard_join(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest
    doc_id that links of ``similar`` percent or more reach).

    Null, empty and blank texts have no shingles and link with nothing; their
    component is their own id.  Fewer words than ``width`` are one shingle.  Texts of any
    length are read whole; copies and repeated rows are one class.  Rows without a
    doc_id take part; a component of only such rows has a null id.  An empty table
    gives an empty result.  Other columns of ``docs`` are not used, so their names
    cannot clash.

    Shingles and sets are compared by 64-bit digests.
    """
    ship(docs.sparkSession)
    survey = written(_survey(docs, width), "survey")
    rows = survey.where("n IS NOT NULL")
    often = _often(survey.where("token IS NOT NULL"))
    # One exchange by token serves the copies, the counts and the digests of who meets.
    prefixes = _prefixes(docs, width, similar, often).repartition("token").distinct()
    of = Window.partitionBy("token")
    met = [F.count("*").over(of).alias("k"), *[F.bit_xor(F.xxhash64("class", F.lit(i))).over(of).alias(c) for i, c in enumerate("xy")]]
    meeting = written(prefixes.select("*", *met).where("k > 1"), "meeting")
    # Tokens that meet the same sets, as all of one passage do, are one cell.
    chosen = meeting.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token")
    cells = written(meeting.join(chosen, "token", "left_semi").select(F.col("token").alias("cell"), "class", "n"), "cells")
    taking_part = cells.select("class").distinct()
    signatures = rows.join(taking_part, "class", "left_semi").groupBy("class").agg(F.first("data").alias("data"))
    families = _joined(cells, written(signatures, "signatures"), similar, whole=False)

    firsts = rows.groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    firsts = written(firsts, "classes")
    together = written(families.withColumnRenamed("node", "class").join(firsts, "class").select("class", F.col("root").alias("cell"), "n", "first"), "families")
    # One row of each class gives its set: the one with the smallest doc_id (several rows may share it).
    one = together.select("class", F.col("first").alias("id"))
    named = rows.select("doc_id", "class").join(small(one, 32), "class").where(F.col("doc_id").eqNullSafe(F.col("id")))
    ids = named.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select("doc_id", "text").join(small(ids, 16), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = _sets(texts, width).groupBy("class").agg(F.first("data").alias("data"))
    roots = _joined(together.select("cell", "class", "n"), written(sets, "sets"), similar, whole=True)

    grouped = firsts.where("n > 0").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    found = written(grouped.join(least, "root").select("class", "component_id"), "components")
    out = rows.select("doc_id", "class", "n").join(small(found, 16), "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))
