"""Operator 6: near duplicates by SimHash and a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments; the bit counts of the segments
are a point of a grid.  Each differing bit moves one count by one at most, so
the Manhattan distance of two points is at most the number of differing bits.
Written in unary (the bits of a segment sorted) a point is again a 64-bit word
and that distance is the number of differing bits of two such words.

The range join on the grid: with the segments in B blocks, points at distance 3
or less agree in at least B - 3 whole blocks, so every pair meets in one of the
projections onto B - 3 blocks.  Projected cells are joined by equality, pairs in
a cell are cut by the Manhattan distance and then verified on the fingerprints.
A cell returns a spanning forest of its links, not its pairs.  With segments of two
bits the bound is close to the distance itself and the projections do most of the
work; wider segments would cut fewer pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import few_rows, fields_of, packed, ship, small, table, written
from auditspark.llm.components import connected_components

DISTANCE = 3
SHINGLE = 3
#: A cell with more points is cut into parts of half this size, of which every two
#: are then a cell, or, if that were too many parts, projected again.
CELL = 1024
#: Strides that strew the 64 bits over blocks, one for each further projection.
_STEPS = (1, 5, 11)
_SLICE = 1 << 17


def fingerprints(docs: DataFrame, width: int = SHINGLE, more: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) and the long columns
    ``more`` of every whole text."""
    ship(docs.sparkSession)
    more = more or []

    def one(text: str | None) -> int:
        words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
        if not words:
            return 0
        line = b" ".join(words)
        if len(words) <= width:
            return xxhash.xxh64_intdigest(line, 42)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1]
        stops = ends[width - 1 :] - 1
        ones, digest, n = np.zeros(64, np.int64), xxhash.xxh64_intdigest, len(starts)
        for i in range(0, n, _SLICE):
            part = [digest(line[a:b], 42) for a, b in zip(starts[i : i + _SLICE].tolist(), stops[i : i + _SLICE].tolist(), strict=True)]
            bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])

    def apply(batches):
        for b in few_rows(batches):
            fps = np.array([one(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)), *(b.column(c) for c in more)], ["doc_id", "fp", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(apply, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def embed(x):
    """Unary popcounts of the 2-bit segments, as a column."""
    even = 0x5555555555555555
    low, high = x.bitwiseAND(F.lit(even)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(even))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def block_masks(blocks: int) -> list[int]:
    """Signed masks over ``blocks`` groups of whole segments."""
    edges = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return masks


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the points within ``distance``."""
    n = len(fps)
    unseen, links = np.arange(n), []
    even = np.uint64(0x5555555555555555)
    low, high = fps & even, fps >> np.uint64(1) & even
    points = low | high | (low & high) << np.uint64(1)
    while len(unseen):
        front, unseen = [int(unseen[0])], unseen[1:]
        while front and len(unseen):
            x = front.pop()
            near = np.bitwise_count(points[unseen] ^ points[x]) <= distance  # Manhattan distance of the popcounts
            at = unseen[near]
            at = at[np.bitwise_count(fps[at] ^ fps[x]) <= distance]
            if len(at):
                links += [(x, int(y)) for y in at]
                front += at.tolist()
                unseen = np.setdiff1d(unseen, at, assume_unique=True)
    return links


def spread_masks(level: int, blocks: int) -> list[int]:
    """Masks over ``blocks`` groups of single bits; each level strews them anew."""
    return [sum(1 << b for b in range(64) if (b * _STEPS[level] % 67) % blocks == i) for i in range(blocks)]


def _projections(masks: list[int], distance: int) -> list[int]:
    """Signed unions of all but ``distance`` of ``masks``."""
    tables = [sum(kept) for kept in combinations(masks, len(masks) - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in tables]


def meeting_cells(points: DataFrame, distance: int = DISTANCE, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Lists ``fps`` of about ``cell`` points at most, such that every two points
    within ``distance`` bits share a list.

    A full cell is dealt in pairs of parts as long as that copies its points no more
    often than projecting them again would.  A larger one is split by projections of
    the fingerprints themselves, onto blocks of other bits, which its pairs within
    ``distance`` survive likewise; so a point has a bounded number of copies at each
    level however many near copies meet in one cell.  What is full after the last
    level (at most some bits are free by then) is dealt in pairs of parts.
    """
    n = points.count()
    if blocks is None:  # more blocks: longer keys, fewer chance meetings, more copies of a point
        blocks = distance + 3 if n < 1 << 25 else distance + 5
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(_projections(block_masks(blocks), distance))])
    probes = points.select("fp", embed(F.col("fp")).alias("e")).select("fp", F.explode(keys).alias("cell"))
    part, found = cell // 2, None
    for level in range(len(_STEPS) + 1):
        counts = written(probes.groupBy("cell").count().where("count > 1"), "cells")
        finer = _projections(spread_masks(level, distance + 3), distance) if level < len(_STEPS) else None
        most = len(finer) * part if finer else None
        huge = F.lit(False) if most is None else F.col("count") > most
        n_full, n_huge = (x or 0 for x in counts.agg(F.sum((F.col("count") > cell).cast("long")), F.sum(huge.cast("long"))).first())
        members = probes.join(counts.where(F.col("count") <= cell).select("cell"), "cell", "left_semi")
        cells = members.groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps")  # at most `cell` entries
        if n_full > n_huge:
            parts = F.ceil(F.col("count") / part).cast("int")
            own = F.expr(f"cast(pmod(xxhash64(fp, 7), ceil(count / {part})) as int)")
            full = counts.where((F.col("count") > cell) & ~huge)
            inside = probes.join(small(full, 24, n_full - n_huge), "cell").select("cell", "fp", parts.alias("parts"), own.alias("own"))
            pairs = inside.select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            dealt = pairs.groupBy("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
            cells = cells.unionByName(dealt.select("fps"))
        found = cells if found is None else found.unionByName(cells)
        if not n_huge:
            break
        keys = F.array(*[F.xxhash64("cell", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(finer)])
        probes = written(probes.join(small(counts.where(huge).select("cell"), 16, n_huge), "cell").select("fp", F.explode(keys).alias("cell")), "finer-cells")
    return found


def near_links(points: DataFrame, distance: int = DISTANCE, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``, unique)
    whose components equal those of all pairs within ``distance`` bits."""
    ship(points.sparkSession)
    cells = meeting_cells(points, distance, blocks, cell)

    def link(batches):
        for b in batches:
            lists = b.column("fps")
            flat = lists.values.to_numpy().view(np.uint64)
            edges = lists.offsets.to_numpy()
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            x, y = flat[two], flat[two + 1]
            close = np.bitwise_count(x ^ y) <= distance
            a, c = [x[close]], [y[close]]
            for i in np.flatnonzero(size > 2).tolist():
                fps = np.unique(flat[edges[i] : edges[i + 1]])
                if links := _forest(fps, distance):
                    p, q = np.array(links).T
                    a.append(fps[p])
                    c.append(fps[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(c).view(np.int64))], ["a", "b"])

    return cells.mapInArrow(link, "a long, b long")


def _classes(fps: DataFrame, distance: int) -> DataFrame:
    """``fp``, ``root`` (the fingerprint that names its component), ``component_id``."""
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = written(connected_components(near_links(points.select("fp"), distance)), "roots")
    grouped = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(grouped.join(firsts, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id that
    links of ``distance`` bits or fewer reach).

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Texts of any length are read whole, in slices of shingles.  Repeated rows each
    get a row.  Rows without a doc_id take part; a component of only such rows has
    a null id.  An empty table gives an empty result.  Other columns of ``docs``
    are not used, so their names cannot clash.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    return fps.join(_classes(fps, distance).drop("root"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, columns as they were.

    Every row is judged by its doc_id and its text: the smallest doc_id stays (a
    null id only if there is no other), of its rows the one with the smallest hash
    of the text, and of rows that repeat both, one.
    """
    known = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    fps = written(fingerprints(known, width, ["digest"]), "fingerprints")
    classes = _classes(fps, distance)
    rows = fps.join(classes.select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    groups = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(order).alias("stays")).where("n > 1")
    groups = written(groups.select("root", "stays.id", "stays.of"), "near-groups")
    members = written(rows.join(small(groups, 40), "root").select("root", "doc_id", "digest", (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).alias("stays")).distinct(), "near-members").alias("m")
    marked = packed(docs, id=F.col("doc_id"), of=F.xxhash64("text")).alias("d")
    marked = marked.join(small(members, 40), F.col("d.id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.of") == F.col("m.digest")), "left").select("row", "root", "stays")
    alone = marked.where("stays IS NULL").select("row")
    return fields_of(alone.unionByName(marked.where("stays").dropDuplicates(["root"]).select("row")), docs)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
