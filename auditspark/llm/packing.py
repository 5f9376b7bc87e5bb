"""Operator 10: best-fit packing by minimum bin slack.

Pieces of documents are packed into sequences of a fixed capacity.  Only the
histogram of piece lengths (at most ``capacity`` rows) reaches the driver.  Per
bin, a bitset subset-sum over the lengths that are still available finds the
fullest combination with the longest of them; the combination is removed as
often as the histogram has it.  Pieces are then numbered per length in Spark and
look their place up in the list of combinations.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm import tokens
from auditspark.llm.common import ship, table, written

CAPACITY = 2048
END_ID = 0
#: Pieces per numbering bucket, on average over all lengths.
BUCKET_ROWS = 4096

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(available: dict[int, int], room: int) -> tuple[list[tuple[int, int]], int]:
    """The combination of available lengths with the largest sum up to ``room``.

    Bit i of a bitset says that sum i can be reached; each length enters in
    binary multiples.  Returns (length, copies) pairs and the sum.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, copies = min(available[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return sorted(used.items(), reverse=True), total


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations (lengths with copies) and how many sequences each one fills."""
    left = {length: n for length, n in histogram.items() if n > 0}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest, _ = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        used: dict[int, int] = {longest: 1}
        for length, copies in rest:
            used[length] = used.get(length, 0) + copies
        times = min(left[k] // v for k, v in used.items())
        for k, v in used.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        bins.append((sorted(used.items(), reverse=True), times))
    return bins


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: ids, then the end id, cut into full pieces
    from the end (the first piece takes the rest).  ``with_ids`` adds the ids as
    little-endian 32-bit integers."""
    ship(docs.sparkSession)
    path, ranks = tokens.vocabulary_path(vocabulary), tokens.ranks_of(vocabulary)

    def cut(batches):
        enc = tokens.encoder(path, ranks)
        for batch in batches:
            names = batch.column("doc_id")
            for first, _, ids, offsets in enc.slices(batch.column("text")):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), offsets.tolist()
                for i in range(len(bounds) - 1):
                    n = bounds[i + 1] - bounds[i] + 1
                    begin, k = 0, 0
                    while begin < n:
                        end = min(n, begin + ((n - begin) % capacity or capacity))
                        a, b = bounds[i] + begin, bounds[i] + end
                        body = bytes(raw[4 * a : 4 * b]) if end < n else bytes(raw[4 * a : 4 * b - 4]) + END_ID.to_bytes(4, "little")
                        row.append(first + i)
                        piece.append(k)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(zlib.crc32(body))
                        if with_ids:
                            data.append(body)
                        begin, k = end, k + 1
                columns = [names.take(pa.array(row, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                labels = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * with_ids, labels + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECE + ", ids binary" * with_ids)


def numbered(rows: DataFrame, group: str, identity: list[str], n: int, name: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group is dealt over hash buckets of the identity, so that one that holds a
    third of all rows still spreads over the tasks; bucket counts give each
    bucket's start.  Only rows that repeat a whole identity share a bucket.
    """
    buckets = max(1, n // BUCKET_ROWS)
    dealt = rows.select(F.struct("*").alias("row"), F.col(group).alias("of"), F.pmod(F.xxhash64(*identity), F.lit(buckets)).alias("bucket")).alias("d")
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("of", "bucket").agg(F.count("*").alias("n")).select("of", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).alias("s")
    inside = Window.partitionBy("d.of", "d.bucket").orderBy(*[F.col("d.row")[c] for c in identity])
    ranked = dealt.select("row", "of", "bucket", F.row_number().over(inside).alias("nth")).alias("d")
    joined = ranked.join(starts, (F.col("d.of") == F.col("s.of")) & (F.col("d.bucket") == F.col("s.bucket")))
    return joined.select("row.*", (F.col("start") + F.col("nth") - 1).alias(name))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Place every piece of every text in a sequence of at most ``capacity`` tokens.

    A null or empty text is one piece of the end id alone.  Repeated rows are
    packed one by one.  Texts of any length are encoded whole and cut.  An empty
    table gives an empty result.  Other columns of ``docs`` are not used, so their
    names cannot clash.
    """
    pieces = written(pieces_of(docs, capacity, vocabulary, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    n = sum(histogram.values())
    key, first, sequence, copies, offset = [], [], [], [], []
    used: dict[int, int] = {}
    filled = 0
    for lengths, times in minimum_bin_slack(histogram, capacity):
        at = 0
        for length, c in lengths:
            key.append(length << 48 | used.get(length, 0))
            first.append(used.get(length, 0))
            sequence.append(filled)
            copies.append(c)
            offset.append(at)
            used[length] = used.get(length, 0) + c * times
            at += c * length
        filled += times
    order = np.argsort(np.array(key, dtype=np.int64)) if key else np.zeros(0, dtype=np.int64)
    plan = [np.array(x, dtype=np.int64)[order] for x in (key, first, sequence, copies, offset)]

    def place(batches):
        keys, firsts, sequences, each, offsets = plan
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            nth, k = np.divmod(rank - firsts[at], each[at])
            kept = [c for c in b.schema.names if c != "rank"]
            columns = [b.column(c) for c in kept] + [pa.array(sequences[at] + nth), pa.array(offsets[at] + k * length)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    ranked = numbered(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], n)
    return ranked.mapInArrow(place, _PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(table(spark, sf_dir, "documents"))
