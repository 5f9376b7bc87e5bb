"""Operator 4: exact duplicates by counting quotient filters.

Each partition builds a counting quotient filter of its fingerprints: the high
bits (quotient) name a run, which holds the sorted low bits (remainders) and
their counts.  Runs of one quotient merge without loss, remainder by remainder.
Only texts whose fingerprint counts more than one go on to the comparison of
their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import ascii_lower, fields_of, packed, ship, small, table, written

#: Fingerprints per run of the merged filter, on average.
RUN = 256
_FLUSH = 1 << 20


def _runs(values: np.ndarray, counts: np.ndarray, low: int):
    """Cut sorted fingerprints into runs by quotient."""
    quotient = values >> np.uint64(low)
    cuts = np.flatnonzero(np.diff(quotient)) + 1
    edges = [0, *cuts.tolist(), len(values)]
    remainder = (values & np.uint64((1 << low) - 1)).astype("<u8")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(quotient[a]), remainder[a:b].tobytes(), counts[a:b].astype("<i8").tobytes()


def quotient_filter(fingerprints: DataFrame, quotient_bits: int) -> DataFrame:
    """Merged runs (``quotient``, ``remainders``, ``counts``) of a column ``fp``."""
    ship(fingerprints.sparkSession)
    low = 64 - quotient_bits
    schema = pa.schema([("quotient", pa.int64()), ("remainders", pa.binary()), ("counts", pa.binary())])

    def rows(found):
        q, r, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.binary()), pa.array(c, pa.binary())], schema=schema)

    def build(batches):
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= _FLUSH:
                yield rows(list(_runs(*np.unique(np.concatenate(held), return_counts=True), low)))
                held, n = [], 0
        if n:
            yield rows(list(_runs(*np.unique(np.concatenate(held), return_counts=True), low)))

    def merge(batches):
        for b in batches:
            found = []
            for q, parts in zip(b.column("quotient").to_pylist(), b.column("runs").to_pylist(), strict=True):
                remainder = np.concatenate([np.frombuffer(p["remainders"], "<u8") for p in parts])
                count = np.concatenate([np.frombuffer(p["counts"], "<i8") for p in parts])
                order = np.argsort(remainder, kind="stable")
                remainder, count = remainder[order], count[order]
                first = np.flatnonzero(np.concatenate([[True], remainder[1:] != remainder[:-1]]))
                found.append((q, remainder[first].tobytes(), np.add.reduceat(count, first).astype("<i8").tobytes()))
            yield rows(found)

    kind = "quotient long, remainders binary, counts binary"
    parts = fingerprints.select("fp").mapInArrow(build, kind)
    # A run has one entry of a partition at most for each fingerprint, however often that occurs.
    return parts.groupBy("quotient").agg(F.collect_list(F.struct("remainders", "counts")).alias("runs")).mapInArrow(merge, kind)


def repeated(filter_runs: DataFrame, quotient_bits: int) -> DataFrame:
    """Fingerprints that count more than one: ``fp``, ``n``."""
    low = 64 - quotient_bits

    def look(batches):
        for b in batches:
            fps, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for q, r, c in zip(*(b.column(k).to_pylist() for k in ("quotient", "remainders", "counts")), strict=True):
                count = np.frombuffer(c, "<i8")
                many = count > 1
                fps.append(np.frombuffer(r, "<u8")[many] | np.uint64(q << low))
                ns.append(count[many])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(ns))], ["fp", "n"])

    return filter_runs.mapInArrow(look, "fp long, n long")


def exact_groups(docs: DataFrame, name: str = "text") -> DataFrame:
    """Groups of two or more rows with equal text after lower-casing A-Z:
    ``text_sha256``, ``keep_id`` (largest doc_id), ``group_size``."""
    norm = ascii_lower(F.coalesce(F.col(name), F.lit("")))
    keyed = docs.select("doc_id", norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    bits = min(40, max(4, math.ceil(math.log2(max(docs.count(), 1) / RUN + 1))))
    many = written(repeated(quotient_filter(keyed, bits), bits), "repeated")
    # Byte verification: the whole text is the key; equal texts of a task meet before the shuffle.
    candidates = keyed.join(small(many.select("fp"), 16), "fp", "left_semi")
    groups = candidates.groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return written(groups.where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text.  Of equal texts the largest doc_id stays (a
    null id only if there is no other); rows that repeat a doc_id *and* its text
    all report ``kept``.  Texts of any length are compared whole.  An empty table
    gives an empty result.  Other columns of ``docs`` are not used, so their names
    cannot clash.
    """
    groups = exact_groups(docs)
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = docs.select("doc_id", sha.alias("text_sha256"))
    out = rows.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they were.

    The row with the largest doc_id stays (a null id only if there is no other);
    of rows that repeat the id and the text of that one, one stays.
    """
    groups = exact_groups(docs).alias("g")
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    marked = packed(docs, id=F.col("doc_id"), sha=sha).alias("d").join(small(groups, 96), F.col("d.sha") == F.col("g.text_sha256"), "left")
    marked = marked.select("row", "id", "sha", "keep_id", F.col("text_sha256").isNull().alias("alone"))
    alone = marked.where("alone").select("row")
    stay = marked.where(~F.col("alone") & F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["sha"]).select("row")
    return fields_of(alone.unionByName(stay), docs)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
