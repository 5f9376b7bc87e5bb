"""Operator 8: shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id).  Boundaries between shards start
as a guess; every round counts the exact bytes and rows below probe keys across
all partitions, and narrows each boundary to the probes around its target, until
it is within the tolerance or between two neighbouring rows.  A boundary falls
between two texts if it can, so that equal texts share a shard; a text that
holds more bytes than the tolerance is cut by doc_id.  Then rows move once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import packed, quoted, ship, table, written
from auditspark.llm.packing import numbered

SHARDS = 16
#: Of a shard's share of the bytes.
TOLERANCE = 0.002
#: Probes for each open boundary and round.
PROBES = 31
_LOW, _HIGH = -(1 << 63), 1 << 63


def _below(rows: DataFrame, key: str, probes: list[int]) -> list[tuple[int, int]]:
    """(bytes, rows) with a key below each probe, counted exactly."""
    ship(rows.sparkSession)
    edges = np.array(probes, dtype=np.int64)

    def count(batches):
        size, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            cell = np.searchsorted(edges, b.column(0).to_numpy(), side="right")
            np.add.at(size, cell, b.column(1).to_numpy())
            np.add.at(n, cell, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(n[at])], ["cell", "bytes", "rows"])

    cells = rows.select(key, "size").mapInArrow(count, "cell long, bytes long, rows long")
    size, n = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
    for r in cells.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():  # at most a row per probe
        size[r["cell"]], n[r["cell"]] = r["bytes"], r["rows"]
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(n)[:-1].tolist(), strict=True))


def _boundaries(rows: DataFrame, key: str, targets: list[int], total: tuple[int, int], slack: float) -> list[dict]:
    """For each target the closest bracket found: keys lo <= boundary <= hi with
    the bytes and rows below each; ``at`` is the chosen key, if one is close enough."""
    found = [{"target": t, "lo": (_LOW, 0, 0), "hi": (_HIGH, *total), "at": None} for t in targets]
    while True:
        for b in found:
            if b["at"] is None:
                lo, hi = b["lo"], b["hi"]
                near = lo if b["target"] - lo[1] <= hi[1] - b["target"] else hi
                if abs(near[1] - b["target"]) <= slack or hi[2] - lo[2] <= 1:
                    b["at"] = near
        open_ = [b for b in found if b["at"] is None and b["hi"][0] - b["lo"][0] > 1]
        if not open_:
            return found
        probes = sorted({p for b in open_ for i in range(1, PROBES + 1) if b["lo"][0] < (p := b["lo"][0] + (b["hi"][0] - b["lo"][0]) * i // (PROBES + 1)) < b["hi"][0]})
        known = [(p, *x) for p, x in zip(probes, _below(rows, key, probes), strict=True)]
        for b in open_:
            for k in known:
                if b["lo"][0] < k[0] < b["hi"][0]:
                    if k[1] <= b["target"]:
                        b["lo"] = k
                    else:
                        b["hi"] = k
                        break


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """Boundaries (hash, doc_id or None): rows at or above one lie to its right."""
    size, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slack = tolerance * size / shards
    found = _boundaries(rows, "h", [size * i // shards for i in range(1, shards)], (size, n), slack)
    out = []
    for b in found:
        if b["at"]:
            out.append((b["at"][0], None))
            continue
        # One text (a single hash) lies across the target: cut it by doc_id.
        value, before, held = b["lo"][0], b["lo"], (b["hi"][1] - b["lo"][1], b["hi"][2] - b["lo"][2])
        inside = _boundaries(rows.where(F.col("h") == value), "id", [b["target"] - before[1]], held, slack)[0]
        near = inside["at"] or min(inside["lo"], inside["hi"], key=lambda x: abs(x[1] - inside["target"]))
        out.append((value, near[0]))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs`` plus size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and the checksum of no bytes.  Texts of any length count
    whole.  Rows without a doc_id order as id 0.  Repeated rows stay together.  An
    empty table gives an empty result.  Columns of ``docs`` that have one of the
    added names are replaced, all others stay whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size, h = (F.octet_length(text) + 1).cast("long"), F.xxhash64(text)
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = written(docs.select(size.alias("size"), h.alias("h"), ident.alias("id")), "sizes")
    cuts = splitters(rows, shards, tolerance)
    number = F.lit(0)
    for value, doc in cuts:
        if value >= _HIGH or value <= _LOW:
            number = number + F.lit(int(value <= _LOW))
        else:
            beyond = F.col("h") >= value if doc is None or doc <= _LOW else (F.col("h") > value) | ((F.col("h") == value) & (F.col("id") >= doc) if doc < _HIGH else F.lit(False))
            number = number + beyond.cast("int")
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in added])
    marked = packed(kept, size=size, text_crc32=F.crc32(text), law=F.lit("bytes"), h=h, id=ident).withColumnRenamed("row", "given")
    placed = numbered(marked.withColumn("shard", number.cast("int")), "shard", ["h", "id"], rows.count(), "slot")
    return placed.select("given.*", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
