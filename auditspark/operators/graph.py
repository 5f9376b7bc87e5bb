"""Graphs of files and calls: closures, reachability, neighbours, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.shared import written


def _written(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def _within(hops: int, most_hops: int | None) -> None:
    if most_hops is not None and hops > most_hops:
        raise ValueError(f"nodes lie more than {most_hops} hops away; the result would be cut")


def _grown(seen: DataFrame, new: DataFrame, hops: int) -> DataFrame:
    """``seen`` with ``new``; written as one table every few rounds, so that a long
    chain does not become a union of as many tables."""
    both = seen.unionByName(new)
    return both if hops % 16 else _written(both)


def closure(seeds: DataFrame, edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """``node`` and least ``hops`` of all nodes that edges (src -> dst) reach.

    A frontier loop: each round joins the newest nodes with the edges and drops
    those seen before.  Rounds are written to the shared folder, so the plan
    stays short and a lost executor costs one round.  It ends when a round finds
    nothing new; if ``most_hops`` is given and does not suffice, it raises.
    """
    seen = _written(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    front, hops = seen, 0
    while True:
        hops += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = _written(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hops)))
        if new.isEmpty():
            return seen
        _within(hops, most_hops)
        seen, front = _grown(seen, new, hops), new


def reachability(nodes: DataFrame, entries: DataFrame, calls: DataFrame, most_hops: int | None = None) -> DataFrame:
    """``node``, ``verdict`` (reachable, unknown, not_reachable), ``hops``.

    Nodes marked ``open`` (virtual, abstract) are unknown when nothing reaches
    them: the analysis fails open.
    """
    found = closure(entries, calls, most_hops)
    out = nodes.join(found, "node", "left")
    verdict = F.when(F.col("hops").isNotNull(), "reachable").when(F.col("open"), "unknown").otherwise("not_reachable")
    return out.select("node", verdict.alias("verdict"), "hops")


def shortest_paths(entries: DataFrame, edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """As ``closure``, with one least path per node (ties: the smallest array)."""
    seen = _written(entries.select("node").distinct().withColumn("path", F.array("node")))
    front, hops = seen, 0
    while True:
        hops += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = _written(step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if new.isEmpty():
            return seen
        _within(hops, most_hops)
        seen, front = _grown(seen, new, hops), new


def dirty_nodes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Nodes that are new or whose hash changed."""
    b = before.select("node", F.col("hash").alias("_h"))
    return now.join(b, "node", "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).select("node")


def neighbors(edges: DataFrame) -> DataFrame:
    """``node``, ``other``, ``kind``: who imports it, and what it imports."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("imports").alias("kind"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("imported-by").alias("kind"))
    return out.unionByName(back).distinct()


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve raw imports (``src``, ``target``): a file of that very path, else
    the first file with the same stem; no link to itself."""
    exact = files.select(F.col("path").alias("target"), F.col("path").alias("_exact")).distinct()
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), "\\.[A-Za-z0-9]+$", "")
    stems = files.groupBy(stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_by_stem"))
    out = imports.join(exact, "target", "left").withColumn("_stem", stem(F.col("target"))).join(stems, "_stem", "left")
    return out.select("src", F.coalesce("_exact", "_by_stem").alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def call_edges(bodies: DataFrame, names: DataFrame) -> DataFrame:
    """Caller -> callee where the callee's name is a word of the caller's body.

    Bodies are cut into distinct words that join with the names by equality; no
    pair of a body and a name is compared by a pattern.
    """
    words = bodies.select(F.col("node").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return words.join(names.select("name", F.col("node").alias("dst")), "name").where("src <> dst").select("src", "dst").distinct()


def shared_symbols(symbols: DataFrame, most_sharers: int | None = None) -> DataFrame:
    """(file, name, n): names of a file that ``n`` other files of its repository
    also declare.  Counted per name, not by pairing files."""
    s = symbols.select("repo", "file", "name").distinct()
    n = s.groupBy("repo", "name").agg((F.count("*") - 1).alias("n")).where("n > 0")
    out = s.join(n, ["repo", "name"])
    return out.where(F.col("n") <= most_sharers) if most_sharers else out
