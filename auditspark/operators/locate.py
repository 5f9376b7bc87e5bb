"""Locating functions across versions: place, name, canonical form, likeness."""

from __future__ import annotations

import difflib
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.code import canonical, statement_multiset
from auditspark.operators import likeness
from auditspark.shared import shuffled, written
from auditspark.shipping import ship

LIKE = 0.8


def prepared(functions: DataFrame) -> DataFrame:
    """Functions (path, name, body) with their canonical form and statements."""
    return functions.select("path", "name", "body", canonical(F.col("body"), F.col("name")).alias("canon"), statement_multiset(F.col("body"), F.col("name")).alias("parts"))


def similarity(pairs: DataFrame, keep: list[str], least: float = 0.0) -> DataFrame:
    """``score``: ratio of matching blocks of the columns ``a`` and ``b``; 0 without a
    closer look where lengths or letters alone keep it below ``least``."""
    ship(pairs.sparkSession)

    def ratio(x: str, y: str) -> float:
        if x == y:
            return 1.0
        m = difflib.SequenceMatcher(None, x, y)
        if not x or not y or m.real_quick_ratio() < least or m.quick_ratio() < least:
            return 0.0
        return m.ratio()

    def score(batches):
        for b in batches:
            out = [ratio(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(out, pa.float64())], [*keep, "score"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*keep, "a", "b").mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


#: Most forms, and most letters of forms, of one side of a tile; so many wanted forms a tile are
#: enough if there are few tiles.
TILE_FORMS, TILE_LETTERS, FEW_WANTED = 16384, 3 << 20, 64


def _tile(wanted: pa.Table, known: pa.Table, best: bool) -> pa.Table:
    """``a_form``, ``b_form``, ``score`` of the pairs of a tile whose ratio is the wanted form's
    ``least`` or more; with ``best`` only the likest of each wanted form."""
    found = []
    if wanted.num_rows and known.num_rows:
        known = known.take(pc.sort_indices(known["size"]))
        names, against = known["form"].to_pylist(), likeness.Known(known["canon"].to_pylist())
        for form, x, least in zip(*(wanted[c].to_pylist() for c in ("form", "canon", "least")), strict=True):
            found += [(form, names[i], score) for i, score in likeness.Wanted(x, against).like(least, best)]
    found = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], ["a_form", "b_form", "score"])


def like_forms(wanted: DataFrame, known: DataFrame, like: float = LIKE, best: bool = False) -> DataFrame:
    """``a_form``, ``b_form``, ``score`` of all pairs of a wanted and a known form (``form``,
    ``canon``, each form once) whose ratio is ``like`` or more (over 0).  No pair is lost.

    Forms are dealt by size into bands so wide that alike ones stand in one band or in
    neighbours, and bands into tiles of bounded size; each tile of wanted forms meets each
    of known ones inside a task, so no pair is written that is not alike.  Bounds of the
    ratio, made for many known forms together (``likeness``), leave few pairs to compare.
    With ``best`` a wanted form is given only with the likest known ones of some tiles: all
    that have the highest ratio are among them, and what the first tile of known
    forms has found is the least that the others look for.
    """
    spark = wanted.sparkSession
    ship(spark)
    step = max(math.log((2 - like) / like), 0.05) * 1.001
    sized = lambda x, name: written(x.where("canon <> ''").select("form", "canon", F.length("canon").alias("size"), F.floor(F.log(F.length("canon")) / step).cast("int").alias("band")), name)
    w, k = sized(wanted, "wanted-forms"), sized(known, "known-forms")
    k = k.select("form", "canon", "size", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    # By number: tiles are few bytes and much work, which Spark would gather in one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    parts = [x.groupBy("band").agg(F.count("*").alias("forms"), F.ceil(F.greatest(F.count("*") / TILE_FORMS, F.sum("size") / TILE_LETTERS)).alias(n)) for x, n in ((w, "rows"), (k, "columns"))]
    # One row a band; sizes double with every few bands, so there are some dozens.
    parts = parts[0].join(parts[1].drop("forms"), "band").withColumn("rows", F.greatest("rows", F.least(F.ceil(F.col("forms") / FEW_WANTED), F.ceil(tasks / F.col("columns")))))
    parts = written(parts.select("band", "rows", "columns").coalesce(1), "bands")
    tile = lambda n: F.pmod(F.xxhash64("form"), F.col(n)).cast("int")
    every = lambda n, first=0: F.explode(F.sequence(F.lit(first), F.col(n).cast("int") - 1))
    at = ["band", "row", "column"]

    def tiles(w: DataFrame, parts: DataFrame, first: int, last: Column) -> DataFrame:
        """Pairs of the tiles from column ``first`` up to ``last``."""
        parts = F.broadcast(parts.where(F.col("columns") > first))
        a = w.join(parts, "band").select("form", "canon", "least", "band", tile("rows").alias("row"), every("columns", first).alias("column")).where(F.col("column") <= last)
        b = k.join(parts, "band").select("form", "canon", "size", "band", tile("columns").alias("column"), "rows").where(F.col("column").between(F.lit(first), last)).withColumn("row", every("rows"))
        a, b = a.repartition(tasks, *at), b.drop("rows").repartition(tasks, *at)
        return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(lambda x, y: _tile(x, y, best), "a_form string, b_form string, score double")

    w, end = w.withColumn("least", F.lit(float(like))), F.lit(1 << 30)
    if not best or parts.where("columns > 1").isEmpty():
        return tiles(w, parts, 0, end)
    found = shuffled(written(tiles(w, parts, 0, F.lit(0)), "likest-of-first"))
    seen = found.groupBy(F.col("a_form").alias("form")).agg(F.max("score").alias("seen"))
    w = w.join(shuffled(seen), "form", "left").withColumn("least", F.coalesce("seen", "least")).drop("seen")
    return found.unionByName(tiles(w, parts, 1, end))


def locate(wanted: DataFrame, current: DataFrame, like: float = LIKE, by: tuple[str, ...] = ()) -> DataFrame:
    """Where functions (``wanted``: id, path, name, body) stand in ``current``.

    Stages, first hit wins: same path and name; the name elsewhere; the same
    canonical form; the same three or more statements; likeness of ``like`` or more, the
    likest first.  Ties: the first path, then the first name.  Gives id, path, name,
    stage, score.  With ``by``, columns of both tables, functions are located among
    those of equal ones (a version, a repository) and the columns are given too.  Every
    stage joins with one row a name, form or list of statements, so copies of a
    function, however many, are one.
    """
    form = F.sha2("canon", 256).alias("form")
    w = wanted.select("id", *by, F.col("path").alias("wpath"), F.col("name").alias("wname"), canonical(F.col("body"), F.col("name")).alias("canon"), statement_multiset(F.col("body"), F.col("name")).alias("parts"))
    w = shuffled(written(w.select("id", *by, "wpath", "wname", "canon", form, "parts", F.sha2(F.to_json("parts"), 256).alias("list")), "wanted"))
    c = current.select(*by, "path", "name", canonical(F.col("body"), F.col("name")).alias("canon"), statement_multiset(F.col("body"), F.col("name")).alias("parts"))
    c = shuffled(written(c.select(*by, "path", "name", "canon", form, F.sha2(F.to_json("parts"), 256).alias("list")), "current"))
    first = lambda key: c.groupBy(*by, key).agg(F.min(F.struct("path", "name")).alias("at"))
    hit = lambda rows, stage: rows.select("id", *by, "at.path", "at.name", F.lit(stage).alias("stage"), F.lit(1.0).alias("score"))
    at = F.struct(F.col("wpath").alias("path"), F.col("wname").alias("name")).alias("at")
    here = c.select(*by, F.col("path").alias("wpath"), F.col("name").alias("wname")).distinct()
    early = hit(w.join(here, [*by, "wpath", "wname"]).select("id", *by, at), 1)
    early = early.unionByName(hit(w.join(first(F.col("name").alias("wname")), [*by, "wname"]), 2))
    early = early.unionByName(hit(w.join(first("form"), [*by, "form"]), 3)).unionByName(hit(w.where(F.size("parts") >= 3).join(first("list"), [*by, "list"]), 4))
    early = written(early, "located")
    # Likeness is only asked where no stage before it has a hit.
    left = w.join(early.select("id", *by).distinct(), ["id", *by], "left_anti").select("id", *by, "form", "canon")
    known = c.groupBy("form").agg(F.first("canon").alias("canon"))
    alike = like_forms(left.groupBy("form").agg(F.first("canon").alias("canon")), known, like, best=not by)
    placed = alike.join(first("form").withColumnRenamed("form", "b_form"), "b_form")
    best = placed.groupBy(*by, F.col("a_form").alias("form")).agg(F.min(F.struct((-F.col("score")).alias("down"), "at")).alias("x")).select(*by, "form", (-F.col("x.down")).alias("score"), "x.at")
    late = left.join(shuffled(best), [*by, "form"]).select("id", *by, "at.path", "at.name", F.lit(5).alias("stage"), "score")
    order = Window.partitionBy("id", *by).orderBy("stage", F.desc("score"), "path", "name")
    return early.unionByName(late).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def generic_vulnerable(versions: DataFrame) -> DataFrame:
    """Whether a form is vulnerable at each version, where that depends on the past.

    Input: finding, version, canon, marked (named by the report at its version).
    A form is vulnerable once it has been marked, at that version or later: a
    running maximum per (finding, form), so that no history is gathered in a row.
    """
    past = Window.partitionBy("finding", "canon").orderBy("version").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return versions.distinct().select("finding", F.col("version").cast("string").alias("version"), F.coalesce(F.max("marked").over(past), F.lit(False)).alias("vulnerable"))


def elsewhere(functions: DataFrame, located: DataFrame, vulnerable) -> DataFrame:
    """Other functions of a version with the same weak property."""
    rest = functions.join(located.select("path", "name"), ["path", "name"], "left_anti")
    return rest.where(vulnerable).select("path", "name")
