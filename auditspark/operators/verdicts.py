"""Verdicts of reported weaknesses from the source of each version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import code, source
from auditspark.operators.history import verdict_timeline
from auditspark.operators.locate import generic_vulnerable, locate
from auditspark.shared import shuffled, written


def version_functions(files: DataFrame) -> DataFrame:
    """Functions of files (repo, version, path, text, lang): repo, version, path, name,
    signature, body; comments are gone."""
    file = F.xxhash64(F.col("repo").cast("string"), F.col("version").cast("string"), "path").alias("doc_id")
    named = files.select("repo", "version", "path", "lang", source.clean_code(F.col("text"), F.col("lang")).alias("text"), file)
    found = code.extract_functions(named.select("doc_id", "text", "lang"))
    return found.join(shuffled(named.select("doc_id", "repo", "version", "path")), "doc_id").select("repo", "version", "path", "name", "signature", "body")


def states(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``finding``, ``version``, ``path``, ``name``, ``how`` (stage of ``locate``; null where the
    function is not found), ``in_place``, ``elsewhere``, ``touched``: what a verdict is made of.

    ``findings``: finding, repo, kind (reentrancy, access-control or generic), path, name;
    ``files`` as for ``version_functions``.  The function that is meant is the one of the
    first version that has its path and name; in every version it is where ``locate``
    finds it.  ``in_place``: it has the weakness there.  For a generic finding that is the
    canonical form that was reported.  ``elsewhere``: another function has it; of access
    control only one that writes the state that the reported one wrote.  ``touched``:
    its canonical form changed, so a new name or layout is none.  Findings whose function no
    version has get no rows.
    """
    f = shuffled(written(version_functions(files), "version-functions"))
    there = findings.join(f, ["repo", "path", "name"])
    asked = there.groupBy("finding", "repo", "kind").agg(F.min_by(F.struct("version", "path", "name", "signature", "body"), F.struct("version", "path", "name", "signature", "body")).alias("r"))
    asked = shuffled(written(asked.select("finding", "repo", "kind", F.col("r.version").alias("since"), "r.path", "r.name", "r.signature", "r.body"), "asked"))
    versions = files.select("repo", "version").distinct()
    wanted = asked.join(versions, "repo").select(F.col("finding").alias("id"), "repo", "version", "path", "name", "body")
    found = locate(wanted, f, by=("repo", "version")).select(F.col("id").alias("finding"), "repo", "version", "path", "name", F.col("stage").alias("how"))
    found = shuffled(found)
    every = asked.select("finding", "repo", "kind", "since", F.array_distinct(code.state_writes(F.concat_ws(" ", "signature", "body"))).alias("wrote"), code.canonical(F.col("body"), F.col("name")).alias("reported")).join(versions, "repo")
    facts = f.select("repo", "version", "path", "name", code.canonical(F.col("body"), F.col("name")).alias("canon"), code.reentrancy_vulnerable(F.col("body")).alias("calls_first"), code.access_vulnerable(F.col("signature"), F.col("body")).alias("open"), code.state_writes(F.concat_ws(" ", "signature", "body")).alias("writes"))
    facts = shuffled(written(facts.dropDuplicates(["repo", "version", "path", "name"]), "version-facts"))  # of overloads, one
    at = every.join(found, ["finding", "repo", "version"], "left").join(facts, ["repo", "version", "path", "name"], "left")
    at = shuffled(written(at, "located-versions"))
    forms = generic_vulnerable(at.where("kind = 'generic' AND canon IS NOT NULL").select("finding", "version", "canon", (F.col("canon") == F.col("reported")).alias("marked")))
    forms = forms.select("finding", F.col("version").cast(dict(at.dtypes)["version"]).alias("version"), "vulnerable")
    other = every.join(facts.select("repo", "version", F.col("path").alias("opath"), F.col("name").alias("oname"), "canon", "calls_first", "open", "writes"), ["repo", "version"])
    weak = F.when(F.col("kind") == "reentrancy", F.col("calls_first")).when(F.col("kind") == "access-control", F.col("open") & F.arrays_overlap("writes", "wrote")).otherwise(F.col("canon") == F.col("reported"))
    other = other.where(weak).join(found.select("finding", "version", F.col("path").alias("opath"), F.col("name").alias("oname")), ["finding", "version", "opath", "oname"], "left_anti")
    other = other.select("finding", "version").distinct().withColumn("other", F.lit(True))
    order = Window.partitionBy("finding").orderBy("version")  # a row per version
    rows = at.join(forms, ["finding", "version"], "left").join(shuffled(other), ["finding", "version"], "left")
    weak = F.when(F.col("kind") == "reentrancy", F.col("calls_first")).when(F.col("kind") == "access-control", F.col("open")).otherwise(F.col("vulnerable"))
    rows = rows.withColumn("in_place", F.coalesce(weak, F.lit(False)) & (F.col("version") >= F.col("since"))).withColumn("elsewhere", F.coalesce("other", F.lit(False)))
    rows = rows.withColumn("before", F.lag("canon").over(order)).withColumn("touched", F.coalesce(F.col("before") != F.col("canon"), F.lit(False)))
    return rows.where(F.col("version") >= F.col("since")).select("finding", "version", "path", "name", "how", "in_place", "elsewhere", "touched")


def source_verdicts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``finding``, ``version``, ``verdict``, ``path``, ``name``, ``how`` for every version from the
    one a finding was reported at; the order of the files does not matter."""
    rows = shuffled(written(states(findings, files), "version-states"))
    return verdict_timeline(rows.select("finding", "version", "in_place", "elsewhere", "touched")).join(rows.select("finding", "version", "path", "name", "how"), ["finding", "version"])
