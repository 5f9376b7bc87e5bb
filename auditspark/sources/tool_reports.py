"""Reports of external analyzers as one table of hits.

Each normaliser takes rows with a JSON report in ``value`` (and the ``target``
it belongs to) and gives: engine, target, file, line, function, category,
severity, title, description, swc_id, confidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
# Impact words to severities.
_IMPACT = {"High": "HIGH", "Medium": "MEDIUM", "Low": "LOW", "Informational": "INFO", "Optimization": "INFO"}


def register_normalizer(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    _NORMALIZERS[name] = f


def normalize(name: str, reports: DataFrame) -> DataFrame:
    return _NORMALIZERS[name](reports)


def _severity(impact: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in _IMPACT.items() for x in p])
    return F.coalesce(table[F.coalesce(impact, F.lit("Medium"))], F.lit("MEDIUM"))


def _hits(rows: DataFrame, engine: str, **columns: Column) -> DataFrame:
    none = {"file": F.lit(""), "line": F.lit(0), "function": F.lit(""), "category": F.lit(""), "severity": F.lit("MEDIUM"), "title": F.lit(""), "description": F.lit(""), "swc_id": F.lit(""), "confidence": F.lit(0.5)}
    cast = {"line": "int", "confidence": "double"}
    return rows.select(F.lit(engine).alias("engine"), "target", *[F.coalesce(c, none[k]).cast(cast.get(k, "string")).alias(k) for k, c in (none | columns).items()])


def _slug(title: Column) -> Column:
    return F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lit("-"))


def slither(reports: DataFrame) -> DataFrame:
    """First function or node element gives the place."""
    element = "struct<type:string,name:string,source_mapping:struct<filename_relative:string,filename_short:string,lines:array<int>>>"
    schema = f"struct<results:struct<detectors:array<struct<check:string,impact:string,confidence:string,description:string,markdown:string,elements:array<{element}>>>>>"
    d = reports.select("target", F.explode(F.from_json("value", schema)["results"]["detectors"]).alias("d"))
    placed = F.filter("d.elements", lambda e: e["type"].isin("function", "node") & (F.coalesce(F.nullif(e["source_mapping"]["filename_relative"], F.lit("")), e["source_mapping"]["filename_short"], F.lit("")) != ""))
    d = d.withColumn("p", F.get(placed, F.lit(0))).withColumn("f", F.get(F.filter("d.elements", lambda e: e["type"] == "function"), F.lit(0)))
    sure = F.when(F.col("d.confidence") == "High", 0.8).when(F.coalesce("d.confidence", F.lit("Medium")) == "Medium", 0.6).otherwise(0.5)
    return _hits(
        d,
        "slither",
        file=F.coalesce(F.nullif(F.col("p.source_mapping.filename_relative"), F.lit("")), F.col("p.source_mapping.filename_short")),
        line=F.get("p.source_mapping.lines", F.lit(0)),
        function=F.col("f.name"),
        category=F.lower("d.check"),
        severity=_severity(F.col("d.impact")),
        title=F.col("d.check"),
        description=F.col("d.description"),
        swc_id=F.regexp_extract(F.coalesce("d.markdown", F.lit("")), "(SWC-[0-9]+)", 1),
        confidence=sure,
    )


def aderyn(reports: DataFrame) -> DataFrame:
    """A row per instance; one row when there is none."""
    schema = "struct<issues:array<struct<title:string,impact:string,details:string,instances:array<struct<path:string,line:string,function:string>>>>>"
    i = reports.select("target", F.explode(F.from_json("value", schema)["issues"]).alias("i")).select("target", "i", F.explode_outer("i.instances").alias("n"))
    return _hits(i, "aderyn", file=F.col("n.path"), line=F.col("n.line").try_cast("int"), function=F.col("n.function"), category=_slug(F.col("i.title")), severity=_severity(F.col("i.impact")), title=F.col("i.title"), description=F.col("i.details"))


def mythril(reports: DataFrame) -> DataFrame:
    schema = "struct<issues:array<struct<title:string,severity:string,description:string,function:string,filename:string,lineno:int,`swc-id`:string>>>"
    i = reports.select("target", F.explode(F.from_json("value", schema)["issues"]).alias("i"))
    swc = F.coalesce(F.col("i.swc-id"), F.lit(""))
    return _hits(
        i, "mythril", file=F.col("i.filename"), line=F.col("i.lineno"), function=F.col("i.function"), category=_slug(F.col("i.title")), severity=F.upper(F.coalesce("i.severity", F.lit("Medium"))), title=F.col("i.title"), description=F.col("i.description"),
        swc_id=F.when((swc == "") | swc.startswith("SWC-"), swc).otherwise(F.concat(F.lit("SWC-"), swc)), confidence=F.lit(0.7),
    )


def semgrep(reports: DataFrame) -> DataFrame:
    schema = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>>"
    r = reports.select("target", F.explode(F.from_json("value", schema)["results"]).alias("r"))
    level = F.upper(F.coalesce("r.extra.severity", F.lit("WARNING")))
    return _hits(r, "semgrep", file=F.col("r.path"), line=F.col("r.start.line"), category=F.element_at(F.split("r.check_id", "[.]"), -1), severity=F.when(level == "ERROR", "HIGH").when(level == "WARNING", "MEDIUM").otherwise("LOW"), title=F.col("r.check_id"), description=F.left("r.extra.message", F.lit(2000)), confidence=F.lit(0.6))


def echidna(reports: DataFrame) -> DataFrame:
    schema = "struct<issues:array<struct<contract:string,function:string,bug:string>>>"
    i = reports.select("target", F.explode(F.from_json("value", schema)["issues"]).alias("i"))
    return _hits(i, "echidna", file=F.col("i.contract"), function=F.col("i.function"), category=F.lit("assertion-failure"), severity=F.lit("HIGH"), title=F.concat(F.lit("assertion failure in "), F.coalesce("i.function", F.lit("?"))), description=F.left("i.bug", F.lit(2000)), confidence=F.lit(0.95))


def npm_audit(reports: DataFrame) -> DataFrame:
    schema = "struct<vulnerabilities:map<string,struct<severity:string,title:string,url:string>>>"
    v = reports.select("target", F.explode(F.from_json("value", schema)["vulnerabilities"]).alias("id", "v"))
    return _hits(v, "npm-audit", file=F.lit("package.json"), category=F.lit("dependency-vuln"), severity=F.upper(F.coalesce("v.severity", F.lit("medium"))), title=F.coalesce("v.title", "id"), description=F.col("v.url"), confidence=F.lit(0.8))


def cargo_audit(reports: DataFrame) -> DataFrame:
    schema = "struct<vulnerabilities:struct<list:array<struct<advisory:struct<severity:string,title:string,description:string>>>>>"
    v = reports.select("target", F.explode(F.from_json("value", schema)["vulnerabilities"]["list"]).alias("v"))
    return _hits(v, "cargo-audit", file=F.lit("Cargo.toml"), category=F.lit("dependency-vuln"), severity=F.when(F.col("v.advisory.severity") == "high", "HIGH").otherwise("MEDIUM"), title=F.col("v.advisory.title"), description=F.left("v.advisory.description", F.lit(2000)), confidence=F.lit(0.85))


for _name, _f in (("slither", slither), ("aderyn", aderyn), ("mythril", mythril), ("semgrep", semgrep), ("echidna", echidna), ("npm-audit", npm_audit), ("cargo-audit", cargo_audit)):
    register_normalizer(_name, _f)


def flatten_report(reports: DataFrame) -> DataFrame:
    """Findings of a report, nested under targets or flat; the target is inherited."""
    finding = "struct<target:string,category:string,severity:string,confidence:double>"
    schema = f"struct<target:string,findings:array<{finding}>,targets:array<struct<target:string,findings:array<{finding}>>>>"
    r = reports.select(F.from_json("value", schema).alias("r"))
    nested = r.select(F.explode("r.targets").alias("t")).select(F.col("t.target").alias("own"), F.explode("t.findings").alias("f"))
    flat = r.select(F.col("r.target").alias("own"), F.explode("r.findings").alias("f"))
    return nested.unionByName(flat).select(F.coalesce("f.target", "own").alias("target"), "f.category", "f.severity", "f.confidence")


def read_chain_logs(rows: DataFrame) -> DataFrame:
    """Chain logs with numbers from hex; rows without an address or block are dropped."""
    schema = "struct<address:string,topics:array<string>,data:string,blockNumber:string,transactionHash:string>"
    x = rows.select(F.from_json("value", schema).alias("x"))
    hexed = F.regexp_extract(F.coalesce("x.blockNumber", F.lit("")), "^0[xX]([0-9a-fA-F]{1,15})$", 1)
    block = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
    return x.select(F.lower("x.address").alias("address"), "x.topics", "x.data", block.alias("block_number"), F.col("x.transactionHash").alias("tx_hash")).where("address IS NOT NULL AND block_number IS NOT NULL")


def read_transactions(rows: DataFrame) -> DataFrame:
    """tx_hash, sender, receiver, block_number of JSON blocks (column ``value``).
    Blocks that are no JSON or have no hex number, and transactions without a hash,
    are dropped."""
    schema = "struct<number:string,transactions:array<struct<hash:string,`from`:string,`to`:string>>>"
    x = rows.select(F.from_json("value", schema).alias("x"))
    hexed = F.regexp_extract(F.coalesce("x.number", F.lit("")), "^0[xX]([0-9a-fA-F]{1,15})$", 1)
    each = x.where(hexed != "").select(F.conv(hexed, 16, 10).cast("long").alias("block_number"), F.explode("x.transactions").alias("t"))
    return each.where("t.hash IS NOT NULL").select(F.col("t.hash").alias("tx_hash"), F.lower("t.from").alias("sender"), F.nullif(F.col("t.to"), F.lit("")).alias("receiver"), "block_number")


def deployments(transactions: DataFrame, receipts: DataFrame, watched: DataFrame) -> DataFrame:
    """Contracts that watched deployers made: a transaction without a receiver whose
    receipt (tx_hash, contract) names one."""
    made = transactions.where("receiver IS NULL").select("tx_hash", F.col("sender").alias("deployer"), "block_number")
    named = receipts.where("contract IS NOT NULL AND contract <> ''")
    return made.join(watched.select("deployer").distinct(), "deployer", "left_semi").join(named, "tx_hash").select("tx_hash", "deployer", "block_number", "contract")


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    """Distinct git urls that manifest files (path, text) name."""
    name = F.element_at(F.split("path", "/"), -1)
    every = lambda p, g=1: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    github = lambda a: F.transform(a, lambda x: F.concat(F.lit("https://github.com/"), x))
    absolute = lambda a: F.transform(a, lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit("https://github.com/"), x)))
    urls = (
        F.when(name == ".gitmodules", every(r"url\s*=\s*(\S+)"))
        .when(name == "package.json", F.concat(every(r"\"git\+((?:https|ssh)://[^\"#]+)"), github(every(r"\"github:([\w.-]+/[\w.-]+)"))))
        .when(name == "Cargo.toml", every(r"git\s*=\s*\"([^\"]+)\""))
        .when(name == "Scarb.toml", F.concat(every(r"git\s*=\s*\"([^\"]+)\""), absolute(every(r"github\s*=\s*\"([^\"]+)\""))))
        .when(name == "remappings.txt", every(r"(https://github[.]com/[^\s,\"']+)"))
    )
    return manifests.select(F.explode(urls).alias("url")).distinct().orderBy(F.lower("url"), "url")
