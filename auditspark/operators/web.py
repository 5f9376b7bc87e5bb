"""Captured web pages: links, scope, hosts, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators.planning import global_rank
from auditspark.functions.text import hostname_of, path_of

_LINK = "(?:href|src|action)=\"([^\"]+)\""
_SCRIPT = "<script[^>]*src=\"([^\"]+[.]js)\""


def resume_targets(targets: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """Targets not done, in chunks of ``size`` by name."""
    left = targets.join(done.select(key).distinct(), key, "left_anti")
    return global_rank(left, [F.asc(key)]).withColumn("chunk", F.floor(F.col("rank") / size).cast("int")).drop("rank")


def resolve(base: Column, link: Column) -> Column:
    """Absolute http url of a link on a page, without fragment; null if not http."""
    origin = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, "^(https?):", 1)
    folder = F.regexp_extract(F.concat(origin, path_of(base)), "^(https?://.*/)", 1)
    l = F.regexp_replace(link, "#.*$", "")
    out = (
        F.when(l.rlike("^https?://"), l)
        .when(l.startswith("//"), F.concat(scheme, F.lit(":"), l))
        .when(l.startswith("/"), F.concat(origin, l))
        .when(l.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(l != "", F.concat(folder, l))
    )
    return F.when(origin != "", out)


def links(pages: DataFrame, pattern: str = _LINK) -> DataFrame:
    """``position`` and ``link`` of every distinct link of a page, in order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))
    raw = pages.select("page_id", "url", F.posexplode(F.array_distinct(found)).alias("position", "raw"))
    return raw.select("page_id", "position", resolve(F.col("url"), F.col("raw")).alias("link")).where("link IS NOT NULL").dropDuplicates(["page_id", "link"])


def scripts(pages: DataFrame) -> DataFrame:
    return links(pages, _SCRIPT)


def within(url: Column, host: Column, prefix: Column) -> Column:
    """Same host (port ignored) and a path prefix at a segment boundary."""
    path = path_of(url)
    p = F.regexp_replace(prefix, "/+$", "")
    return (hostname_of(url) == F.lower(host)) & ((p == "") | (path == p) | path.startswith(F.concat(p, F.lit("/"))))


def authorized(pages: DataFrame, scope: DataFrame) -> DataFrame:
    """``allowed`` for each page: scope rows (host, prefix, deny) match by host;
    a deny wins.  The scope is an equality join on the host, then a prefix test."""
    h = pages.withColumn("host", hostname_of(F.col("url")))
    s = scope.select(F.lower("host").alias("host"), "prefix", "deny")
    hit = h.join(s, "host").where(within(F.col("url"), F.col("host"), F.col("prefix")))
    state = hit.groupBy("page_id").agg(F.bool_or("deny").alias("denied"))
    return pages.select("page_id").join(state, "page_id", "left").select("page_id", F.coalesce(~F.col("denied"), F.lit(False)).alias("allowed"))


def private_address(host: Column) -> Column:
    """Loopback, link-local, private and reserved IPv4 literals."""
    quad = host.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    part = lambda i: F.get(F.split(host, "[.]"), F.lit(i)).try_cast("int")
    a, b = part(0), part(1)
    return quad & (a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)))


def denied_host(host: Column, names: list[str]) -> Column:
    suffix = F.lit(False)
    for n in names:
        suffix = suffix | host.endswith("." + n)
    return F.coalesce((host == "") | host.isin("localhost", *names) | suffix | private_address(host), F.lit(True))


def route_diff(routes: DataFrame) -> DataFrame:
    """Routes added and removed between consecutive builds of a host.

    Input: host, build (orders), route, in any number of rows; a build without routes is
    a row with a null route.  Only the routes that differ meet in a row; empty diffs are
    dropped.  Rows without a host or build belong to no build.
    """
    r = routes.select("host", "build", "route").where("host IS NOT NULL AND build IS NOT NULL").distinct()
    later = r.select("host", "build").distinct().withColumn("next", F.lead("build").over(Window.partitionBy("host").orderBy("build")))
    later = later.where("next IS NOT NULL")
    here = r.where("route IS NOT NULL")
    now = here.join(later.select("host", F.col("next").alias("build")), ["host", "build"], "left_semi")
    before = here.join(later, ["host", "build"]).select("host", F.col("next").alias("build"), "route")
    keys = ["host", "build", "route"]
    both = now.join(before, keys, "left_anti").withColumn("new", F.lit(True)).unionByName(before.join(now, keys, "left_anti").withColumn("new", F.lit(False)))
    side = lambda new: F.array_sort(F.collect_list(F.when(F.col("new") == new, F.col("route"))))
    return both.groupBy("host", "build").agg(side(True).alias("added"), side(False).alias("removed"))


def route_presence(archived: DataFrame, live: DataFrame, key: str) -> DataFrame:
    a = archived.select(key).distinct().withColumn("_a", F.lit(True))
    b = live.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").otherwise("present").alias("state"))


def robots(text: DataFrame, most: int = 40) -> DataFrame:
    """Disallowed paths of robots.txt files (host, text)."""
    lines = text.select("host", F.posexplode(F.split("text", "\\r?\\n")).alias("n", "line"))
    path = F.trim(F.regexp_extract("line", "(?i)^\\s*disallow\\s*:\\s*([^#]*)", 1))
    w = Window.partitionBy("host").orderBy("n")
    return lines.select("host", "n", path.alias("path")).where("path <> ''").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("host", "path")


def sitemap(text: DataFrame, most: int = 100) -> DataFrame:
    """Urls of sitemaps (host, text)."""
    urls = F.slice(F.regexp_extract_all("text", F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1)), 1, most)
    return text.select("host", F.explode(urls).alias("url"))


def subdomains(certificates: DataFrame, domain: str, most: int = 200) -> DataFrame:
    """Distinct names under ``domain`` in certificate records (name_value)."""
    name = F.regexp_replace(F.lower(F.trim("name")), "^[*][.]", "")
    rows = certificates.select(F.explode(F.split("name_value", "\\n")).alias("name")).select(name.alias("name")).distinct()
    return rows.where((F.col("name") == domain) | F.col("name").endswith("." + domain)).orderBy("name").limit(most)


def archive_urls(rows: DataFrame) -> DataFrame:
    """Archive addresses of capture rows (timestamp, original, statuscode)."""
    return rows.where("statuscode = '200'").select(F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("/"), "original").alias("url"))


def sweep_plan(targets: DataFrame, done: DataFrame, names: list[str], budget: int) -> DataFrame:
    """``state`` of each target: done, denied, unknown, or run; only the first
    ``budget`` targets (skipped ones count) are planned."""
    kind = F.when(F.col("url").rlike("^https?://"), "repo").when(F.col("url").rlike("^0x[0-9a-fA-F]{40}$"), "contract").otherwise("unknown")
    first = targets.orderBy("page_id").limit(budget).withColumn("kind", kind)
    d = done.select("page_id").withColumn("_d", F.lit(True))
    state = F.when(F.col("_d"), "done").when(F.col("kind") == "unknown", "unknown").when((F.col("kind") == "repo") & denied_host(hostname_of(F.col("url")), names), "denied").otherwise("run")
    return first.join(d, "page_id", "left").select("page_id", "kind", state.alias("state"))
