"""Web queries over captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import text as fx
from auditspark.operators import ledger, web
from auditspark.operators.secrets import KEY_SHAPES, secret_findings
from auditspark.operators.secrets import secret_scan as scan_secrets
from auditspark.plans.base import query

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_RAW = "(SELECT page_id, url, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?:href|src|action)=\"([^\"]+)\"', 1))) AS raw FROM pages)"
_LINKS = f"""(SELECT DISTINCT page_id, link FROM (SELECT page_id, CASE WHEN {_ORIGIN} = '' THEN NULL WHEN regexp_matches(l, '^https?://') THEN l WHEN starts_with(l, '//') THEN regexp_extract(url, '^(https?):', 1) || ':' || l WHEN starts_with(l, '/') THEN {_ORIGIN} || l WHEN regexp_matches(l, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN l <> '' THEN regexp_extract({_ORIGIN} || {_PATH}, '^(https?://.*/)', 1) || l END AS link FROM (SELECT page_id, url, regexp_replace(raw, '#.*$', '') AS l FROM {_RAW})) WHERE link IS NOT NULL)"""


@query("extract_links", f"SELECT page_id, link FROM {_LINKS}")
def extract_links(t):
    return web.links(t.pages).select("page_id", "link")


@query("extract_scripts", "SELECT page_id, count(*) AS scripts FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<script[^>]*>')) FROM pages) GROUP BY 1")
def extract_scripts(t):
    """Script elements of each page (the captured pages have only inline ones)."""
    n = F.regexp_count(F.coalesce("html", F.lit("")), F.lit("<script[^>]*>")).cast("long")
    return t.pages.select("page_id", n.alias("scripts")).where("scripts > 0")


@query("same_host_queue", f"SELECT page_id, link FROM (SELECT l.page_id, link, row_number() OVER (PARTITION BY l.page_id ORDER BY link) AS n FROM {_LINKS} l JOIN pages p USING (page_id) WHERE lower(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) = {_HOST}) WHERE n <= 3")
def same_host_queue(t):
    l = web.links(t.pages).join(t.pages.select("page_id", "url"), "page_id")
    same = l.where(fx.hostname_of(F.col("link")) == fx.hostname_of(F.col("url")))
    return ledger.first_per_key(same, "page_id", ["link"], 3).select("page_id", "link")


@query("page_cap", f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages) WHERE n <= 12")
def page_cap(t):
    return ledger.first_per_key(t.pages.withColumn("host", fx.hostname_of(F.col("url"))), "host", ["page_id"], 12).select("page_id")


@query("scope_path_prefix", f"SELECT page_id, {_PATH} = '/en' OR starts_with({_PATH}, '/en/') AS inside FROM pages")
def scope_path_prefix(t):
    return t.pages.select("page_id", web.within(F.col("url"), fx.hostname_of(F.col("url")), F.lit("/en/")).alias("inside"))


_SCOPE = f"(SELECT DISTINCT {_HOST} AS host, '/en' AS prefix, FALSE AS deny FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT {_HOST}, '', TRUE FROM pages WHERE page_id % 50 = 0)"


@query("scope_authorize", f"SELECT page_id, coalesce(NOT denied, FALSE) AS allowed FROM pages LEFT JOIN (SELECT page_id, bool_or(deny) AS denied FROM pages p JOIN {_SCOPE} s ON s.host = {_HOST} WHERE prefix = '' OR {_PATH} = prefix OR starts_with({_PATH}, prefix || '/') GROUP BY 1) USING (page_id)")
def scope_authorize(t):
    h = t.pages.withColumn("host", fx.hostname_of(F.col("url")))
    allow = h.where("page_id % 2 = 0").select("host").distinct().select("host", F.lit("/en").alias("prefix"), F.lit(False).alias("deny"))
    deny = h.where("page_id % 50 = 0").select("host").distinct().select("host", F.lit("").alias("prefix"), F.lit(True).alias("deny"))
    return web.authorized(t.pages, allow.unionByName(deny))


_DENIED = f"({_HOST} = '' OR {_HOST} = 'localhost' OR {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org')"


@query("deny_hosts", f"SELECT page_id, {_HOST} AS host, {_DENIED} AS denied FROM pages")
def deny_hosts(t):
    h = t.pages.select("page_id", fx.hostname_of(F.col("url")).alias("host"))
    return h.withColumn("denied", web.denied_host(F.col("host"), ["example.org"]))


@query("sweep_plan", f"SELECT page_id, 'repo' AS kind, CASE WHEN page_id % 4 = 0 THEN 'done' WHEN {_DENIED} THEN 'denied' ELSE 'run' END AS state FROM (SELECT * FROM pages ORDER BY page_id LIMIT 150)")
def sweep_plan(t):
    return web.sweep_plan(t.pages.select("page_id", "url"), t.pages.where("page_id % 4 = 0"), ["example.org"], 150)


@query("route_programs", f"SELECT page_id, CASE WHEN instr(url, 'example.net') > 0 THEN 'net program' WHEN instr(coalesce(html, ''), 'track(1') > 0 THEN 'track program' END AS program FROM pages")
def route_programs(t):
    """A program's domain in the url, else its address in the page."""
    by_domain = F.when(F.contains("url", F.lit("example.net")), "net program")
    by_address = F.when(F.contains(F.coalesce("html", F.lit("")), F.lit("track(1")), "track program")
    return t.pages.select("page_id", F.coalesce(by_domain, by_address).alias("program"))


@query("bounty_topn", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def bounty_topn(t):
    return t.orders.where("o_totalprice >= 50000").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("policy_reportable", f"SELECT page_id, NOT regexp_matches(lower(url), '(utm_source|page=)') AS reportable FROM pages")
def policy_reportable(t):
    """Kinds that programs close on sight are not reportable."""
    return t.pages.select("page_id", (~F.lower("url").rlike("(utm_source|page=)")).alias("reportable"))


@query(
    "url_functions",
    f"""SELECT page_id, {_HOST} AS host, CASE WHEN len(string_split({_HOST}, '.')) <= 2 THEN {_HOST} ELSE string_split({_HOST}, '.')[-2] || '.' || string_split({_HOST}, '.')[-1] END AS domain, {_PATH} AS path,
    lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?]*)', 1)) || regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/?]*(.*)$', 1) AS normal FROM pages""",
)
def url_functions(t):
    u = F.col("url")
    return t.pages.select("page_id", fx.hostname_of(u).alias("host"), fx.registered_domain(fx.hostname_of(u)).alias("domain"), fx.path_of(u).alias("path"), fx.normalize_url(u).alias("normal"))


def _secrets_sql(table, key, text):
    parts = []
    for kind, shape in KEY_SHAPES:
        p = shape.replace("'", "''")
        parts.append(f"SELECT {key}, '{kind}' AS kind, unnest(regexp_extract_all(content, '{p}')) AS value, line FROM ls")
    return f"(WITH ls AS (SELECT {key}, lines[i] AS content, i AS line FROM (SELECT {key}, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT {key}, string_split(coalesce({text}, ''), chr(10)) AS lines FROM {table}))) " + " UNION ALL ".join(parts) + ")"


@query("secret_scan", f"SELECT doc_id, kind, sha256(value) AS digest, line FROM {_secrets_sql('documents', 'doc_id', 'text')}")
def secret_scan(t):
    """Keys of known shapes in documents, with their lines."""
    return scan_secrets(t.documents, "doc_id", "text").select("doc_id", "kind", F.sha2("value", 256).alias("digest"), F.col("line").cast("long").alias("line"))


@query("page_secrets", f"SELECT kind || ':' || left(sha256(value), 16) AS finding_id, kind, min(page_id) AS first_page_id, count(DISTINCT page_id) AS seen_in, CASE WHEN length(min(value)) <= 12 THEN '***' ELSE left(min(value), 4) || '…' || right(min(value), 4) END AS shown FROM {_secrets_sql('pages', 'page_id', 'html')} GROUP BY 1, 2")
def page_secrets(t):
    """Secrets of pages, once per value, redacted."""
    return secret_findings(scan_secrets(t.pages, "page_id", "html"), "page_id")


_BUILDS = f"(SELECT {_HOST} AS host, page_id % 3 AS build, list(DISTINCT h) AS routes FROM (SELECT url, page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"(/[^\"]+)\"', 1)) AS h FROM pages) GROUP BY 1, 2)"


@query(
    "build_route_diff",
    f"""SELECT host, build, array_to_string(list_sort(list_filter(routes, lambda x: NOT list_contains(p, x))), ' ') AS added, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(routes, x))), ' ') AS removed
    FROM (SELECT *, lag(routes) OVER (PARTITION BY host ORDER BY build) AS p FROM {_BUILDS}) WHERE p IS NOT NULL AND (len(list_filter(routes, lambda x: NOT list_contains(p, x))) > 0 OR len(list_filter(p, lambda x: NOT list_contains(routes, x))) > 0)""",
)
def build_route_diff(t):
    h = t.pages.select(fx.hostname_of(F.col("url")).alias("host"), (F.col("page_id") % 3).alias("build"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]+)"'), F.lit(1))).alias("route"))
    d = web.route_diff(h)
    return d.select("host", "build", F.array_join("added", " ").alias("added"), F.array_join("removed", " ").alias("removed"))


_HREFS = "SELECT unnest(regexp_extract_all(coalesce(html, ''), 'href=\"(/[^\"]+)\"', 1)) AS route FROM pages WHERE page_id % 2 = {0}"


@query("route_presence", f"SELECT coalesce(a.route, b.route) AS route, CASE WHEN b.route IS NULL THEN 'gone' WHEN a.route IS NULL THEN 'new' ELSE 'present' END AS state FROM (SELECT DISTINCT route FROM ({_HREFS.format(0)})) a FULL JOIN (SELECT DISTINCT route FROM ({_HREFS.format(1)})) b ON a.route = b.route")
def route_presence(t):
    r = t.pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]+)"'), F.lit(1))).alias("route"))
    return web.route_presence(r.where("page_id % 2 = 0"), r.where("page_id % 2 = 1"), "route")


@query("deployment_match", "SELECT doc_id, CASE WHEN c = '' OR d = '' THEN 'divergent' WHEN regexp_replace(c, 'a264697066735822.*$', '') = regexp_replace(d, 'a264697066735822.*$', '') THEN 'match' ELSE 'divergent' END AS verdict FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE sha256(source) || 'a264697066735822' || CAST(doc_id AS VARCHAR) END AS c, CASE WHEN doc_id % 3 = 0 THEN sha256(lang) ELSE sha256(source) END || 'a264697066735822' || 'ff' AS d FROM documents)")
def deployment_match(t):
    """Compiled against deployed code without its metadata."""
    tail = F.lit("a264697066735822")
    compiled = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.sha2("source", 256), tail, F.col("doc_id").cast("string")))
    deployed = F.concat(F.when(F.col("doc_id") % 3 == 0, F.sha2("lang", 256)).otherwise(F.sha2("source", 256)), tail, F.lit("ff"))
    d = t.documents.select("doc_id", fx.strip_metadata(compiled).alias("c"), fx.strip_metadata(deployed).alias("d"))
    return d.select("doc_id", F.when((F.col("c") == "") | (F.col("d") == ""), "divergent").when(F.col("c") == F.col("d"), "match").otherwise("divergent").alias("verdict"))


@query("deployments_by_watchlist", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def deployments_by_watchlist(t):
    """Transactions of watched senders that create something."""
    watch = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return t.events.where("event_type = 'purchase'").join(watch, "user_id", "left_semi").select("event_id", "user_id", "ts")


@query("trigger_queue", "SELECT left(sha256(CAST(user_id AS VARCHAR) || event_type), 16) AS trigger_id, min(event_id) AS first_event, count(*) AS sightings FROM events GROUP BY 1")
def trigger_queue(t):
    """One queue entry per trigger, however often it is sighted."""
    k = fx.trigger_id(F.col("user_id"), F.col("event_type"))
    return t.events.groupBy(k.alias("trigger_id")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("sightings"))


@query("variant_match", "WITH s AS (SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}'), lambda x: TRUE) AS ws FROM benchmark), k AS (SELECT DISTINCT item_id, unnest(ws) AS w FROM s), n AS (SELECT item_id, count(*) AS total FROM k GROUP BY 1), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}')) AS w FROM documents), m AS (SELECT doc_id, item_id, count(*) AS found FROM d JOIN k USING (w) GROUP BY 1, 2) SELECT doc_id, item_id, round(found / total, 4) AS score FROM m JOIN n USING (item_id) WHERE found >= 2 AND found * 2 >= total")
def variant_match(t):
    """Documents that hold at least half of a signature's keywords."""
    from auditspark.operators.variants import keyword_match

    return keyword_match(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text"))


@query("variant_topn", "WITH k AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}')) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS total FROM k GROUP BY 1), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}')) AS w FROM documents), m AS (SELECT doc_id, item_id, count(*) AS found FROM d JOIN k USING (w) GROUP BY 1, 2) SELECT doc_id, item_id, round(found / total, 4) AS score FROM m JOIN n USING (item_id) WHERE found >= 2 AND found * 2 >= total ORDER BY round(found / total, 4) DESC, doc_id, item_id LIMIT 50")
def variant_topn(t):
    return variant_match(t).orderBy(F.desc("score"), "doc_id", "item_id").limit(50)
