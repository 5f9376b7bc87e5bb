"""Graph queries: conversation turns as a chain, pages as files with links."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.operators import graph
from auditspark.operators.order import with_sum_before
from auditspark.plans.base import query

_NODE = "CAST(conv_id * 1000 + turn AS BIGINT)"


def _nodes(t):
    c = t.conversations
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("node"), "conv_id", "turn", "role", "text")


def _edges(t):
    """Each turn links to the next one of its conversation."""
    n = _nodes(t)
    return n.where("turn > 0").select((F.col("node") - 1).alias("src"), F.col("node").alias("dst"))


_EDGES = f"(SELECT {_NODE} - 1 AS src, {_NODE} AS dst FROM conversations WHERE turn > 0)"


@query("import_edges", "WITH f AS (SELECT url AS path FROM pages), i AS (SELECT url AS src, 'http://x' || h AS target FROM (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]+)\"', 1)) AS h FROM pages)), s AS (SELECT regexp_replace(list_last(string_split(path, '/')), '\\.[A-Za-z0-9]+$', '') AS stem, min(path) AS p FROM f GROUP BY 1) SELECT DISTINCT src, coalesce(f.path, s.p) AS dst FROM i LEFT JOIN f ON f.path = i.target LEFT JOIN s ON s.stem = regexp_replace(list_last(string_split(i.target, '/')), '\\.[A-Za-z0-9]+$', '') WHERE coalesce(f.path, s.p) IS NOT NULL AND src <> coalesce(f.path, s.p)")
def import_edges(t):
    links = t.pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]+)"'), F.lit(1))).alias("h"))
    return graph.import_edges(links.select("src", F.concat(F.lit("http://x"), "h").alias("target")), t.pages.select(F.col("url").alias("path")))


@query("propagate_dirty", f"WITH RECURSIVE e AS {_EDGES}, r(node) AS (SELECT {_NODE} FROM conversations WHERE conv_id % 5 = 0 AND turn = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node, CAST(node % 1000 AS INT) AS hops FROM r")
def propagate_dirty(t):
    """All that depends on changed nodes."""
    return graph.closure(_nodes(t).where("conv_id % 5 = 0 AND turn = 0"), _edges(t))


@query(
    "reachability",
    f"""WITH RECURSIVE e AS {_EDGES}, r(node) AS (SELECT {_NODE} FROM conversations WHERE turn = 0 AND conv_id % 3 = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
    SELECT {_NODE} AS node, CASE WHEN r.node IS NOT NULL THEN 'reachable' WHEN role = 'assistant' THEN 'unknown' ELSE 'not_reachable' END AS verdict, CASE WHEN r.node IS NOT NULL THEN CAST(turn AS INT) END AS hops FROM conversations c LEFT JOIN r ON r.node = {_NODE}""",
)
def reachability(t):
    n = _nodes(t)
    return graph.reachability(n.select("node", (F.col("role") == "assistant").alias("open")), n.where("turn = 0 AND conv_id % 3 = 0"), _edges(t))


@query(
    "shortest_paths",
    f"""WITH RECURSIVE e AS {_EDGES}, r(node, p) AS (SELECT {_NODE}, CAST({_NODE} AS VARCHAR) FROM conversations WHERE turn = 0 AND conv_id % 4 = 0 UNION SELECT e.dst, r.p || '>' || CAST(e.dst AS VARCHAR) FROM r JOIN e ON e.src = r.node) SELECT node, p AS path FROM r""",
)
def shortest_paths(t):
    p = graph.shortest_paths(_nodes(t).where("turn = 0 AND conv_id % 4 = 0"), _edges(t))
    return p.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("dirty_nodes", "SELECT doc_id AS node FROM documents WHERE doc_id % 10 IN (0, 3)")
def dirty_nodes(t):
    """Against a snapshot that lacks every tenth document and has another text for some."""
    now = t.documents.select(F.col("doc_id").alias("node"), F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(24)).alias("hash"))
    before = now.where("node % 10 <> 0").withColumn("hash", F.when(F.col("node") % 10 == 3, F.lit("old")).otherwise(F.col("hash")))
    return graph.dirty_nodes(before, now)


@query("neighbors", f"WITH e AS {_EDGES} SELECT src AS node, dst AS other, 'imports' AS kind FROM e UNION SELECT dst, src, 'imported-by' FROM e")
def neighbors(t):
    return graph.neighbors(_edges(t))


@query("graph_stats", f"WITH e AS {_EDGES} SELECT (SELECT count(*) FROM conversations) AS files, (SELECT count(*) FROM e) AS edges")
def graph_stats(t):
    return _nodes(t).agg(F.count("*").alias("files")).crossJoin(_edges(t).agg(F.count("*").alias("edges")))


@query(
    "call_edges",
    """WITH n AS (SELECT item_id AS node, (regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'))[3] AS name FROM benchmark), w AS (SELECT DISTINCT doc_id AS src, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
    SELECT DISTINCT src, -1 - node AS dst FROM w JOIN n USING (name) WHERE length(name) >= 6""",
)
def call_edges(t):
    """Documents that use the third word of a benchmark item as a callee."""
    names = t.benchmark.select((-1 - F.col("item_id")).alias("node"), F.get(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lit(2)).alias("name")).where(F.length("name") >= 6)
    return graph.call_edges(t.documents.select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("body")), names)


_SYM = "(SELECT DISTINCT source AS repo, doc_id AS file, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{5,}')) AS name FROM documents)"


@query("shared_symbols", f"WITH s AS {_SYM} SELECT s.repo, s.file, s.name, n FROM s JOIN (SELECT repo, name, count(*) - 1 AS n FROM s GROUP BY 1, 2) c ON s.repo = c.repo AND s.name = c.name WHERE n > 0")
def shared_symbols(t):
    s = t.documents.select(F.col("source").alias("repo"), F.col("doc_id").alias("file"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("name"))
    return graph.shared_symbols(s)


@query(
    "import_context",
    """WITH p AS (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) AS n, coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
    SELECT source, doc_id, least(n, 6000 - before) AS taken FROM p WHERE before < 6000""",
)
def import_context(t):
    """Imported texts until 6000 bytes are full; the last is cut."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    d = with_sum_before(t.documents.select("source", "doc_id", n.alias("n")), ["source"], "doc_id", "n")
    return d.where("before < 6000").select("source", "doc_id", F.least("n", 6000 - F.col("before")).alias("taken"))


@query("enclosing_unit", "SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS unit FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL")
def enclosing_unit(t):
    """The range of ten that encloses a finding's value, among its user's ranges; an equality join on the range's number."""
    at = F.floor(F.col("value") / 10)
    units = t.events.select("user_id", at.alias("unit"), (at * 10).alias("first"), (at * 10 + 10).alias("end")).distinct()
    e = t.events.select("event_id", "user_id", "value", at.alias("unit"))
    return e.join(units, ["user_id", "unit"]).where((F.col("value") >= F.col("first")) & (F.col("value") < F.col("end"))).select("event_id", "unit")
