"""Records of chains, versions, roles and re-checks made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.functions import text as fx
from auditspark.operators import history, roles, tags
from auditspark.plans.base import query
from auditspark.plans.bindings import LINES_SQL
from auditspark.sources import tool_reports

_TAGS = "(SELECT user_id, 'v' || CAST(event_id AS VARCHAR) AS tag, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'v' || CAST(event_id AS VARCHAR)) AS place, lag('v' || CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, 'v' || CAST(event_id AS VARCHAR)) AS old FROM events)"


def _tags(t):
    found = t.events.select(F.col("user_id").alias("project"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("tag"), F.col("ts").alias("created"))
    # A cursor at each user's first purchase; every third user's cursor is a tag that is gone.
    first = t.events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("project")).agg(F.min("event_id").alias("e"))
    cursors = first.select("project", F.when(F.col("project") % 3 == 0, F.lit("gone")).otherwise(F.concat(F.lit("v"), F.col("e").cast("string"))).alias("cursor"))
    return found, cursors


@query(
    "tag_stream",
    f"""WITH t AS (SELECT * FROM {_TAGS}), c AS (SELECT user_id, 'v' || CAST(min(event_id) AS VARCHAR) AS cursor FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0 GROUP BY 1),
    b AS (SELECT t.user_id, place AS base FROM t JOIN c ON t.user_id = c.user_id AND t.tag = c.cursor) SELECT t.user_id AS project, old, tag AS new FROM t JOIN b ON t.user_id = b.user_id WHERE place > base""",
)
def tag_stream(t):
    """Versions after the cursor, chained to the one before; a lost cursor gives none."""
    return tags.tag_triggers(*_tags(t))


@query("tag_cursors", "SELECT user_id AS project, 'v' || CAST(arg_max(event_id, (ts, 'v' || CAST(event_id AS VARCHAR))) AS VARCHAR) AS cursor FROM events GROUP BY 1")
def tag_cursors(t):
    """Cursors after a poll."""
    return tags.next_cursors(*_tags(t))


@query(
    "read_transactions",
    "SELECT 'h' || CAST(event_id AS VARCHAR) AS tx_hash, 'd' || CAST(user_id AS VARCHAR) AS deployer, event_id AS block_number, 'c' || CAST(event_id AS VARCHAR) AS contract FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 AND event_id % 5 <> 0",
)
def read_transactions(t):
    """Contracts that watched deployers made: transactions without a receiver, with a receipt."""
    e = t.events
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    to = F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.lit("0xabc"))
    tx = F.struct(F.concat(F.lit("h"), i).alias("hash"), F.concat(F.lit("D"), u).alias("from"), to.alias("to"))
    blocks = e.select(F.to_json(F.struct(F.concat(F.lit("0x"), F.hex("event_id")).alias("number"), F.array(tx).alias("transactions"))).alias("value")).unionByName(t.spark.sql("SELECT 'no json' AS value"))
    receipts = e.where("event_id % 5 <> 0").select(F.concat(F.lit("h"), i).alias("tx_hash"), F.concat(F.lit("c"), i).alias("contract"))
    watched = e.where("user_id % 2 = 0").select(F.concat(F.lit("d"), u).alias("deployer")).distinct()
    return tool_reports.deployments(tool_reports.read_transactions(blocks), receipts, watched)


@query(
    "role_map",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'setFee' ELSE 'readFee' END AS function, doc_id % 2 = 0 AS guarded, 'admin,fee' AS roles FROM documents WHERE doc_id % 4 < 2""",
)
def role_map(t):
    """Functions whose name holds a power, guarded or not, in contracts that hold each document in a string."""
    name = F.when(F.col("doc_id") % 4 < 2, "setFee").otherwise("readFee")
    guard = F.when(F.col("doc_id") % 2 == 0, "onlyAdmin ").otherwise("")
    words = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\n", " "), "[^a-z ]|owner|admin|controller|guardian|governor|manager|operator|fee|paused|whitelist", "")
    file = F.concat(F.lit("contract C { address admin; uint fee; string s = '"), words, F.lit("';\nfunction "), name, F.lit("(uint f) public "), guard, F.lit("{ fee = f; } }"))
    out = roles.role_map(t.documents.select("doc_id", file.alias("text"), F.lit("solidity").alias("lang")))
    return out.select("doc_id", "function", "guarded", F.array_join("roles", ",").alias("roles"))


@query(
    "classify_finding",
    """SELECT doc_id, CASE WHEN regexp_matches(p, 'reentrancy|re-entrancy|reentrant') THEN 'reentrancy' WHEN regexp_matches(p, 'access control|onlyowner|unauthorized|privilege|missing check') THEN 'access-control' ELSE 'generic' END AS kind
    FROM (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' Reentrant call' WHEN 1 THEN ' Missing check' ELSE '' END) AS p FROM documents)""",
)
def classify_finding(t):
    title = F.when(F.col("doc_id") % 5 == 0, " Reentrant call").when(F.col("doc_id") % 5 == 1, " Missing check").otherwise("")
    return t.documents.select("doc_id", code.classify_finding(F.coalesce("text", F.lit("")), title).alias("kind"))


@query(
    "state_writes",
    f"SELECT DISTINCT doc_id, 'v' || regexp_extract(content, '([a-z]+)', 1) || '_' || length(content) AS name FROM {LINES_SQL} WHERE length(content) % 6 IN (0, 4, 5)",
)
def state_writes(t):
    """A statement for each line, by its length: an assignment, a declaration, a
    comparison, a member, an element, a sum; what a function assigns and does not declare."""

    def statement(x):
        v, k = F.concat(F.lit("v"), F.regexp_extract(x, "([a-z]+)", 1), F.lit("_"), F.length(x).cast("string")), F.length(x) % 6
        with_ = lambda before, after: F.concat(F.lit(before), v, F.lit(after))
        return F.when(k == 0, with_("", " = a;")).when(k == 1, with_("uint ", " = a;")).when(k == 2, with_("if (", " == a) g();")).when(k == 3, with_("", ".x = 2;")).when(k == 4, with_("", "[a][0] = 1;")).otherwise(with_("", " += 1;"))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), statement)
    body = F.concat(F.lit("function f(uint a) { string memory s = 'x'; uint b = a; b = 3;\n"), F.array_join(lines, "\n"), F.lit(" }"))
    return t.documents.select("doc_id", F.explode(code.state_writes(body)).alias("name"))


@query("authz_fingerprint", "SELECT c_custkey, left(sha256('{\"program\":\"p' || CAST(c_nationkey AS VARCHAR) || '\",\"researcher\":\"r' || CAST(c_custkey AS VARCHAR) || '\",\"source\":\"s\",\"assets\":[\"a\",\"b' || CAST(c_custkey AS VARCHAR) || '\"]}'), 16) AS fingerprint FROM customer")
def authz_fingerprint(t):
    c = t.customer
    i = F.col("c_custkey").cast("string")
    print_ = fx.authz_fingerprint(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")), F.concat(F.lit("r"), i), F.lit("s"), F.array(F.lit("a"), F.concat(F.lit("b"), i)))
    return c.select("c_custkey", print_.alias("fingerprint"))


@query(
    "redive_claim",
    """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1), r AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 <> 1 UNION ALL SELECT -1)
    SELECT r.user_id AS id, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'purchase' THEN 'already resolved' ELSE 'claimed' END AS result FROM r LEFT JOIN s USING (user_id)""",
)
def redive_claim(t):
    """Claims of items: resolved ones are refused, unknown ones named."""
    events = t.events.select(F.col("user_id").alias("id"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "resolved").otherwise(F.col("event_type")).alias("status"))
    asked = t.events.where("user_id % 4 <> 1").select(F.col("user_id").alias("id")).distinct().unionByName(t.spark.sql("SELECT -1L AS id"))
    return history.redive_claim(events, asked.withColumn("by", F.lit("me")), ["ts", "event_id"]).select("id", "result")


@query(
    "redive_resolve",
    """WITH s AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS id, CASE user_id % 4 WHEN 0 THEN 'bad outcome' ELSE 'resolved' END AS result, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fixed' WHEN 2 THEN 'accepted_risk' ELSE 'still_open' END AS outcome FROM s""",
)
def redive_resolve(t):
    """Resolutions with an outcome of the taxonomy; others are refused."""
    events = t.events.select(F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("status"))
    k = F.col("user_id") % 4
    asked = t.events.select("user_id").distinct().select(F.col("user_id").alias("id"), F.lit("me").alias("by"), F.when(k == 0, "forgotten").when(k == 1, "fixed").when(k == 2, "accepted_risk").otherwise("still_open").alias("outcome"))
    return history.redive_resolve(events, asked, ["ts", "event_id"]).select("id", "result", "outcome")
