"""Audit, hierarchy and access queries."""

from pyspark.sql import functions as F

from ..plans import audit as A
from ..sources import sinks
from .registry import part, query
from .site import Site


def entries(s: Site):
    """Audit entries written as JSON out of the events, some of them spoiled."""
    i = F.col("event_id")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    at = F.when(i % 43 == 0, "yesterday").when(i % 47 == 0, "2025-05-05T00:00:00").otherwise(F.date_format(F.col("ts") + F.expr("interval 800 days"), "yyyy-MM-dd'T'HH:mm:ss"))
    kind = F.when(i % 29 == 0, "Bad").otherwise(F.concat(F.when(i % 2 == 0, "forecast.").otherwise("settings."), F.col("event_type")))
    details = F.when(i % 31 == 0, "[1]").otherwise(
        F.concat(F.lit('{"k": '), i, F.lit(', "Token": "x", "deep": {"password": 1, "v": ['), i % 7, F.lit(', {"text": "t", "z": 2}]}}'))
    )
    body = F.concat(
        F.lit('{"event_id": '), q(F.when(i % 3 == 0, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad((i % 300).cast("string"), 12, "0"))).otherwise("none")),
        F.lit(', "occurred_at": '), q(at), F.lit(', "service": '), q(F.when(i % 37 == 0, "").otherwise("core")), F.lit(', "event_type": '), q(kind),
        F.lit(', "outcome": '), q(F.when(i % 41 == 0, "maybe").otherwise("success")), F.lit(', "actor_kind": "service", "actor_login": '), q(F.concat(F.lit("u"), F.col("user_id"))),
        F.lit(', "area_id": '), F.when(i % 5 == 0, '"north"').otherwise((i % 9).cast("string")), F.lit(', "details": '), details, F.lit("}"),
    )
    return s.table("events").select(F.concat(F.lit("e"), F.lpad(i.cast("string"), 9, "0")).alias("entry_id"), F.when(i % 53 == 0, "{oops").otherwise(body).alias("body"))


part(
    "aud",
    "",
    """SELECT *, CASE WHEN event_id % 53 = 0 THEN 'not a JSON object' WHEN event_id % 31 = 0 THEN 'details is not an object' WHEN event_id % 37 = 0 THEN 'no service' WHEN event_id % 29 = 0 THEN 'bad event_type'
 WHEN event_id % 41 = 0 THEN 'bad outcome' WHEN event_id % 43 = 0 THEN 'occurred_at is not a time' WHEN event_id % 47 = 0 THEN 'occurred_at is out of the journal' END AS reason,
 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS entry_id, CASE WHEN event_id % 3 = 0 THEN event_id % 300 END AS dup, date_trunc('second', ts) + INTERVAL 800 DAY AS at_ts,
 CASE WHEN event_id % 2 = 0 THEN 'forecast.' ELSE 'settings.' END || event_type AS kind FROM events""",
)


@query(
    "audit_parse",
    "aud",
    """SELECT entry_id, reason, CASE WHEN reason IS NULL THEN at_ts END AS occurred_at, CASE WHEN reason IS NULL THEN kind END AS event_type, CASE WHEN reason IS NULL THEN 'u' || user_id END AS actor_login,
 CASE WHEN reason IS NULL AND event_id % 5 <> 0 THEN event_id % 9 END AS area_id, CASE WHEN reason IS NULL AND event_id % 5 = 0 THEN 'north' END AS area_raw FROM aud""",
)
def audit_parse(s: Site):
    p = A.parse_events(entries(s))
    ok = F.col("reason").isNull()
    return p.select("entry_id", "reason", *[F.when(ok, F.col(c)).alias(c) for c in ("occurred_at", "event_type", "actor_login", "area_id", "area_raw")])


@query(
    "audit_scrub",
    "aud",
    """SELECT entry_id, '{"k":' || event_id || ',"deep":{"v":[' || event_id % 7 || ',{"z":2}]}}' AS details, 'Token,deep.password,deep.v.text' AS dropped FROM aud WHERE reason IS NULL""",
)
def audit_scrub(s: Site):
    p = A.parse_events(entries(s)).where("reason is null")
    return p.select("entry_id", "details", F.concat_ws(",", "dropped").alias("dropped"))


part("reqs", "", "SELECT *, CASE WHEN event_id % 23 = 0 THEN 'occurred_at is not a time' WHEN event_id % 19 = 0 THEN 'bad request row' WHEN event_id % 17 = 0 THEN 'route has a query' WHEN event_id % 13 = 0 THEN 'no service or route' END AS reason FROM events")


@query("audit_requests", "reqs", "SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'GET' END AS method, CASE WHEN reason IS NULL THEN CAST(event_id % 500 AS INTEGER) END AS duration_ms FROM reqs")
def audit_requests(s: Site):
    i = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.when(i % 23 == 0, "now").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("occurred_at"), F.when(i % 13 == 0, "").otherwise("core").alias("service"), F.lit("get").alias("method"),
            F.when(i % 17 == 0, "/a?b=1").otherwise("/a/{id}").alias("route"), F.when(i % 19 == 0, "ok").otherwise("200").alias("status"), (i % 500).alias("duration_ms"),
        )
    )
    p = A.parse_requests(s.table("events").select(i.alias("entry_id"), body.alias("body")))
    ok = F.col("reason").isNull()
    return p.select(F.col("entry_id").alias("event_id"), "reason", F.when(ok, F.col("method")).alias("method"), F.when(ok, F.col("duration_ms")).alias("duration_ms"))


@query(
    "audit_write",
    "aud",
    """SELECT count(*) AS received, count(reason) AS dead, count(DISTINCT CASE WHEN reason IS NULL THEN coalesce('d' || dup, entry_id) END) AS written,
 count(*) FILTER (reason IS NULL) - count(DISTINCT CASE WHEN reason IS NULL THEN coalesce('d' || dup, entry_id) END) AS duplicates FROM aud""",
)
def audit_write(s: Site):
    return A.write_batch(A.parse_events(entries(s)))[2]


@query(
    "audit_partitions",
    "",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH > (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY GROUP BY 1",
)
def audit_partitions(s: Site):
    """Orders as dated rows: written by month, read back, old months dropped."""
    o = s.table("orders").select("o_orderkey", "o_orderdate", A.month_of("o_orderdate").alias("month"))
    path = sinks.overwrite_hours(o.hint("rebalance", "month"), sinks.scratch(s.spark, "audit"), ["month"])
    last = o.agg(F.max("o_orderdate").alias("m")).first()["m"]
    back = s.spark.read.parquet(path)
    kept = A.keep_months(back, "o_orderdate", F.lit(last).cast("timestamp_ntz"))
    return kept.groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_query",
    "aud",
    "SELECT event_id AS id, at_ts AS occurred_at, kind AS event_type FROM aud WHERE reason IS NULL AND (kind LIKE 'forecast.%' OR kind = 'settings.error') AND event_id < 9000 AND at_ts >= '2026-03-15' ORDER BY at_ts DESC, event_id DESC LIMIT 150",
)
def audit_query(s: Site):
    p = A.parse_events(entries(s)).where("reason is null").withColumn("id", F.substring("entry_id", 2, 9).cast("bigint"))
    q = A.query_events(p, ["forecast.", "settings.error"], since=F.lit("2026-03-15").cast("timestamp_ntz"), before_id=9000, limit=150, service="core")
    return q.select("id", "occurred_at", "event_type")


# suppliers as a tree of three levels with some lost parents
part("tree", "", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN -1 WHEN s_suppkey < 10 THEN 0 ELSE s_suppkey % 9 + 1 END AS parent FROM supplier")
part(
    "climb",
    "tree",
    """SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path, parent AS up, parent IS NOT NULL AND parent NOT IN (SELECT id FROM tree) AS orphan FROM tree
UNION ALL SELECT c.id, t.id, c.depth + 1, t.id || '/' || c.path, t.parent, c.orphan FROM climb c JOIN tree t ON t.id = c.up""",
)


@query(
    "object_tree",
    "climb",
    """SELECT id, root, CAST(depth AS INTEGER) AS depth, path, orphan, (SELECT count(*) FROM climb l WHERE l.root = c.id AND l.id NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)) AS leaves
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS r FROM climb) c WHERE r = 1""",
)
def object_tree(s: Site):
    k = F.col("s_suppkey")
    parent = F.when(k % 17 == 0, -1).when(k < 10, 0).otherwise(k % 9 + 1)
    t = s.table("supplier").select(k.alias("id"), F.when(k != 0, parent).alias("parent"))
    return A.object_tree(t).withColumn("path", F.concat_ws("/", "path"))


part("edges2", "", "SELECT s_suppkey // 3 AS parent, s_suppkey AS child FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey // 9, s_suppkey FROM supplier WHERE s_suppkey >= 9 AND s_suppkey % 5 = 0")
part("clo", "edges2", "SELECT s_suppkey AS ancestor, s_suppkey AS descendant, 0 AS depth FROM supplier UNION SELECT c.ancestor, e.child, c.depth + 1 FROM clo c JOIN edges2 e ON e.parent = c.descendant")


def hierarchy(s: Site):
    k = F.col("s_suppkey")
    t = s.table("supplier")
    e = t.where(k > 0).select(F.floor(k / 3).alias("parent"), k.alias("child"))
    e = e.unionByName(t.where((k >= 9) & (k % 5 == 0)).select(F.floor(k / 9).alias("parent"), k.alias("child")))
    return e, t.select(k.alias("code"))


def closure(s: Site):
    if not hasattr(s, "_closure"):
        s._closure = A.group_closure(*hierarchy(s))
    return s._closure


@query("group_closure", "clo", "SELECT ancestor, descendant, CAST(min(depth) AS INTEGER) AS depth FROM clo GROUP BY 1, 2")
def group_closure(s: Site):
    return closure(s)


part("acts", "", "SELECT o_custkey % 50 AS grp, o_orderpriority AS resource, string_agg(DISTINCT ['C', 'R', 'U', 'D', 'E'][o_orderkey % 5 + 1], '') AS letters, list(DISTINCT o_orderkey % 5) AS n FROM orders GROUP BY 1, 2")


@query("permission_mask", "acts", "SELECT grp, resource, CAST(list_sum(list_transform(n, lambda x: CAST(pow(2, x) AS INTEGER))) AS INTEGER) AS mask FROM acts")
def permission_mask(s: Site):
    letter = F.element_at(F.array(*[F.lit(x) for x in "CRUDE"]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    g = s.table("orders").select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderpriority").alias("resource"), F.concat(letter, letter).alias("actions"))
    return A.permission_mask(g)


@query(
    "access_scope",
    "clo",
    """SELECT u AS user_id, count(*) AS rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM (SELECT u, l_quantity FROM (SELECT unnest([1, 2, 3, 4, 5]) AS u) JOIN lineitem ON u = 5 OR l_suppkey IN (SELECT descendant FROM clo WHERE ancestor IN (u, u * 7))) GROUP BY u""",
)
def access_scope(s: Site):
    users = s.spark.createDataFrame([(u, u == 5) for u in range(1, 6)], "user_id int, sees_all boolean")
    assigned = s.spark.createDataFrame([(u, x) for u in range(1, 6) for x in (u, u * 7)], "user_id int, object_id bigint")
    rows = s.table("lineitem").select(F.col("l_suppkey").alias("object_id"), "l_quantity")
    numbers = A.tree_numbers(*hierarchy(s))
    spans = A.scope_spans(users, assigned, closure(s), numbers)
    return A.scope_totals(rows, spans, numbers, {"quantity": F.sum("l_quantity")})


@query(
    "work_intervals",
    "",
    """SELECT user_id, min(day) AS date_from, max(day) AS date_to FROM (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS r FROM (
 SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE (user_id, CAST(ts AS DATE)) NOT IN (SELECT (user_id, CAST(ts AS DATE)) FROM events WHERE value > 150))) GROUP BY user_id, r""",
)
def work_intervals(s: Site):
    d = s.table("events").select("user_id", F.col("ts").cast("date").alias("day"), "value")
    return A.work_intervals(d, d.where("value > 150").select("user_id", "day").distinct())
