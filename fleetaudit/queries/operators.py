"""Each operator bound to the given tables by column names."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import operators as ops
from ..functions import dotted_part, parent_location
from .registry import Tables, query

ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


@query("o1_rule_scan", """
SELECT l_orderkey, l_linenumber, 1 AS check_id, 0 AS case_no, CAST(NULL AS VARCHAR) AS database_name,
       l_returnflag AS object_name, l_quantity AS metric FROM lineitem WHERE l_quantity >= 49
UNION ALL SELECT l_orderkey, l_linenumber, 2, 0, NULL, l_returnflag, l_tax FROM lineitem WHERE l_tax >= 0.08
UNION ALL SELECT l_orderkey, l_linenumber, 3, 0, NULL, l_returnflag, l_discount FROM lineitem
WHERE l_returnflag = 'R' AND l_discount = 0
""")
def o1_rule_scan(t: Tables) -> DataFrame:
    """O1: three rules over lineitem in one scan."""
    flag = F.col("l_returnflag")
    return ops.rule_scan(t.lineitem, [
        ops.RowRule(1, F.col("l_quantity") >= 49, object=flag, metric=F.col("l_quantity")),
        ops.RowRule(2, F.col("l_tax") >= 0.08, object=flag, metric=F.col("l_tax")),
        ops.RowRule(3, (flag == "R") & (F.col("l_discount") == 0), object=flag, metric=F.col("l_discount")),
    ], keep=("l_orderkey", "l_linenumber"))


@query("o2_settings_rules", """
WITH s AS (SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value, p_size % 10 AS major FROM part
           UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, p_size % 10 FROM part),
     r(check_id, case_no, name, op, lim, lo, hi) AS (VALUES
       (10, 0, 'p_size', '>', 45.0, NULL, NULL), (11, 0, 'p_size', '=', 1.0, NULL, NULL),
       (12, 0, 'p_retailprice', '<', 910.0, 3.0, 7.0), (12, 1, 'p_retailprice', '>=', 1050.0, 8.0, NULL),
       (13, 0, 'p_size', 'any', NULL, NULL, 0.0))
SELECT s.p_partkey, r.check_id, r.case_no, CAST(NULL AS VARCHAR) AS database_name, s.name AS object_name, s.value AS metric
FROM s JOIN r USING (name)
WHERE ((op = '>' AND value > lim) OR (op = '=' AND value = lim) OR (op = '<' AND value < lim)
       OR (op = '>=' AND value >= lim) OR (op = 'any' AND value IS NOT NULL))
  AND (lo IS NULL OR major >= lo) AND (hi IS NULL OR major <= hi)
""")
def o2_settings_rules(t: Tables) -> DataFrame:
    """O2: part attributes as name/value rows against a rule table with version ranges."""
    settings = t.part.select("p_partkey", (F.col("p_size") % 10).alias("major"), F.expr(
        "stack(2, 'P_Size', CAST(p_size AS DOUBLE), 'P_RetailPrice', p_retailprice) AS (name, value)"))
    found = ops.settings_rules(settings, [
        ops.SettingRule(10, "p_size", ">", 45), ops.SettingRule(11, "p_size", "=", 1),
        ops.SettingRule(12, "p_retailprice", "<", 910, versions=(3, 7)),
        ops.SettingRule(12, "p_retailprice", ">=", 1050, case_no=1, versions=(8, None)),
        ops.SettingRule(13, "p_size", "any", versions=(None, 0)),
    ], value="value", keep=("p_partkey",), version="major")
    return found.withColumn("object_name", F.lower("object_name"))


@query("o3_settings_drift", """
SELECT event_id, event_type, CAST(trunc(value) AS BIGINT) AS configured,
       CAST(json_extract(props, '$.k') AS BIGINT) AS running
FROM events WHERE trunc(value) <> CAST(json_extract(props, '$.k') AS BIGINT)
  AND NOT (event_type = 'view' AND trunc(value) IN (0, 16) AND CAST(json_extract(props, '$.k') AS BIGINT) IN (0, 16))
""")
def o3_settings_drift(t: Tables) -> DataFrame:
    """O3: configured value (truncated) against the running one in the JSON, with a tolerated pair."""
    settings = t.events.select("event_id", "event_type", F.col("value").cast("long").alias("configured"),
                               F.get_json_object("props", "$.k").cast("long").alias("running"))
    return ops.settings_drift(settings, "configured", "running", "event_type", tolerated={"view": (0, 16)})


@query("o3_settings_pair", """
WITH w AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN trunc(value) END) AS first_value,
                  max(CASE WHEN event_type = 'view' THEN trunc(value) END) AS second_value FROM events GROUP BY user_id)
SELECT user_id, CAST(first_value AS BIGINT) AS first_value, CAST(second_value AS BIGINT) AS second_value
FROM w WHERE first_value = second_value OR first_value > second_value + 20
""")
def o3_settings_pair(t: Tables) -> DataFrame:
    """O3: two named settings side by side per owner, equal or far apart."""
    wide = ops.settings_pair(t.events.withColumn("v", F.col("value").cast("long")), "click", "view",
                             name="event_type", value="v", keys=("user_id",))
    return wide.where((F.col("first_value") == F.col("second_value"))
                      | (F.col("first_value") > F.col("second_value") + 20))


@query("o4_missing_coverage", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
""")
def o4_missing_coverage(t: Tables) -> DataFrame:
    """Customers without an urgent order."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return ops.missing_coverage(t.customer.select("c_custkey", "c_name"), urgent, ["c_custkey"])


@query("o5_stale_last_event", """
SELECT c_custkey, max(o_orderdate) AS last_event FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey HAVING max(o_orderdate) <= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 180 DAY
""")
def o5_stale_last_event(t: Tables) -> DataFrame:
    """Customers whose last order is at least 180 days old."""
    return ops.stale_last_event(t.customer.select("c_custkey"),
                                t.orders.withColumnRenamed("o_custkey", "c_custkey"),
                                ["c_custkey"], "o_orderdate", "180 DAYS", ORDERS_AS_OF)


@query("o6_objective_breach", """
WITH u AS (SELECT DISTINCT user_id FROM events),
     l AS (SELECT user_id, max(ts) AS last_event FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, last_event, date_diff('minute', last_event, TIMESTAMP '2024-01-31 00:00:00') AS minutes_since,
       CASE WHEN last_event IS NULL THEN 'never' ELSE 'late' END AS breach
FROM u LEFT JOIN l USING (user_id)
WHERE last_event IS NULL OR date_diff('minute', last_event, TIMESTAMP '2024-01-31 00:00:00') > 2880
""")
def o6_objective_breach(t: Tables) -> DataFrame:
    """Users without a purchase in the last two days, in minutes, or never."""
    return ops.objective_breach(t.events.select("user_id").distinct(), t.events.where("event_type = 'purchase'"),
                                ["user_id"], "ts", 2880, EVENTS_AS_OF)


@query("o6_objective_per_entity", """
WITH l AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_event FROM orders
           WHERE o_orderstatus = 'P' AND o_totalprice > 300000 GROUP BY o_custkey)
SELECT c_custkey, objective, last_event,
       date_diff('minute', last_event, TIMESTAMP '2001-08-02 00:00:00') AS minutes_since,
       CASE WHEN last_event IS NULL THEN 'never' ELSE 'late' END AS breach
FROM (SELECT c_custkey, (c_nationkey + 1) * 20000 AS objective FROM customer) LEFT JOIN l USING (c_custkey)
WHERE last_event IS NULL OR date_diff('minute', last_event, TIMESTAMP '2001-08-02 00:00:00') > objective
""")
def o6_objective_per_entity(t: Tables) -> DataFrame:
    """An objective per entity; both branches (late and never) occur."""
    entities = t.customer.select("c_custkey", ((F.col("c_nationkey") + 1) * 20000).alias("objective"))
    events = (t.orders.where("o_orderstatus = 'P' AND o_totalprice > 300000")
              .withColumnRenamed("o_custkey", "c_custkey"))
    return ops.objective_breach(entities, events, ["c_custkey"], "o_orderdate", "objective", ORDERS_AS_OF)


@query("o7_required_set", """
WITH u AS (SELECT DISTINCT user_id FROM events),
     r(event_type, lo, hi) AS (VALUES ('signup', NULL, NULL), ('error', NULL, 5), ('click', 3, NULL), ('view', NULL, NULL),
                                      ('purchase', NULL, NULL))
SELECT user_id, event_type FROM u CROSS JOIN r
WHERE (lo IS NULL OR user_id % 10 >= lo) AND (hi IS NULL OR user_id % 10 <= hi)
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = r.event_type
                  AND e.ts >= TIMESTAMP '2024-01-29 00:00:00')
""")
def o7_required_set(t: Tables) -> DataFrame:
    """Event types a user lacks in the last two days, two of them only for a version range."""
    users = t.events.select("user_id").distinct().withColumn("version", F.col("user_id") % 10)
    required = [{"event_type": "signup"}, {"event_type": "error", "max_version": 5},
                {"event_type": "click", "min_version": 3}, {"event_type": "view"}, {"event_type": "purchase"}]
    recent = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'")
    return ops.required_set_missing(users, required, recent, ["event_type"], "version", owner=["user_id"])


@query("o8_heterogeneity", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1)
""")
def o8_heterogeneity(t: Tables) -> DataFrame:
    """Lines of orders with more than one return flag."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return ops.group_heterogeneity(lines, ["l_orderkey"], "l_returnflag", members=True)


@query("o8_heterogeneity_count", """
SELECT l_suppkey, count(DISTINCT (l_returnflag, l_linestatus)) AS distinct_values FROM lineitem
GROUP BY l_suppkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1
""")
def o8_heterogeneity_count(t: Tables) -> DataFrame:
    """Number of distinct (flag, status) pairs per supplier."""
    return ops.group_heterogeneity(t.lineitem, ["l_suppkey"], ["l_returnflag", "l_linestatus"], count=True)


@query("o9_group_threshold", """
SELECT l_orderkey, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 6
""")
def o9_group_threshold(t: Tables) -> DataFrame:
    """Orders with six or more lines."""
    return ops.group_threshold(t.lineitem, ["l_orderkey"], {
        "n_lines": F.count(F.lit(1)), "quantity": F.sum("l_quantity").cast("long"),
        "last_ship": F.max("l_shipdate")}, "n_lines >= 6")


@query("o10_conditional_sum", """
SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS BIGINT) AS first_sum,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS BIGINT) AS second_sum
FROM lineitem GROUP BY l_suppkey
HAVING sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) > sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END)
   AND sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) > 1000
""")
def o10_conditional_sum(t: Tables) -> DataFrame:
    """Suppliers with more quantity returned than accepted."""
    return ops.conditional_sum_compare(t.lineitem, ["l_suppkey"], F.col("l_quantity").cast("long"),
                                       F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", at_least=1000)


@query("o10_ratio", """
SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*) AS ratio FROM events GROUP BY user_id
HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / nullif(count(*), 0) > 0.22
""")
def o10_ratio(t: Tables) -> DataFrame:
    """Users with an error share above 0.22."""
    counts = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("double").alias("errors"),
                                             F.count(F.lit(1)).alias("n"))
    return ops.ratio_threshold(counts, F.col("errors"), F.col("n").cast("double"), 0.22).select("user_id", "ratio")


_PAIRS = """
SELECT user_id, event_id, ts, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id
       AND p.event_type = 'purchase' AND p.ts > e.ts) AS end_at
FROM events e WHERE event_type = 'error'
"""


def _pairing(t: Tables) -> tuple:
    return (t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts",
            F.col("event_type") == "error", F.col("event_type") == "purchase", "6 hours")


@query("o11_pairing_detail", f"""
SELECT *, (epoch_us(end_at) // 1000) - (epoch_us(ts) // 1000) AS duration_ms FROM ({_PAIRS}) WHERE end_at IS NOT NULL
""")
def o11_pairing_detail(t: Tables) -> DataFrame:
    """Each error with the user's next purchase."""
    return ops.next_event_pairing(*_pairing(t)).drop("event_type")


@query("o11_pairing_summary", f"""
SELECT user_id, count(*) AS pairs, CAST(sum((epoch_us(end_at) // 1000) - (epoch_us(ts) // 1000)) AS BIGINT) AS total_ms,
       sum((epoch_us(end_at) // 1000) - (epoch_us(ts) // 1000)) / count(*) AS avg_ms
FROM ({_PAIRS}) WHERE end_at IS NOT NULL GROUP BY user_id
""")
def o11_pairing_summary(t: Tables) -> DataFrame:
    """Count and average time to the next purchase per user."""
    return ops.pairing_summary(*_pairing(t))


@query("o12_log_extract", """
SELECT page_id, 'secure' AS kind, regexp_extract(url, '^(https)://([^/]+)([^?#]*)', 1) AS scheme,
       regexp_extract(url, '^(https)://([^/]+)([^?#]*)', 2) AS host,
       regexp_extract(url, '^(https)://([^/]+)([^?#]*)', 3) AS path
FROM pages WHERE url LIKE 'https://%'
""")
def o12_log_extract(t: Tables) -> DataFrame:
    """Scheme, host and path of secure page addresses."""
    return ops.log_extract(t.pages, [ops.LogPattern("secure", "https://", "^(https)://([^/]+)([^?#]*)",
                                                    ("scheme", "host", "path"))], message="url", keep=("page_id",))


@query("o12_log_extract_many", """
SELECT doc_id, kind, email, host FROM (
  SELECT doc_id, regexp_extract(text, '(?i)([a-z0-9._]+)@([a-z0-9.]+)', 1) AS email,
         regexp_extract(text, '(?i)([a-z0-9._]+)@([a-z0-9.]+)', 2) AS host, 'address' AS kind FROM documents
  WHERE regexp_matches(text, '(?i)([a-z0-9._]+)@([a-z0-9.]+)')
  UNION ALL
  SELECT doc_id, NULL, regexp_extract(text, '(?i)https?://([a-z0-9.-]+)', 1), 'link' FROM documents
  WHERE regexp_matches(text, '(?i)https?://([a-z0-9.-]+)') AND NOT regexp_matches(text, '(?i)([a-z0-9._]+)@([a-z0-9.]+)'))
""")
def o12_log_extract_many(t: Tables) -> DataFrame:
    """Two patterns in one pass over whole texts; the first that matches names the kind."""
    return ops.log_extract(t.documents, [
        ops.LogPattern("address", "@", r"([a-z0-9._]+)@([a-z0-9.]+)", ("email", "host")),
        ops.LogPattern("link", "://", r"https?://([a-z0-9.-]+)", ("host",)),
    ], message="text", keep=("doc_id",))


@query("o13_first_event", """
SELECT user_id, min(ts) AS first_event FROM events GROUP BY user_id HAVING min(ts) <= TIMESTAMP '2024-01-01 06:00:00'
""")
def o13_first_event(t: Tables) -> DataFrame:
    """Users whose first event is before six on the first day."""
    return ops.first_event(t.events, ["user_id"], "ts", "2024-01-01 06:00:00")


@query("o14_attributes_wide", """
SELECT user_id, min(props) FILTER (event_type = 'click') AS click, min(props) FILTER (event_type = 'error') AS error,
       min(props) FILTER (event_type = 'purchase') AS purchase, min(props) FILTER (event_type = 'signup') AS signup,
       min(props) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id
""")
def o14_attributes_wide(t: Tables) -> DataFrame:
    """Attribute rows of a user to one wide row, names given."""
    return ops.attributes_wide(t.events, ["click", "error", "purchase", "signup", "view"], key="user_id",
                               attr="event_type", value="props")


@query("o15_privilege_audit", """
SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN
  (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AND NOT (c_mktsegment = 'BUILDING')
""")
def o15_privilege_audit(t: Tables) -> DataFrame:
    """Holders of a grant inside a role, less an exception."""
    region = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    inside = ops.privilege_audit(t.customer, region, [("c_nationkey", "n_nationkey")], F.col("r_name") == "ASIA",
                                 exceptions=F.col("c_mktsegment") == "BUILDING")
    return ops.privilege_audit(inside, t.orders, [("c_custkey", "o_custkey")],
                               F.col("o_totalprice") > 450000).select("c_custkey", "c_name")


@query("o15_role_members", """
SELECT m.group_id, r.s_suppkey AS role_id, r.s_name AS role_name, p.s_suppkey AS member_id, p.s_name AS member_name
FROM (SELECT DISTINCT s_nationkey % 3 AS group_id, l_partkey AS role_id, l_suppkey AS member_id
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) m
JOIN supplier r ON r.s_suppkey = m.role_id AND r.s_nationkey % 3 = m.group_id
JOIN supplier p ON p.s_suppkey = m.member_id AND p.s_nationkey % 3 = m.group_id WHERE p.s_suppkey <> r.s_suppkey
""")
def o15_role_members(t: Tables) -> DataFrame:
    """Role and member names of membership rows, inside each group."""
    people = t.supplier.select((F.col("s_nationkey") % 3).alias("group_id"), F.col("s_suppkey").alias("principal_id"),
                               F.col("s_name").alias("name"), F.lit("S").alias("type"))
    home = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 3).alias("group_id"))
    links = (t.lineitem.select(F.col("l_partkey").alias("role_principal_id"), F.col("l_suppkey").alias("member_principal_id"))
             .distinct().join(home, F.col("member_principal_id") == F.col("s_suppkey")).drop("s_suppkey"))
    return (ops.role_members(people, links, ["group_id"]).where("member_id <> role_id")
            .select("group_id", "role_id", "role_name", "member_id", "member_name"))


@query("o16_ownership", """
SELECT l_orderkey, l_suppkey, s_nationkey, c_nationkey AS owner_nation FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE s_nationkey <> c_nationkey
""")
def o16_ownership(t: Tables) -> DataFrame:
    """Lines whose supplier's nation is not that of the order's owner."""
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_suppkey", "s_nationkey")
    owned = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    people = t.customer.select(F.col("c_custkey").alias("sid"), F.col("c_nationkey").alias("nation"))
    audited = ops.ownership_audit(owned, people, owner="o_custkey", keys=(), carry=("nation",))
    return (audited.where(F.col("owner_known") & (F.col("s_nationkey") != F.col("owner_nation")))
            .select("l_orderkey", "l_suppkey", "s_nationkey", "owner_nation"))


@query("o17_self_link", """
SELECT a.conv_id, a.turn, a.role, b.turn AS source_turn, b.role AS source_role, length(b.text) AS source_chars
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
""")
def o17_self_link(t: Tables) -> DataFrame:
    """Each conversation turn with the turn before it."""
    turns = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"),
                                   (F.col("turn") - 1).alias("previous"))
    return ops.snapshot_of(turns, ["conv_id"], "previous", "turn", ["turn", "role", "chars"]).drop("chars", "previous")


@query("o18_version_gate", """
WITH band(k, m) AS (VALUES (1.0, 5.0), (2.0, 8.0), (3.0, 12.0), (4.0, 17.0), (5.0, 22.0))
SELECT p_partkey, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no, CAST(m AS DOUBLE) AS band_min
FROM part JOIN band ON p_size // 10 = k WHERE CAST(split_part(p_brand, '#', 2) AS INTEGER) < m
""")
def o18_version_gate(t: Tables) -> DataFrame:
    """Brand numbers below the minimum of their size band."""
    parts = t.part.select("p_partkey", F.expr("p_size div 10").alias("band"),
                          F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("brand_no"))
    bands = [(1.0, 5.0), (2.0, 8.0), (3.0, 12.0), (4.0, 17.0), (5.0, 22.0)]
    return ops.version_gate(parts, bands, "band", "brand_no").drop("band")


@query("o18_version_columns", """
SELECT s_suppkey, 10 + s_nationkey % 8 + CASE WHEN s_suppkey % 2 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS major,
       CAST(s_suppkey * 7 AS INTEGER) AS build FROM supplier
""")
def o18_version_columns(t: Tables) -> DataFrame:
    """Major version and build parsed out of a dotted version."""
    text = F.concat_ws(".", 10 + F.col("s_nationkey") % 8, F.when(F.col("s_suppkey") % 2 == 1, "50").otherwise("0"),
                       F.col("s_suppkey") * 7, F.lit("1"))
    return ops.version_columns(t.supplier.select("s_suppkey", text.alias("v")), "v").drop("v")


@query("o19_recent_change", """
SELECT user_id, max(ts) AS last_event FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-30 00:00:00'
""")
def o19_recent_change(t: Tables) -> DataFrame:
    """Users with an event in the last 24 hours."""
    return ops.recent_change(t.events, ["user_id"], "ts", "24 HOURS", EVENTS_AS_OF)


_SPACE_COLUMNS = dict(user_alloc="ua", user_dealloc="ud", internal_alloc="ia", internal_dealloc="id_")


def _session_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    sessions = t.customer.selectExpr("c_custkey AS session_id", "CAST(greatest(c_acctbal, 0) AS BIGINT) AS ua",
                                     "CAST(c_nationkey AS BIGINT) AS ud", "CAST(0 AS BIGINT) AS ia", "CAST(0 AS BIGINT) AS id_")
    tasks = t.orders.where("o_orderstatus = 'P'").selectExpr(
        "o_custkey AS session_id", "CAST(o_totalprice AS BIGINT) AS ua", "o_orderkey % 100 AS ud",
        "o_custkey % 50 AS ia", "CAST(0 AS BIGINT) AS id_")
    return sessions, tasks


def _space_oracle(per: int) -> str:
    def part(expr: str, name: str) -> str:
        return f"CAST(({expr}) / {per}.0 AS DECIMAL(18,1)) AS {name}"

    return f"""
WITH s AS (SELECT c_custkey AS session_id, CAST(trunc(greatest(c_acctbal, 0)) AS BIGINT) AS ua, CAST(c_nationkey AS BIGINT) AS ud,
                  0 AS ia, 0 AS id_ FROM customer),
     k AS (SELECT o_custkey AS session_id, CAST(trunc(o_totalprice) AS BIGINT) AS ua, o_orderkey % 100 AS ud,
                  o_custkey % 50 AS ia, 0 AS id_ FROM orders WHERE o_orderstatus = 'P'),
     ids AS (SELECT session_id FROM s WHERE ua > 0 OR ia > 0 UNION SELECT session_id FROM k WHERE ua > 0 OR ia > 0),
     kk AS (SELECT session_id, sum(ua - ud + ia - id_) AS n, sum(ua - ud) AS u, sum(ia - id_) AS i FROM k GROUP BY session_id)
SELECT session_id, {part('s.ua - s.ud + s.ia - s.id_', 'session_space')}, {part('s.ua - s.ud', 'session_user_space')},
       {part('s.ia - s.id_', 'session_internal_space')}, {part('kk.n', 'running_space')}, {part('kk.u', 'running_user_space')},
       {part('kk.i', 'running_internal_space')}
FROM ids LEFT JOIN s USING (session_id) LEFT JOIN kk USING (session_id)
"""


@query("o20_space_usage", _space_oracle(128))
def o20_space_usage(t: Tables) -> DataFrame:
    """Net space of active sessions and their tasks, in MB."""
    return ops.session_space(*_session_tables(t), ["session_id"], **_SPACE_COLUMNS)


@query("o20_space_usage_gb", _space_oracle(131072))
def o20_space_usage_gb(t: Tables) -> DataFrame:
    """The same in GB."""
    return ops.session_space(*_session_tables(t), ["session_id"], **_SPACE_COLUMNS, unit="gb")


@query("o20_space_summary", """
SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) / 128.0 AS DECIMAL(18,1)) AS total_space,
       CAST(sum(CAST(l_linenumber AS BIGINT)) / 128.0 AS DECIMAL(18,1)) AS used_space FROM lineitem GROUP BY l_suppkey
""")
def o20_space_summary(t: Tables) -> DataFrame:
    """Page sums per owner in MB."""
    pages = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_linenumber")
    return ops.space_summary(pages, ["l_suppkey"], {"total_space": "q", "used_space": "l_linenumber"})


@query("o21_contention", """
WITH w AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'PAGELATCH_EX' WHEN 'click' THEN 'PAGELATCH_SH'
                  WHEN 'view' THEN 'pagelatch_up' WHEN 'signup' THEN 'PAGELATCH_KP' ELSE 'LCK_M_X' END AS wait_type FROM events),
     p AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'SGAM_PAGE' WHEN 1 THEN 'GAM_PAGE' WHEN 2 THEN 'PFS_PAGE'
                  WHEN 3 THEN 'DATA_PAGE' WHEN 4 THEN 'INDEX_PAGE' ELSE 'IAM_PAGE' END AS page_type_desc FROM part)
SELECT event_id, wait_type, CAST(2 AS BIGINT) AS database_id, event_id % 4 AS file_id, event_id AS page_id, page_type_desc,
       CASE WHEN page_type_desc IN ('SGAM_PAGE', 'GAM_PAGE', 'PFS_PAGE') AND wait_type <> 'PAGELATCH_KP' THEN 'ALLOCATION CONTENTION'
            WHEN page_type_desc IN ('DATA_PAGE', 'INDEX_PAGE') AND wait_type <> 'PAGELATCH_KP' THEN 'METADATA CONTENTION'
       END AS contention_kind
FROM w JOIN p ON p_partkey = event_id WHERE user_id % 3 = 2 AND wait_type <> 'LCK_M_X'
""")
def o21_contention(t: Tables) -> DataFrame:
    """Latch waits on database 2 with the page type of their resource."""
    requests = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "PAGELATCH_EX").when(F.col("event_type") == "click", "PAGELATCH_SH")
        .when(F.col("event_type") == "view", "pagelatch_up").when(F.col("event_type") == "signup", "PAGELATCH_KP")
        .otherwise("LCK_M_X").alias("wait_type"),
        F.concat_ws(":", F.col("user_id") % 3, F.col("event_id") % 4, "event_id").alias("wait_resource"))
    kinds = [(0, "SGAM_PAGE"), (1, "GAM_PAGE"), (2, "PFS_PAGE"), (3, "DATA_PAGE"), (4, "INDEX_PAGE")]
    pages = ops.label_dim(t.part.withColumn("m", F.col("p_size") % 7), "m", kinds, "IAM_PAGE", "page_type_desc").select(
        F.lit(2).cast("long").alias("database_id"), (F.col("p_partkey") % 4).alias("file_id"),
        F.col("p_partkey").alias("page_id"), "page_type_desc")
    return ops.contention(requests, pages, keys=()).drop("wait_resource")


_REPORT_RULES = [
    ops.Rule(203, 1, "Missing urgent order", "Customer {object} has no urgent order", "Review the customer."),
    ops.Rule(205, 1, "No recent order", "Customer {object} has not ordered for 180 days", "Contact the customer."),
    ops.Rule(603, 3, "Customer in debt", "Customer {object} has a balance of {metric}", "Ask for payment."),
]


def flagship(t: Tables) -> DataFrame:
    """Coverage gaps, stale entities and a row rule, as one sorted report."""
    customers = t.customer.select("c_custkey", "c_name")
    key_orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")

    def raw(df: DataFrame, check_id: int) -> DataFrame:
        return df.select(F.col("c_custkey").cast("string").alias("instance_id"), F.lit(check_id).alias("check_id"),
                         F.lit(0).alias("case_no"), F.lit(None).cast("string").alias("database_name"),
                         F.col("c_name").alias("object_name"), F.lit(None).cast("double").alias("metric"))

    gaps = ops.missing_coverage(customers, key_orders.where("o_orderpriority = '1-URGENT'"), ["c_custkey"])
    stale = ops.stale_last_event(customers, key_orders, ["c_custkey"], "o_orderdate", "180 DAYS", ORDERS_AS_OF)
    debt = ops.rule_scan(t.customer.withColumn("instance_id", F.col("c_custkey").cast("string")),
                         [ops.RowRule(603, F.col("c_acctbal") < -900, object=F.col("c_name"),
                                      metric=F.floor("c_acctbal"))])
    return ops.report([raw(gaps, 203), raw(stale, 205), debt], _REPORT_RULES)


@query("o22_report", """
WITH f AS (
  SELECT CAST(c_custkey AS VARCHAR) AS instance_id, 203 AS check_id, 1 AS importance, 'Missing urgent order' AS check_name,
         'Customer ' || c_name || ' has no urgent order' AS issue, c_name AS details, 'Review the customer.' AS action_step,
         CAST(NULL AS DOUBLE) AS metric FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), 205, 1, 'No recent order', 'Customer ' || c_name || ' has not ordered for 180 days', c_name,
         'Contact the customer.', NULL FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
  HAVING max(o_orderdate) <= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 180 DAY
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), 603, 3, 'Customer in debt',
         'Customer ' || c_name || ' has a balance of ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), c_name,
         'Ask for payment.', floor(c_acctbal) FROM customer WHERE c_acctbal < -900)
SELECT instance_id, CAST(check_id // 100 AS SMALLINT) AS category_id,
       CASE check_id // 100 WHEN 2 THEN 'Recoverability' ELSE 'Reliability' END AS category, check_id,
       CAST(importance AS SMALLINT) AS importance, CASE importance WHEN 1 THEN 'High' ELSE 'Low' END AS importance_label,
       check_name, issue, CAST(NULL AS VARCHAR) AS database_name, details, action_step,
       'docs/checks.md#' || CAST(check_id AS VARCHAR) AS read_more_url, metric FROM f
""")
def o22_report(t: Tables) -> DataFrame:
    """Findings with texts, category and labels, sorted."""
    return flagship(t)


@query("o23_reclassify", """
SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 91 WHEN l_returnflag = 'A' AND l_tax >= 0.08 THEN 92 ELSE 90 END AS check_id,
       l_returnflag AS object_name FROM lineitem WHERE l_quantity >= 49
""")
def o23_reclassify(t: Tables) -> DataFrame:
    """Findings on one flag get another id; the first matching rule wins."""
    found = ops.rule_scan(t.lineitem, [ops.RowRule(90, F.col("l_quantity") >= 49, object=F.col("l_returnflag"),
                                                   metric=F.col("l_tax"))], keep=("l_orderkey",))
    flag = F.col("object_name")
    return ops.reclassify(found, [(90, flag == "R", 91), (90, (flag == "A") & (F.col("metric") >= 0.08), 92)]).select(
        "l_orderkey", "check_id", "object_name")


@query("o24_string_list", """
SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY user_id
""")
def o24_string_list(t: Tables) -> DataFrame:
    """The distinct event types of a user in one cell."""
    return ops.string_list(t.events, ["user_id"], "event_type", "types")


@query("o24_label_dim", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Full' WHEN 'O' THEN 'Open' ELSE 'Unknown' END AS status_text FROM orders
""")
def o24_label_dim(t: Tables) -> DataFrame:
    """Text for a status code with a default."""
    return ops.label_dim(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus",
                         [("F", "Full"), ("O", "Open")], "Unknown", "status_text").drop("o_orderstatus")


def _last_oracle(code: str) -> str:
    return (f"(SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = '{code}' GROUP BY o_custkey) m{code} "
            f"LEFT JOIN orders o{code} ON o{code}.o_orderkey = m{code}.k LEFT JOIN n n{code} ON n{code}.l_orderkey = m{code}.k")


@query("o25_last_by_type", f"""
WITH n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey), ids AS (SELECT DISTINCT o_custkey FROM orders)
SELECT ids.o_custkey, {", ".join(f'm{c}.k AS last_{p}_o_orderkey, o{c}.o_orderdate AS last_{p}_o_orderdate, o{c}.o_totalprice AS last_{p}_o_totalprice, CASE WHEN m{c}.k IS NOT NULL THEN coalesce(n{c}.c, 0) END AS last_{p}_n_lines' for c, p in (('F', 'full'), ('O', 'open'), ('P', 'partial')))}
FROM ids {" ".join(f'LEFT JOIN ({_last_oracle(c)}) ON m{c}.o_custkey = ids.o_custkey' for c in "FOP")}
""")
def o25_last_by_type(t: Tables) -> DataFrame:
    """The last order of each status per customer, side by side, with its line count."""
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c"))
    history = t.orders.join(counts, "o_orderkey", "left").withColumn("n_lines", F.coalesce("c", F.lit(0)))
    return ops.last_by_type_wide(history, ["o_custkey"], "o_orderstatus", {"F": "full", "O": "open", "P": "partial"},
                                 "o_orderkey", ["o_orderkey", "o_orderdate", "o_totalprice", "n_lines"])


@query("o26_detail", """
SELECT l_orderkey, l_linenumber, size, compressed, count(*) OVER (PARTITION BY l_orderkey) AS file_count,
       CAST(trunc(size / count(*) OVER (PARTITION BY l_orderkey) / 100.0) AS BIGINT) AS size_mb,
       CAST(trunc(compressed / count(*) OVER (PARTITION BY l_orderkey) / 100.0) AS BIGINT) AS compressed_size_mb,
       CAST((size - compressed) * 100.0 / nullif(size, 0) AS DECIMAL(5,2)) AS compression_percent
FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS size,
             CAST(trunc(l_extendedprice) AS BIGINT) - CAST(trunc(l_quantity) AS BIGINT) * 10 AS compressed FROM lineitem)
""")
def o26_detail(t: Tables) -> DataFrame:
    """Size of a line split over the lines of its order, and a compression percentage."""
    size = F.col("l_extendedprice").cast("long")
    files = t.lineitem.select("l_orderkey", "l_linenumber", size.alias("size"),
                              (size - F.col("l_quantity").cast("long") * 10).alias("compressed"))
    return ops.backup_detail(files, ["l_orderkey"], "size", "compressed", bytes_per_unit=100)


@query("o26_chain", """
SELECT lang, source, (SELECT count(DISTINCT source) FROM documents d WHERE d.lang = x.lang) AS number_of_paths
FROM (SELECT DISTINCT lang, source FROM documents) x
""")
def o26_chain(t: Tables) -> DataFrame:
    """Distinct sources per language with their number."""
    return ops.chain_report(t.documents, ["lang"], "source")


@query("o26_last_restore", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def o26_last_restore(t: Tables) -> DataFrame:
    """The latest order per customer; the key breaks ties."""
    return ops.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                              ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("o27_dictionary", """
WITH l AS (SELECT c_custkey, c_name AS name, CAST(c_custkey AS VARCHAR) AS salt,
                  sha256(CAST(c_custkey AS VARCHAR) || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN 'password'
                         ELSE lower(c_mktsegment) END) AS digest FROM customer),
     c(weakness, word) AS (VALUES ('blank', ''), ('listed word', 'password'), ('segment', 'building'))
SELECT c_custkey, weakness FROM l JOIN c ON sha256(salt || word) = digest
UNION ALL SELECT c_custkey, 'own name' FROM l WHERE sha256(salt || name) = digest
""")
def o27_dictionary(t: Tables) -> DataFrame:
    """Logins whose salted digest fits a listed word, the empty word or their own name."""
    salt, n = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    word = F.when(n == 0, "").when(n == 1, F.col("c_name")).when(n == 2, "password").otherwise(F.lower("c_mktsegment"))
    logins = t.customer.select("c_custkey", F.col("c_name").alias("name"), salt.alias("salt"),
                               F.sha2(F.concat(salt, word), 256).alias("digest"))
    return ops.credential_dictionary_audit(logins, [("blank", ""), ("listed word", "password"), ("segment", "building")]).select(
        "c_custkey", "weakness")


@query("o27_dictionary_table", """
WITH l AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS salt, c_name AS name,
                  sha256(CAST(c_custkey AS VARCHAR) || CASE c_custkey % 5 WHEN 0 THEN (SELECT min(p_type) FROM part) WHEN 1 THEN c_name WHEN 2 THEN (SELECT max(p_name) FROM part)
                         ELSE lower(c_mktsegment) END) AS digest FROM customer),
     w AS (SELECT DISTINCT 'segment' AS weakness, lower(c_mktsegment) AS word FROM customer UNION SELECT DISTINCT 'part type', p_type FROM part UNION SELECT DISTINCT 'part name', p_name FROM part)
SELECT c_custkey, weakness FROM l JOIN w ON sha256(salt || word) = digest
UNION ALL SELECT c_custkey, 'own name' FROM l WHERE sha256(salt || name) = digest
""")
def o27_dictionary_table(t: Tables) -> DataFrame:
    """O27 against a table of words: types and names of all parts and the segments."""
    ends = t.part.agg(F.min("p_type").alias("first"), F.max("p_name").alias("last")).first()
    salt, n = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    word = F.when(n == 0, ends["first"]).when(n == 1, F.col("c_name")).when(n == 2, ends["last"]).otherwise(F.lower("c_mktsegment"))
    logins = t.customer.select("c_custkey", F.col("c_name").alias("name"), salt.alias("salt"), F.sha2(F.concat(salt, word), 256).alias("digest"))
    words = (t.customer.select(F.lit("segment").alias("weakness"), F.lower("c_mktsegment").alias("word"))
             .unionByName(t.part.select(F.lit("part type").alias("weakness"), F.col("p_type").alias("word")))
             .unionByName(t.part.select(F.lit("part name").alias("weakness"), F.col("p_name").alias("word"))))
    return ops.credential_dictionary_join(logins, words).select("c_custkey", "weakness")


@query("o28_resolve", """
SELECT event_id, CAST(event_id % 3 AS INTEGER) AS class, user_id AS major_id,
       CASE event_id % 3 WHEN 0 THEN c_name WHEN 1 THEN s_name ELSE p_name END AS object_name
FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN part ON p_partkey = user_id
""")
def o28_resolve(t: Tables) -> DataFrame:
    """A name by class code and id from one long dimension over three tables."""
    def side(df: DataFrame, code: int, key: str, name: str) -> DataFrame:
        return df.select(F.lit(code).alias("class"), F.col(key).alias("id"), F.col(name).alias("name"))

    dim = (side(t.customer, 0, "c_custkey", "c_name").union(side(t.supplier, 1, "s_suppkey", "s_name"))
           .union(side(t.part, 2, "p_partkey", "p_name")))
    grants = t.events.select("event_id", (F.col("event_id") % 3).cast("int").alias("class"), F.col("user_id").alias("major_id"))
    return ops.resolve_securable(grants, dim, keys=())


@query("o29_state_changes", """
SELECT CAST(user_id AS VARCHAR) AS instance_id, 'availability_replica_state_change' AS object_name,
       ts + CAST((user_id % 5) * 90 - 120 AS INTEGER) * INTERVAL 1 MINUTE AS event_time, 'AG_' || CAST(user_id % 7 AS VARCHAR) AS group_name,
       event_type AS previous_state, CASE WHEN value < 10 THEN 'RESOLVING_NORMAL' ELSE 'PRIMARY_NORMAL' END AS current_state
FROM events WHERE event_type <> 'view'
""")
def o29_state_changes(t: Tables) -> DataFrame:
    """Fields of state-change payloads in XML, at the instance's local time."""
    xml = F.concat(
        F.lit('<event name="s" timestamp="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit('"><data name="previous_state"><value>1</value><text>'), "event_type",
        F.lit('</text></data><data name="current_state"><value>2</value><text>'),
        F.when(F.col("value") < 10, "RESOLVING_NORMAL").otherwise("PRIMARY_NORMAL"),
        F.lit('</text></data><data name="availability_group_name"><value>AG_'), (F.col("user_id") % 7).cast("string"),
        F.lit("</value></data></event>"))
    events = t.events.select(F.col("user_id").cast("string").alias("instance_id"), xml.alias("event_data"),
                             F.when(F.col("event_type") == "view", "other").otherwise("availability_replica_state_change")
                             .alias("object_name"))
    instances = t.events.select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("instance_id"),
        ((F.col("user_id") % 5) * 90 - 120).cast("int").alias("utc_offset_minutes"))
    return ops.state_changes(events, instances)


@query("o30_parent_location", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '{' || CASE WHEN page_id % 10 = 0 THEN 'UNKNOWN' ELSE 'Virtual Device' END || '}'
                     WHEN page_id % 5 = 1 THEN nullif(regexp_extract(replace(url, '/', chr(92)), '^(.*\\\\)[^\\\\]+$', 1), '')
                     ELSE nullif(regexp_extract(url, '^(.*/)[^/]+$', 1), '') END AS location FROM pages
""")
def o30_parent_location(t: Tables) -> DataFrame:
    """The folder of a path, by either separator, or its device."""
    path = (F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("{"), "url")).when(
        F.col("page_id") % 5 == 1, F.translate("url", "/", "\\")).otherwise(F.col("url")))
    device = F.when(F.col("page_id") % 10 != 0, "Virtual Device")
    return t.pages.select("page_id", path.alias("p"), device.alias("d")).select(
        "page_id", parent_location("p", "d").alias("location"))


@query("o31_scope", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1999-12-31 00:00:00'
""")
def o31_scope(t: Tables) -> DataFrame:
    """Set filters apply, unset ones do not; a word stands for its code."""
    return ops.scope(t.orders, start=("o_orderdate", "1997-01-01 00:00:00"), end=("o_orderdate", "1999-12-31 00:00:00"),
                     remap={"o_orderstatus": {"full": "F"}}, o_orderstatus="full", o_custkey=None,
                     o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderstatus")


_ELIGIBLE = """
WITH d AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 12 AS INTEGER) AS state, o_orderkey % 11 = 3 AS standby,
                  o_orderkey % 17 = 0 AS snap, CAST(o_custkey % 6 + 10 AS DOUBLE) AS major, o_custkey % 5 = 0 AS managed FROM orders),
     m AS (SELECT l_orderkey, bool_and(l_quantity > 5) AS preferred FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey AS instance_id, o_orderkey AS database_id,
       CASE WHEN major >= 11 AND NOT managed THEN m.preferred END AS is_preferred_backup_replica
FROM d LEFT JOIN m ON l_orderkey = o_orderkey
WHERE state NOT IN (1, 6, 10) AND NOT standby AND NOT snap AND o_orderkey <> 2
  AND ((major >= 11 AND NOT managed) OR o_orderkey > 4)
  AND coalesce(CASE WHEN major >= 11 AND NOT managed THEN m.preferred END, TRUE)
"""


@query("o32_eligible", _ELIGIBLE)
def o32_eligible(t: Tables) -> DataFrame:
    """Databases the instance answers for; no preference counts as preferred."""
    databases = t.orders.selectExpr(
        "o_custkey AS instance_id", "o_orderkey AS database_id", "concat('DB', o_orderkey) AS name",
        "CAST(o_orderkey % 12 AS INT) AS state", "o_orderkey % 11 = 3 AS is_in_standby",
        "CASE WHEN o_orderkey % 17 = 0 THEN 1 END AS source_database_id")
    instances = t.customer.selectExpr("c_custkey AS instance_id", "CAST(c_custkey % 6 + 10 AS DOUBLE) AS major",
                                      "CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE 3 END AS engine_edition")
    groups = (t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("is_preferred_backup_replica"))
              .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .select(F.col("o_custkey").alias("instance_id"), F.concat(F.lit("db"), "l_orderkey").alias("database_name"),
                      F.lit("g").alias("group_id"), F.lit("g").alias("group_name"), "is_preferred_backup_replica"))
    return (ops.eligible_databases(databases, groups, instances)
            .where(F.coalesce("is_preferred_backup_replica", F.lit(True)))
            .select("instance_id", "database_id", "is_preferred_backup_replica"))


@query("o32_applicability", """
SELECT CAST(c_custkey AS VARCHAR) AS instance_id, check_id FROM customer CROSS JOIN (VALUES (217), (502), (999)) v(check_id)
WHERE (check_id = 217 AND c_nationkey % 8 + 10 >= 13) OR check_id = 999
   OR (check_id = 502 AND c_custkey % 4 IN (2, 3) AND c_custkey % 7 <> 0)
""")
def o32_applicability(t: Tables) -> DataFrame:
    """Findings pass only where the rule's version, edition and rights gates are met."""
    instances = t.customer.selectExpr("CAST(c_custkey AS STRING) AS instance_id", "CAST(c_nationkey % 8 + 10 AS DOUBLE) AS major",
                                      "CAST(c_custkey % 4 AS INT) AS engine_edition", "c_custkey % 7 <> 0 AS collected_as_sysadmin")
    findings = instances.select("instance_id", F.explode(F.array(F.lit(217), F.lit(502), F.lit(999))).alias("check_id"))
    return ops.applicability(findings, instances, {217: {"min_version": 13},
                                                   502: {"editions": (2, 3, 8), "needs_sysadmin": True}})
