"""Filter, join, aggregate, sync and event plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import relational as R
from textquarry.plans import PlanSet
from textquarry.plans.base import exact_sql
from textquarry.streaming.windows import over_limit, sessions, threshold_alerts

plans = PlanSet()


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@plans.add("s4_exact_duplicates", "SELECT doc_id, md5(text) AS md5, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS is_first FROM documents")
def s4_exact_duplicates(spark, d):
    return R.first_by_hash(t(spark, d, "documents"), "text", "doc_id").select("doc_id", "md5", "first_id", "is_first")


@plans.add("f1_o5_order_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def f1_o5_order_page(spark, d):
    rows = R.equal_filters(t(spark, d, "orders"), o_orderstatus="F").where(R.contains_ci(F.col("o_orderpriority"), "URGENT"))
    return R.page(rows.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40)


@plans.add("j6_child_counts", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j6_child_counts(spark, d):
    return R.with_child_count(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), "c_custkey", "o_custkey", "orders")


@plans.add("j1_a5_stage_totals", "SELECT o_orderpriority, round(avg(l_quantity), 6) AS avg_qty, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price_per_unit, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority")
def j1_a5_stage_totals(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice").join(o, "l_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("price_per_unit"), F.count(F.lit(1)).alias("n"))


_RATE = exact_sql("CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0) * 100", 2, False)


@plans.add("a2_success_rate", f"SELECT o_custkey % 500 AS k, coalesce({_RATE}, 0) AS success_rate, count(*) AS n FROM orders GROUP BY 1")
def a2_success_rate(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy((F.col("o_custkey") % 500).alias("k")).agg(R.success_rate(s == "F", s == "P").alias("success_rate"), F.count(F.lit(1)).alias("n"))


@plans.add("a8_hour_trend", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS bucket, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def a8_hour_trend(spark, d):
    return R.trend(t(spark, d, "events"), "ts", "hour", F.round(F.avg("value"), 6).alias("avg_value")).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@plans.add("a17_histogram", "SELECT le, n FROM (SELECT count(*) FILTER (value <= 10.0) a, count(*) FILTER (value <= 50.0) b, count(*) FILTER (value <= 100.0) c, count(value) d FROM events), LATERAL (VALUES ('10.0', a), ('50.0', b), ('100.0', c), ('+Inf', d)) v(le, n)")
def a17_histogram(spark, d):
    return R.histogram(t(spark, d, "events"), "value", [10.0, 50.0, 100.0])


@plans.add("a10_map_sum", "SELECT k AS key, sum(CAST(json_extract(props, concat('$.', k)) AS BIGINT)) AS total FROM events, LATERAL unnest(json_keys(props)) u(k) GROUP BY 1")
def a10_map_sum(spark, d):
    return R.map_sum(t(spark, d, "events").select(F.from_json("props", "map<string,bigint>").alias("m")), "m")


@plans.add("j8_snapshot_diff", "WITH r AS (SELECT c_custkey AS id, md5(concat(c_name, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END)) AS m FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT c_custkey AS id, md5(c_name) AS m FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(r.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'add' WHEN r.id IS NULL THEN 'remove' WHEN r.m <> s.m THEN 'update' ELSE 'skip' END AS action FROM r FULL JOIN s ON r.id = s.id")
def j8_snapshot_diff(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    remote = c.where(k % 5 != 0).select(k.alias("id"), F.md5(F.concat("c_name", F.when(k % 7 == 0, "x").otherwise(""))).alias("m"))
    return R.snapshot_diff(remote, c.where(k % 3 != 0).select(k.alias("id"), F.md5("c_name").alias("m")), "id", "m")


@plans.add("j10_bulk_outcome", "SELECT pos, id, CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'wrong_state' END AS outcome FROM (VALUES (0, 1::BIGINT), (1, 5), (2, 1), (3, 999999999), (4, 7)) v(pos, id) LEFT JOIN orders ON o_orderkey = id")
def j10_bulk_outcome(spark, d):
    return R.bulk_outcome(spark, [1, 5, 1, 999999999, 7], t(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F")


@plans.add("st2_last_state", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def st2_last_state(spark, d):
    return R.last_state(t(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_type")


@plans.add("st7_rate_limit", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3")
def st7_rate_limit(spark, d):
    return over_limit(t(spark, d, "events"), "event_type", "ts", 3, "1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@plans.add("st_session_windows", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, count(*) AS n FROM y GROUP BY user_id, s")
def st_session_windows(spark, d):
    return sessions(t(spark, d, "events"), "user_id", "ts").select("user_id", "n")


@plans.add("st6_threshold_alerts", """WITH RECURSIVE e AS (SELECT event_type AS kind, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS r FROM events),
    s AS (SELECT kind, us, r, 1 AS n, us AS start FROM e WHERE r = 1 UNION ALL SELECT e.kind, e.us, e.r, CASE WHEN e.us - start > 3600000000 THEN 1 ELSE n + 1 END, CASE WHEN e.us - start > 3600000000 THEN e.us ELSE start END FROM s JOIN e ON e.kind = s.kind AND e.r = s.r + 1)
    SELECT kind, us AS "at", n FROM s WHERE n = 3""")
def st6_threshold_alerts(spark, d):
    return threshold_alerts(t(spark, d, "events"), "event_type", "ts", 3)
