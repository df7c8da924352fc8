"""Joins over events, orders and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import windows as W
from .base import EV, bucket, events, of_type, query, t

DAY = bucket("1 day")
BUYS = "(select event_id, user_id, ts from events where event_type = 'purchase')"
VIEWS = "(select event_id as view_id, user_id, ts as view_ts from events where event_type = 'view')"


def buys(spark, d):
    return of_type(events(spark, d), "purchase").select("event_id", "user_id", "ts")


def views(spark, d):
    return of_type(events(spark, d), "view").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"))


@query("join_inner", "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 100000")
def join_inner(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 100000")
    return o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("join_left", "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) on o_custkey = c_custkey")
def join_left(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 300000")
    return t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_right", "select o_orderkey, c_custkey from (select * from orders where o_totalprice > 300000) right join customer on o_custkey = c_custkey")
def join_right(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 300000")
    return o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("join_full", "select n_name, s_name from (select * from nation where n_regionkey < 3) full join (select * from supplier where s_acctbal > 5000) on n_nationkey = s_nationkey")
def join_full(spark, d):
    n, s = t(spark, d, "nation").where("n_regionkey < 3"), t(spark, d, "supplier").where("s_acctbal > 5000")
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_name", "s_name")


def _interval_sql(condition: str) -> str:
    return f"select l.event_id, r.view_id from {BUYS} l join {VIEWS} r on l.user_id = r.user_id and {condition}"


def _interval(spark, d, back, ahead):
    out = J.interval_join(buys(spark, d), views(spark, d), ["user_id"], "ts", "view_ts", back * 3600, ahead * 3600)
    return out.select("event_id", "view_id")


@query("join_interval_sql_back", _interval_sql("l.ts between r.view_ts - interval '4 hours' and r.view_ts"))
def join_interval_sql_back(spark, d):
    return _interval(spark, d, 0, 4)


@query("join_interval_sql_sym", _interval_sql("r.view_ts between l.ts - interval '6 hours' and l.ts + interval '6 hours'"))
def join_interval_sql_sym(spark, d):
    return _interval(spark, d, 6, 6)


@query("join_interval_api", _interval_sql("r.view_ts between l.ts - interval '10 hours' and l.ts + interval '5 hours'"))
def join_interval_api(spark, d):
    return _interval(spark, d, 10, 5)


@query("join_tumble_inner", f"select l.event_id, r.view_id, {bucket('1 day', 'l.ts')} as window_start from {BUYS} l join {VIEWS} r on l.user_id = r.user_id and {bucket('1 day', 'l.ts')} = {bucket('1 day', 'r.view_ts')}")
def join_tumble_inner(spark, d):
    l, r = W.tumble(buys(spark, d), "ts", "1 day"), W.tumble(views(spark, d), "view_ts", "1 day").drop("window_time")  # noqa: E741
    return J.window_join(l, r, ["user_id"], "inner").select("event_id", "view_id", "window_start")


PER = f"(select user_id, {DAY} as window_start, count(*) as {{0}} from events where event_type = '{{1}}' group by all)"


@query("window_join_full", f"select user_id, window_start, buys, views from {PER.format('buys', 'purchase')} full join {PER.format('views', 'view')} using (user_id, window_start)")
def window_join_full(spark, d):
    per = lambda df, ts, n: W.tumble(df, ts, "1 day").groupBy("user_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias(n))
    out = J.window_join(per(buys(spark, d), "ts", "buys"), per(views(spark, d), "view_ts", "views"), ["user_id"], "full")
    return out.select("user_id", "window_start", "buys", "views")


def _window_sql(test: str) -> str:
    return f"select event_id from {BUYS} l where {test}".format(same=f"select r.user_id from {VIEWS} r where {bucket('1 day', 'r.view_ts')} = {bucket('1 day', 'l.ts')}")


def _in_windows(spark, d):
    r = W.tumble(views(spark, d), "view_ts", "1 day").select("user_id", "window_start")
    return W.tumble(buys(spark, d), "ts", "1 day"), r


@query("window_semi_in", _window_sql("l.user_id in ({same})"))
def window_semi_in(spark, d):
    l, r = _in_windows(spark, d)  # noqa: E741
    return l.join(r, ["user_id", "window_start"], "left_semi").select("event_id")


@query("window_semi_exists", _window_sql("exists ({same} and r.user_id = l.user_id)"))
def window_semi_exists(spark, d):
    return window_semi_in(spark, d)


@query("window_anti_not_in", _window_sql("l.user_id not in ({same})"))
def window_anti_not_in(spark, d):
    l, r = _in_windows(spark, d)  # noqa: E741
    return J.not_in(l, r, ["window_start"], "user_id").select("event_id")


@query("window_anti_not_exists", _window_sql("not exists ({same} and r.user_id = l.user_id)"))
def window_anti_not_exists(spark, d):
    l, r = _in_windows(spark, d)  # noqa: E741
    return l.join(r, ["user_id", "window_start"], "left_anti").select("event_id")


@query("join_asof_temporal", f"select l.event_id, l.user_id, r.view_id, r.view_ts from {BUYS} l asof left join {VIEWS} r on l.user_id = r.user_id and l.ts >= r.view_ts")
def join_asof_temporal(spark, d):
    return J.asof_join(buys(spark, d), views(spark, d), ["user_id"], "ts", "view_ts", ["view_id", "view_ts"]).select("event_id", "user_id", "view_id", "view_ts")


@query("join_lookup", "select c_custkey, coalesce(n_name, 'unknown') as n_name, coalesce(n_regionkey, -1) as n_regionkey from customer left join (select * from nation where n_regionkey <> 2) on c_nationkey = n_nationkey")
def join_lookup(spark, d):
    dim = t(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return J.lookup_join(t(spark, d, "customer"), dim, ["c_nationkey"], {"n_name": "unknown", "n_regionkey": -1}).select("c_custkey", "n_name", "n_regionkey")


@query("join_broadcast_enrich", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join (select * from region where r_regionkey < 4) on n_regionkey = r_regionkey")
def join_broadcast_enrich(spark, d):
    c, n, r = t(spark, d, "customer"), t(spark, d, "nation"), t(spark, d, "region").where("r_regionkey < 4")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("c_custkey", "n_name", "r_name")


@query("join_rule_filter", "select l.event_id, r.rule from (select event_id, user_id, ts, event_id % 5 as field from events where event_type = 'purchase') l asof join (select user_id, ts, event_id % 5 as rule from events where event_type = 'click') r on l.user_id = r.user_id and l.ts >= r.ts where l.field = r.rule")
def join_rule_filter(spark, d):
    rules = of_type(events(spark, d), "click").select("user_id", F.col("ts").alias("rule_ts"), (F.col("event_id") % 5).alias("rule"))
    return J.rule_filter(buys(spark, d).withColumn("field", F.col("event_id") % 5), rules, ["user_id"], "ts", "rule_ts", "field", "rule").select("event_id", "rule")


@query("join_stateful_inner", "select a.event_id as buy, b.event_id as signup from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'signup'")
def join_stateful_inner(spark, d):
    s = of_type(events(spark, d), "signup").select("user_id", F.col("event_id").alias("signup"))
    return buys(spark, d).join(s, "user_id").select(F.col("event_id").alias("buy"), "signup")


@query("join_gate_switch", f"select event_id from {BUYS} l where exists (select 1 from events s where s.event_type = 'signup' and s.user_id = l.user_id and l.ts >= s.ts and l.ts < s.ts + interval '12 hours')")
def join_gate_switch(spark, d):
    s = of_type(events(spark, d), "signup").select("user_id", F.col("ts").alias("on"))
    return J.gate(buys(spark, d), s, ["user_id"], "ts", "on", 12 * 3600).select("event_id")


@query("union_all", f"select event_id, event_type from {EV} where event_type in ('view', 'click', 'error')")
def union_all(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return of_type(e, "view").unionByName(of_type(e, "click")).unionByName(of_type(e, "error"))


