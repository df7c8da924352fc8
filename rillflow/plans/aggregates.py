"""Aggregations over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from .base import EV, bucket, events, of_type, query, total

DAY = bucket("1 day")


def _running_sql(f: str) -> str:
    return f"select event_id, user_id, cast({f}(value) over (partition by user_id order by event_id rows unbounded preceding) as double) as value from {EV}"


def _running(spark, d, f):
    out = A.running(events(spark, d), ["user_id"], ["event_id"], {"value": (f, "value")})
    return out.select("event_id", "user_id", F.col("value").cast("double").alias("value"))


@query("agg_running_sum", _running_sql("sum"))
def agg_running_sum(spark, d):
    return _running(spark, d, F.sum)


@query("agg_running_max", _running_sql("max"))
def agg_running_max(spark, d):
    return _running(spark, d, F.max)


@query("agg_running_min", _running_sql("min"))
def agg_running_min(spark, d):
    return _running(spark, d, F.min)


def _extreme_sql(order: str) -> str:
    return f"select user_id, event_id, event_type, cast(value as double) as value from (select *, row_number() over (partition by user_id order by value {order}, event_id) as rn from {EV}) where rn = 1"


def _extreme(spark, d, largest):
    out = A.extreme_row(events(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], "value", "event_id", largest)
    return out.withColumn("value", F.col("value").cast("double"))


@query("agg_max_by", _extreme_sql("desc"))
def agg_max_by(spark, d):
    return _extreme(spark, d, True)


@query("agg_min_by", _extreme_sql("asc"))
def agg_min_by(spark, d):
    return _extreme(spark, d, False)


@query("agg_reduce", f"select user_id, cast(sum(value) as double) as total from {EV} group by 1")
def agg_reduce(spark, d):
    return events(spark, d).groupBy("user_id").agg(total().alias("total"))


@query("agg_incremental", f"select event_type, cast(sum(value) as double) as total, count(*) as n, cast(sum(value) as double) / count(*) as mean from {EV} group by 1")
def agg_incremental(spark, d):
    return events(spark, d).groupBy("event_type").agg(total().alias("total"), F.count(F.lit(1)).alias("n"), (total() / F.count(F.lit(1))).alias("mean"))


@query("agg_incremental_with_window_meta", f"select event_type, {DAY} as window_start, {DAY} + interval '1 day' as window_end, cast(sum(value) as double) / count(*) as mean from {EV} group by 1, 2, 3")
def agg_incremental_with_window_meta(spark, d):
    return W.tumble(events(spark, d), "ts", "1 day").groupBy("event_type", "window_start", "window_end").agg((total() / F.count(F.lit(1))).alias("mean"))


@query("agg_window_reduce", f"select user_id, {DAY} as window_start, cast(sum(value) as double) as total from {EV} group by 1, 2")
def agg_window_reduce(spark, d):
    return W.tumble(events(spark, d), "ts", "1 day").groupBy("user_id", "window_start").agg(total().alias("total"))


@query("agg_map_accumulate_top3", f"select * from (select *, row_number() over (partition by window_start, event_type order by n desc, user_id) as rank from (select {DAY} as window_start, event_type, user_id, count(*) as n from {EV} group by 1, 2, 3)) where rank <= 3")
def agg_map_accumulate_top3(spark, d):
    per = W.tumble(events(spark, d), "ts", "1 day").groupBy("window_start", "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return A.top_n(per, ["window_start", "event_type"], [F.desc("n"), F.col("user_id")], 3)


@query("agg_count_distinct_hop", f"select s as window_start, event_type, count(distinct user_id) as users from (select *, {bucket('20 hours')} - k * interval '20 hours' as s from events, range(3) r(k)) group by 1, 2")
def agg_count_distinct_hop(spark, d):
    return W.hop(events(spark, d), "ts", "60 hours", "20 hours").groupBy("window_start", "event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_grouping_sets", f"select {DAY} as window_start, event_type, user_id % 5 as grp, cast(sum(value) as double) as total from {EV} group by grouping sets (({DAY}, event_type, user_id % 5), ({DAY}, event_type), ({DAY}, user_id % 5), ({DAY}))")
def agg_grouping_sets(spark, d):
    e = W.tumble(events(spark, d), "ts", "1 day").withColumn("grp", F.col("user_id") % 5)
    sets = [["window_start", "event_type", "grp"], ["window_start", "event_type"], ["window_start", "grp"], ["window_start"]]
    out = e.groupingSets([[F.col(c) for c in s] for s in sets], F.col("window_start"), F.col("event_type"), F.col("grp")).agg(total().alias("total"))
    return out.select("window_start", "event_type", "grp", "total")


@query("agg_cube", f"select {DAY} as window_start, event_type, user_id % 5 as grp, count(*) as n from {EV} group by {DAY}, cube (event_type, user_id % 5)")
def agg_cube(spark, d):
    e = W.tumble(events(spark, d), "ts", "1 day").withColumn("grp", F.col("user_id") % 5)
    sets = [["window_start", "event_type", "grp"], ["window_start", "event_type"], ["window_start", "grp"], ["window_start"]]
    out = e.groupingSets([[F.col(c) for c in s] for s in sets], F.col("window_start"), F.col("event_type"), F.col("grp")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("window_start", "event_type", "grp", "n")


@query("agg_udaf_count", "select event_type, count(*) as n from events group by 1")
def agg_udaf_count(spark, d):
    # counts nulls too; the built-in form has partial results, which a Python aggregate lacks (functions.register has that one)
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_first", f"select user_id, event_id, cast(value as double) as value from (select *, row_number() over (partition by user_id order by event_id) as rn from {EV} where event_type = 'purchase') where rn = 1")
def dedup_first(spark, d):
    return A.first_row(of_type(events(spark, d), "purchase").select("user_id", "event_id", F.col("value").cast("double").alias("value")), ["user_id"], "event_id")


@query("running_avg", f"select event_id, cast(sum(value) over w as double) / count(*) over w as mean from {EV} window w as (partition by user_id order by event_id rows unbounded preceding)")
def running_avg(spark, d):
    out = A.running(events(spark, d), ["user_id"], ["event_id"], {"s": (F.sum, "value"), "n": (F.count, F.lit(1))})
    return out.select("event_id", (F.col("s").cast("double") / F.col("n")).alias("mean"))


@query("every_n_sum", f"select user_id, (rn - 1) // 50 as block, cast(sum(value) as double) as total from (select *, row_number() over (partition by user_id order by event_id) as rn from {EV}) group by 1, 2 having count(*) = 50")
def every_n_sum(spark, d):
    return A.every_n_sum(events(spark, d), ["user_id"], ["event_id"], F.col("value"), 50).withColumn("total", F.col("total").cast("double"))
