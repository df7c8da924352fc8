"""Top-n, first rows and row patterns over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import patterns as P
from ..operators import windows as W
from .base import EV, bucket, events, query, total
from .windows import DAY, HOP


@query("topn_window_agg", f"select * from (select window_start, window_end, user_id, total, row_number() over (partition by window_start order by total desc, user_id) as rank from (select {DAY} as window_start, {DAY} + interval '1 day' as window_end, user_id, cast(sum(value) as double) as total from {EV} group by all)) where rank <= 3")
def topn_window_agg(spark, d):
    per = W.tumble(events(spark, d), "ts", "1 day").groupBy("window_start", "window_end", "user_id").agg(total().alias("total"))
    return A.top_n(per, ["window_start", "window_end"], [F.desc("total"), F.col("user_id")], 3)


@query("topn_window_rows", f"select * from (select event_id, user_id, {DAY} as window_start, cast(value as double) as value, row_number() over (partition by {DAY} order by value desc, event_id) as rank from {EV}) where rank <= 3")
def topn_window_rows(spark, d):
    rows = W.tumble(events(spark, d), "ts", "1 day").select("event_id", "user_id", "window_start", F.col("value").cast("double").alias("value"))
    return A.top_n(rows, ["window_start"], [F.desc("value"), F.col("event_id")], 3)


HOT = f"select * from (select window_end, user_id, n, row_number() over (partition by window_end order by n desc, user_id) as rank from (select window_end, user_id, count(*) as n from ({HOP}) group by all)) where rank <= 3"


def _hot(spark, d, types):
    rows = events(spark, d).where(F.col("event_type").isin(*types)) if types else events(spark, d)
    per = W.hop(rows, "ts", "1 hour", "15 minutes").groupBy("window_end", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return A.top_n(per, ["window_end"], [F.desc("n"), F.col("user_id")], 3)


@query("topn_hot_items", HOT)
def topn_hot_items(spark, d):
    return _hot(spark, d, None)


@query("topn_hot_items_timer", HOT.replace(f"from {EV} e", f"from (select * from {EV} where event_type = 'view') e"))
def topn_hot_items_timer(spark, d):
    return _hot(spark, d, ["view"])


@query("first_row_per_key", "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1")
def first_row_per_key(spark, d):
    return A.first_row(events(spark, d).select("user_id", "event_id", "ts"), ["user_id"], "event_id")


@query("match_v_shape", f"""with r as (select user_id, ts, value, lag(value) over w as p, lag(ts) over w as pt, lead(value) over w as nx, lead(ts) over w as nt from {EV} window w as (partition by user_id order by ts)),
    g as (select *, sum(case when value < p then 0 else 1 end) over (partition by user_id order by ts) as run from r)
    select user_id, min(pt) as start_ts, max(ts) as bottom_ts, arg_max(nt, ts) as end_ts from g where value < p group by user_id, run having count(*) >= 2 and arg_max(nx, ts) > arg_max(p, ts)""")
def match_v_shape(spark, d):
    return P.v_shape(events(spark, d), ["user_id"], "ts", "value")


@query("match_within", """select a.user_id, a.ts as start_ts, max(b.ts) as end_ts, count(*) as n from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts < a.ts + interval '10 hours'
    where not exists (select 1 from events c where c.user_id = a.user_id and c.event_type = a.event_type and c.ts > a.ts and c.ts <= b.ts) group by 1, 2""")
def match_within(spark, d):
    return P.followed_elsewhere(events(spark, d), ["user_id"], "ts", "event_type", "10 hours")


@query("cep_three_next", "select user_id, t1, t2, t3 from (select user_id, event_type, ts as t1, lead(ts) over w as t2, lead(ts, 2) over w as t3, lead(event_type) over w as e2, lead(event_type, 2) over w as e3 from events window w as (partition by user_id order by ts)) where event_type = 'error' and e2 = 'error' and e3 = 'error'")
def cep_three_next(spark, d):
    return P.consecutive(events(spark, d), ["user_id"], ["ts"], "ts", F.col("event_type") == "error")


@query("cep_times_three", "select * from (select user_id, ts as t1, lead(ts) over w as t2, lead(ts, 2) over w as t3 from events where event_type = 'error' window w as (partition by user_id order by ts)) where t3 is not null")
def cep_times_three(spark, d):
    return P.relaxed_times(events(spark, d), ["user_id"], ["ts"], "ts", F.col("event_type") == "error")


@query("rising_run_alert", f"""with recursive r as (select user_id, ts, coalesce(value > lag(value) over w, row_number() over w = 1) as up, lead(ts) over w as nt from {EV} window w as (partition by user_id order by ts)),
    g as (select *, sum(case when up then 0 else 1 end) over (partition by user_id order by ts) as run from r),
    u as (select user_id, run, ts, max(coalesce(nt, ts)) over (partition by user_id, run) as b from g where up),
    nxt as (select a.user_id, a.run, a.ts, any_value(a.b) as b, min(c.ts) as nt from u a left join u c on c.user_id = a.user_id and c.run = a.run and c.ts >= a.ts + interval '4 hours' group by 1, 2, 3),
    chain as (select user_id, run, min(ts) as armed, any_value(b) as b from nxt group by 1, 2 union all select n.user_id, n.run, n.nt, n.b from chain c join nxt n on n.user_id = c.user_id and n.run = c.run and n.ts = c.armed where n.nt is not null)
    select user_id, armed + interval '4 hours' as alert_ts from chain where armed + interval '4 hours' <= b""")
def rising_run_alert(spark, d):
    return P.rising_alerts(events(spark, d), ["user_id"], "ts", "value", 4 * 3600)
