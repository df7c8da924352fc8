"""Lateness in a fixed arrival order of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lateness as L
from ..streaming import marked
from .base import bucket, events, query

ARRIVAL = "(event_id + event_id * 37 % 11) * 16 + event_id % 16"
HOUR = bucket("1 hour")
SEEN = f"(select *, {HOUR} as window_start, {HOUR} + interval '1 hour' as window_end, max(ts) over (order by arrival rows between unbounded preceding and 1 preceding) - interval '10 minutes' as wm from (select *, {ARRIVAL} as arrival from events))"


def arriving(spark, d):
    return events(spark, d).withColumn("arrival", F.expr(ARRIVAL))


@query("late_flag", f"select event_id, coalesce(ts < wm - interval '1 millisecond', false) as late from {SEEN}")
def late_flag(spark, d):
    return L.flag_late(arriving(spark, d), "ts", "arrival", "10 minutes").select("event_id", "late")


@query("late_drop", f"select window_start, count(*) as n from {SEEN} where not coalesce(wm >= window_end, false) group by 1")
def late_drop(spark, d):
    return L.drop_late(arriving(spark, d), "ts", "arrival", "1 hour", "10 minutes").groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


@query("late_side_output", f"select event_id, coalesce(wm >= window_end + interval '20 minutes', false) as side from {SEEN}")
def late_side_output(spark, d):
    return L.split_late(arriving(spark, d), "ts", "arrival", "1 hour", "10 minutes", "20 minutes").select("event_id", "side")


@query("late_allowed_refire", f"""with a as (select *, coalesce(wm >= window_end, false) as again from {SEEN} where not coalesce(wm >= window_end + interval '20 minutes', false)),
    b as (select *, row_number() over w as n, sum(again::int) over w as later, max((not again)::int) over (partition by event_type, window_start) as had from a window w as (partition by event_type, window_start order by arrival)),
    top as (select max(ts) - interval '10 minutes' as reached from events)
    select event_type, window_start, 1 as fire_no, count(*) as n from b, top where not again and window_end <= reached group by 1, 2
    union all select event_type, window_start, later + had, n from b where again""")
def late_allowed_refire(spark, d):
    return L.refire(arriving(spark, d), ["event_type"], "ts", "arrival", "1 hour", "10 minutes", "20 minutes").select("event_type", "window_start", "fire_no", "n")


RELEASED = """with a as (select *, {arrival} as arrival, {mark} as own from events),
    m as (select *, max(own) over (partition by user_id order by arrival) as wm from a),
    l as (select *, coalesce(ts <= wm, false) as late from m)
    select l.event_id, l.late, min(b.arrival) as released_by from l left join a b on b.user_id = l.user_id and b.arrival > l.arrival and b.own >= l.ts and not l.late group by 1, 2"""


def _released(spark, d, mark):
    return L.released(arriving(spark, d), ["user_id"], "ts", "arrival", mark).select("event_id", "late", "released_by")


@query("late_punctuated", RELEASED.format(arrival=ARRIVAL, mark="case when event_type = 'purchase' then ts - interval '1 millisecond' end"))
def late_punctuated(spark, d):
    return _released(spark, d, marked.marked_by(F.col("event_type") == "purchase", "ts"))


@query("late_trailing", RELEASED.format(arrival=ARRIVAL, mark="ts - interval '5 hours' - interval '1 millisecond'"))
def late_trailing(spark, d):
    return _released(spark, d, marked.trailing("ts", "5 hours"))
