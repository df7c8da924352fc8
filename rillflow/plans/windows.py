"""Time and count windows over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .base import EV, bucket, events, query, total

DAY, HOUR, QUARTER = bucket("1 day"), bucket("1 hour"), bucket("15 minutes")
HOP = f"select *, s as window_start, s + interval '1 hour' as window_end from (select *, {QUARTER} - k * interval '15 minutes' as s from {EV} e, range(4) r(k)) where s > ts - interval '1 hour'"
CUM = f"select *, {DAY} as window_start, {DAY} + (k + 1) * interval '4 hours' as window_end from {EV} e, range(6) r(k) where {DAY} + (k + 1) * interval '4 hours' > ts"
CHAIN = """recursive nxt as (select a.event_type, a.ts, min(b.ts) as nt from (select {key} as event_type, ts from events) a asof left join (select {key} as event_type, ts from events) b on a.event_type = b.event_type and b.ts >= a.ts + interval '6 hours' group by 1, 2),
    chain as (select event_type, min(ts) as armed from nxt group by 1 union all select n.event_type, n.nt from chain c join nxt n on n.event_type = c.event_type and n.ts = c.armed where n.nt is not null)"""


@query("tvf_tumble", f"select event_id, {DAY} as window_start, {DAY} + interval '1 day' as window_end, {DAY} + interval '1 day' - interval '1 millisecond' as window_time from events")
def tvf_tumble(spark, d):
    return W.tumble(events(spark, d), "ts", "1 day").select("event_id", "window_start", "window_end", "window_time")


@query("tvf_hop", f"select event_id, window_start, window_end, window_end - interval '1 millisecond' as window_time from ({HOP})")
def tvf_hop(spark, d):
    return W.hop(events(spark, d), "ts", "1 hour", "15 minutes").select("event_id", "window_start", "window_end", "window_time")


@query("tvf_cumulate", f"select event_id, window_start, window_end, window_end - interval '1 millisecond' as window_time from ({CUM})")
def tvf_cumulate(spark, d):
    return W.cumulate(events(spark, d), "ts", "1 day", "4 hours").select("event_id", "window_start", "window_end", "window_time")


@query("win_tumble_sum", f"select {DAY} as window_start, {DAY} + interval '1 day' as window_end, cast(sum(value) as double) as total from {EV} group by 1, 2")
def win_tumble_sum(spark, d):
    return W.tumble(events(spark, d), "ts", "1 day").groupBy("window_start", "window_end").agg(total().alias("total"))


@query("win_hop_sum", f"select window_start, window_end, cast(sum(value) as double) as total from ({HOP}) group by 1, 2")
def win_hop_sum(spark, d):
    return W.hop(events(spark, d), "ts", "1 hour", "15 minutes").groupBy("window_start", "window_end").agg(total().alias("total"))


@query("win_cumulate_sum", f"select event_type, window_start, window_end, cast(sum(value) as double) as total, count(*) as n from ({CUM}) group by 1, 2, 3")
def win_cumulate_sum(spark, d):
    out = W.cumulate_agg(events(spark, d), ["event_type"], "ts", "1 day", "4 hours", {"total": F.col("value")}, "n")
    return out.withColumn("total", F.col("total").cast("double"))


@query("win_cascade", f"select {bucket('1 day', 'w')} as window_start, cast(sum(total) as double) as total, count(*) as n from (select user_id, {HOUR} as w, sum(value) as total from {EV} group by 1, 2) group by 1")
def win_cascade(spark, d):
    first = events(spark, d).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.sum("value").alias("total"))
    second = first.withColumn("rowtime", F.expr("w.end - interval '0.001' second")).groupBy(F.window("rowtime", "1 day").alias("w"))
    return second.agg(total("total").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "total", "n")


@query("win_tumble_count", f"select user_id, {HOUR} as window_start, {HOUR} + interval '1 hour' as window_end, count(*) as n from events group by all")
def win_tumble_count(spark, d):
    return W.tumble(events(spark, d), "ts", "1 hour").groupBy("user_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))


@query("win_slide_count", f"select event_type, s as window_start, s + interval '5 hours' as window_end, count(*) as n from (select *, {bucket('2 hours')} - k * interval '2 hours' as s from events, range(3) r(k)) where s > ts - interval '5 hours' group by all")
def win_slide_count(spark, d):
    return W.hop(events(spark, d), "ts", "5 hours", "2 hours").groupBy("event_type", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))


@query("win_session_count", "select user_id, min(ts) as window_start, max(ts) + interval '6 hours' as window_end, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '6 hours' then 0 else 1 end as new from events)) group by user_id, s")
def win_session_count(spark, d):
    return W.session(events(spark, d), ["user_id"], "ts", "6 hours", F.count(F.lit(1)).alias("n")).select("user_id", "window_start", "window_end", "n")


@query("win_count_tumble", f"select user_id, (rn - 1) // 50 as window_no, cast(sum(value) as double) as total from (select *, row_number() over (partition by user_id order by event_id) as rn from {EV}) group by 1, 2 having count(*) = 50")
def win_count_tumble(spark, d):
    return W.count_tumble(events(spark, d), ["user_id"], ["event_id"], 50, total().alias("total"))


def _slide_sql(size: int, slide: int) -> str:
    return f"select user_id, rn, cast(total as double) as total from (select user_id, row_number() over (partition by user_id order by event_id) as rn, sum(value) over (partition by user_id order by event_id rows {size - 1} preceding) as total from {EV}) where rn % {slide} = 0"


def _slide(spark, d, size, slide):
    out = W.count_slide(events(spark, d), ["user_id"], ["event_id"], size, slide, {"total": (F.sum, "value")})
    return out.withColumns({"rn": F.col("rn").cast("long"), "total": F.col("total").cast("double")})


@query("win_count_slide", _slide_sql(10, 5))
def win_count_slide(spark, d):
    return _slide(spark, d, 10, 5)


@query("win_list_state_slide", _slide_sql(50, 20))
def win_list_state_slide(spark, d):
    return _slide(spark, d, 50, 20)


@query("win_trigger_early_count", "select user_id, (rn - 1) // 50 as window_no, (rn - 1) % 50 + 1 as n from (select user_id, row_number() over (partition by user_id order by event_id) as rn from events) where ((rn - 1) % 50 + 1) % 20 = 0 or rn % 50 = 0")
def win_trigger_early_count(spark, d):
    return W.early_count_trigger(events(spark, d), ["user_id"], ["event_id"], 50, 20)


@query("win_trigger_periodic", f"select event_type, window_start, window_end as fired_at, count(*) as n from ({CUM}) group by 1, 2, 3")
def win_trigger_periodic(spark, d):
    return W.periodic_trigger(events(spark, d), ["event_type"], "ts", "1 day", "4 hours")


@query("win_global_timer", f"with {CHAIN.format(key='user_id')} select c.event_type as user_id, c.armed + interval '6 hours' as fired, count(*) as n from chain c join events e on e.user_id = c.event_type and e.ts < c.armed + interval '6 hours' group by 1, 2")
def win_global_timer(spark, d):
    return W.timer_chain(events(spark, d), ["user_id"], "ts", 6 * 3600).select("user_id", "fired", "n")


EVICTED = """with e as (select user_id, event_id, ts, min(ts) over (partition by user_id) as first, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    t as (select user_id, first + interval '1 day' + k * (interval '1 day' + interval '1 millisecond') as fired from (select distinct user_id, first from e), range(400) r(k)),
    n as (select t.user_id, t.fired, count(*) as upto from t join e on e.user_id = t.user_id and e.ts < t.fired where t.fired <= (select max(ts) from events) group by 1, 2)
    select {} from n join e on e.user_id = n.user_id and e.rn <= n.upto and e.rn > n.upto - 20"""


@query("win_evictor_last_n", EVICTED.format("n.user_id, n.fired, e.event_id"))
def win_evictor_last_n(spark, d):
    return W.last_rows_ticks(events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 24 * 3600, 20).select("user_id", "fired", "event_id")


@query("win_evictor_ranges", EVICTED.format("n.user_id, e.event_id, min(n.fired) as first_fired, max(n.fired) as last_fired, count(*) as fires") + " group by 1, 2")
def win_evictor_ranges(spark, d):
    return W.last_rows_ranges(events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 24 * 3600, 20).select("user_id", "event_id", "first_fired", "last_fired", "fires")


@query("value_state_timer", f"""with {CHAIN.format(key='user_id')},
    l as (select user_id, ts, event_id, case when ts - lag(ts) over w >= interval '12 hours' then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    c as (select *, sum(new) over (partition by user_id order by ts, event_id) as life from l)
    select h.event_type as user_id, h.armed, h.armed + interval '6 hours' as fired, count(*) filter (where c.life = m.life) as pv from chain h join c on c.user_id = h.event_type and c.ts < h.armed + interval '6 hours'
      join (select h.event_type as u, h.armed as a, max(c.life) as life from chain h join c on c.user_id = h.event_type and c.ts < h.armed + interval '6 hours' group by 1, 2) m on m.u = h.event_type and m.a = h.armed group by 1, 2, 3""")
def value_state_timer(spark, d):
    from ..operators.joins import asof_join

    e = events(spark, d).select("user_id", "ts", "event_id")
    ticks = W.timer_chain(e, ["user_id"], "ts", 6 * 3600).select("user_id", "armed", "fired", F.expr("fired - interval '0.000001' second").alias("before"))
    counts = W.counted_with_ttl(e, ["user_id"], "ts", "event_id", 12 * 3600, "pv").select("user_id", "ts", "pv")
    last = counts.groupBy("user_id", "ts").agg(F.max("pv").alias("pv"))
    return asof_join(ticks, last, ["user_id"], "before", "ts", ["pv"]).select("user_id", "armed", "fired", "pv")


@query("pv_by_user_url", f"with {CHAIN.format(key='user_id')} select c.event_type as user_id, c.armed + interval '6 hours' as fired, e.event_type as page, count(*) as pv from chain c join events e on e.user_id = c.event_type and e.ts < c.armed + interval '6 hours' group by 1, 2, 3")
def pv_by_user_url(spark, d):
    from pyspark.sql import Window

    from ..operators.joins import asof_join

    e = events(spark, d).select("user_id", "ts", F.col("event_type").alias("page"))
    place = Window.partitionBy("user_id").orderBy("armed")
    ticks = W.timer_chain(e, ["user_id"], "ts", 6 * 3600).withColumn("tick", F.row_number().over(place))
    per = asof_join(e, ticks, ["user_id"], "ts", "armed", ["tick"]).groupBy("user_id", "page", "tick").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("user_id", "page").orderBy("tick")
    run = per.select("user_id", "page", "tick", F.sum("c").over(w).alias("pv"), F.lead("tick").over(w).alias("nxt"))
    ends = ticks.groupBy("user_id").agg(F.max("tick").alias("last"))
    run = run.join(ends, "user_id").withColumn("tick", F.explode(F.sequence("tick", F.coalesce(F.col("nxt") - 1, F.col("last")))))
    return run.join(ticks.select("user_id", "tick", "fired"), ["user_id", "tick"]).select("user_id", "fired", "page", "pv")
