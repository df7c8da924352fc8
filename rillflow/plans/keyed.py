"""Changelogs, upserts, merges and snapshots over the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed as K
from .base import query, t

#: orders as a keyed table (key, cust, price, version), and a changelog of it.
BASE = "(select o_orderkey as k, o_custkey as cust, o_totalprice as price, 0 as version from orders where o_orderkey % 10 <> 3)"
CHANGES = "(select o_orderkey as k, o_custkey as cust, o_totalprice + 1 as price, 1 as version, 'u' as op from orders where o_orderkey % 10 = 1 union all select o_orderkey, o_custkey, o_totalprice + 2, 2, 'u' from orders where o_orderkey % 20 = 1 union all select o_orderkey, o_custkey, o_totalprice, 1, 'd' from orders where o_orderkey % 10 = 2 union all select o_orderkey, o_custkey, o_totalprice, 1, 'c' from orders where o_orderkey % 10 = 3)"
LOG = f"(select *, 'c' as op from {BASE} union all by name select * from {CHANGES})"


def state(upto: int) -> str:
    return f"(select k, cust, price, version from (select *, row_number() over (partition by k order by version desc) as rn from {LOG} where version <= {upto}) where rn = 1 and op <> 'd')"


def rows(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"))


def base(spark, d):
    return rows(spark, d).where("k % 10 <> 3").withColumn("version", F.lit(0))


def changes(spark, d):
    r = rows(spark, d)
    kind = lambda cond, add, version, op: r.where(cond).select("k", "cust", (F.col("price") + add).alias("price"), F.lit(version).alias("version"), F.lit(op).alias("op"))
    return kind("k % 10 = 1", 1, 1, "u").unionByName(kind("k % 20 = 1", 2, 2, "u")).unionByName(kind("k % 10 = 2", 0, 1, "d")).unionByName(kind("k % 10 = 3", 0, 1, "c"))


def log(spark, d):
    return base(spark, d).withColumn("op", F.lit("c")).unionByName(changes(spark, d))


@query("cdc_parse", f"select op, version * 1000 as ts_ms, k, cust, price from {CHANGES}")
def cdc_parse(spark, d):
    row = F.struct("k", "cust", "price")
    envelope = F.to_json(F.struct(F.when(F.col("op") != "c", row).alias("before"), F.when(F.col("op") != "d", row).alias("after"), "op", (F.col("version") * 1000).alias("ts_ms")))
    raw = changes(spark, d).select(envelope.alias("payload"))
    return K.parse_cdc(raw, "payload", "k bigint, cust bigint, price double").withColumn("ts_ms", F.col("ts_ms").cast("int"))


@query("cdc_apply", f"select * from {state(2)}")
def cdc_apply(spark, d):
    return K.apply_cdc(base(spark, d), changes(spark, d), ["k"], ["version"])


@query("upsert_precombine", f"select k, cust, price, version from (select *, row_number() over (partition by k order by version desc) as rn from (select k, cust, price, version from {BASE} union all select k, cust, price, version from {CHANGES})) where rn = 1")
def upsert_precombine(spark, d):
    return K.upsert(base(spark, d), changes(spark, d).drop("op"), ["k"], ["version"])


@query("upsert_partitioned", "select k, day, max(version) as version, arg_max(price, version) as price from (select o_orderkey as k, strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice as price, 0 as version from orders union all select o_orderkey, strftime(o_orderdate + (o_orderkey % 2)::int * interval 1 day, '%Y-%m-%d'), o_totalprice + 1, 1 from orders where o_orderkey % 5 = 0) group by 1, 2")
def upsert_partitioned(spark, d):
    o = t(spark, d, "orders")
    first = o.select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("price"), F.lit(0).alias("version"))
    moved = F.date_format(F.expr("o_orderdate + make_interval(0, 0, 0, int(o_orderkey % 2))"), "yyyy-MM-dd")
    second = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), moved.alias("day"), (F.col("o_totalprice") + 1).alias("price"), F.lit(1).alias("version"))
    return K.upsert(first, second, ["k", "day"], ["version"])


@query("merge_into", "select k, cust, case when k % 10 = 1 then price + 1 else price end as price, case when k % 10 = 1 then 1 else version end as version from (select o_orderkey as k, o_custkey as cust, o_totalprice as price, case when o_orderkey % 10 = 3 then 7 else 0 end as version from orders)")
def merge_into(spark, d):
    source = changes(spark, d).where("version = 1 and op <> 'd'").drop("op")
    c = F.col
    return K.merge_into(base(spark, d), source, ["k"], {"price": c("s_price"), "version": c("s_version")}, {"k": c("s_k"), "cust": c("s_cust"), "price": c("s_price"), "version": F.lit(7)})


@query("upsert_equality_field", "select o_custkey as cust, max(o_orderkey) as k, arg_max(o_totalprice, o_orderkey) as price from orders group by 1")
def upsert_equality_field(spark, d):
    return K.upsert_latest(rows(spark, d), ["cust"], ["k"])


@query("upsert_sink_latest", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def upsert_sink_latest(spark, d):
    from ..sources import key_value

    sent = key_value(t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], value_has_keys=False)
    back = sent.select(F.from_json("key", "user_id bigint").alias("k"), F.from_json("value", "event_type string, event_id bigint").alias("v")).select("k.*", "v.*")
    return K.upsert_latest(back, ["user_id"], ["event_id"])


@query("partial_update_merge", "select k, max(a) as a, max(b) as b from (select o_orderkey as k, o_custkey as a, null as b from orders where o_orderkey % 3 <> 0 union all select o_orderkey, null, o_totalprice from orders where o_orderkey % 3 <> 1) group by 1")
def partial_update_merge(spark, d):
    r = rows(spark, d)
    one = r.where("k % 3 <> 0").select("k", F.col("cust").alias("a"), F.lit(1).alias("version"))
    two = r.where("k % 3 <> 1").select("k", F.col("price").alias("b"), F.lit(2).alias("version"))
    return K.partial_update(one.unionByName(two, allowMissingColumns=True), ["k"], ["a", "b"], "version")


@query("merge_engine_aggregate", "select user_id, event_type, cast(sum(cast(value as decimal(18,2))) as double) as total, max(ts) as last, array_to_string(list_sort(list(distinct event_id % 4)), ',') as kinds from events group by 1, 2")
def merge_engine_aggregate(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("total"), F.col("ts").alias("last"), (F.col("event_id") % 4).alias("kinds"))
    out = K.merge_aggregate(e, ["user_id", "event_type"], ["total"], ["last"], ["kinds"])
    return out.withColumns({"total": F.col("total").cast("double"), "kinds": F.array_join("kinds", ",")})


@query("delete_where", "select o_orderkey, o_orderpriority from orders where not (o_orderkey % 4 = 0 and o_orderstatus = 'F')")
def delete_where(spark, d):
    return K.delete_where(t(spark, d, "orders"), F.expr("o_orderkey % 4 = 0 and o_orderstatus = 'F'")).select("o_orderkey", "o_orderpriority")


@query("schema_add_column", "select o_orderkey as k, o_custkey as cust, case when o_orderkey % 2 = 0 then 'even' end as note from orders")
def schema_add_column(spark, d):
    r = rows(spark, d).select("k", "cust")
    old = K.add_columns(r.where("k % 2 = 1"), {"note": "string"})
    return old.unionByName(r.where("k % 2 = 0").withColumn("note", F.lit("even")))


@query("snapshot_read", f"select * from {state(1)}")
def snapshot_read(spark, d):
    return K.snapshot(log(spark, d), ["k"], "version", 1)


@query("incremental_between", f"select k, cust, price, '+' as kind from (select k, cust, price from {state(2)} except all select k, cust, price from {state(0)}) union all select k, cust, price, '-' from (select k, cust, price from {state(0)} except all select k, cust, price from {state(2)})")
def incremental_between(spark, d):
    return K.between_snapshots(log(spark, d), ["k"], "version", 0, 2)


@query("incremental_commit", f"select k, version, op from {LOG} where version > 1")
def incremental_commit(spark, d):
    return log(spark, d).where("version > 1").select("k", "version", "op")


@query("view_ro_vs_rt", f"select 'ro' as kind, count(*) as n, cast(sum(cast(price as decimal(18,2))) as double) as total from {BASE} union all select 'rt', count(*), cast(sum(cast(price as decimal(18,2))) as double) from {state(2)}")
def view_ro_vs_rt(spark, d):
    compacted, now = base(spark, d), K.apply_cdc(base(spark, d), changes(spark, d), ["k"], ["version"])
    about = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
    return about(compacted, "ro").unionByName(about(now, "rt"))
