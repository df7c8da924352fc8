"""Projections and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transform as T
from .base import query, t


@query("map_project", "select event_id, user_id, value * 2 as doubled from events")
def map_project(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", (F.col("value") * 2).alias("doubled"))


@query("filter_eq", "select event_id, user_id from events where event_type = 'purchase'")
def filter_eq(spark, d):
    return t(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id")


@query("flatmap_replicate", "select event_id, event_type from events, range(2) r(k) where event_type = 'purchase' or (event_type = 'view' and k = 0)")
def flatmap_replicate(spark, d):
    times = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return T.replicate(t(spark, d, "events").select("event_id", "event_type"), times)


@query("split_words", "select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by 1")
def split_words(spark, d):
    return t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("cast_project", "select cast(o_orderkey as varchar) as order_id, cast(o_totalprice as decimal(18,2))::double as price, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def cast_project(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("side_output_split", "select event_id, case when event_type = 'error' then 'errors' when value > 400 then 'large' else 'main' end as route from events")
def side_output_split(spark, d):
    outs = T.split(t(spark, d, "events"), {"errors": F.col("event_type") == "error", "large": F.col("value") > 400})
    parts = [df.select("event_id", F.lit(name).alias("route")) for name, df in outs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rename_nested_flatten", "select event_id as id, user_id as who, ts as moment, value as amount from events")
def rename_nested_flatten(spark, d):
    nested = t(spark, d, "events").select("event_id", F.struct("user_id", F.struct("ts", "value").alias("what")).alias("body"))
    return T.flatten(nested, {"id": "event_id", "who": "body.user_id", "moment": "body.what.ts", "amount": "body.what.value"})


