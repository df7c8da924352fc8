"""Scalar functions, UDFs and unnesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import aggregates as A
from .base import query, t


def customer(spark, d):
    return t(spark, d, "customer")


@query("fn_string_1", "select c_custkey, length(c_name) as len, chr((65 + c_custkey % 26)::int) as letter, c_name || '-' || c_mktsegment as joined, concat_ws('|', c_name, case when c_custkey % 2 = 0 then c_mktsegment end) as piped, lower(c_name) as low, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as cap, reverse(c_name) as back from customer")
def fn_string_1(spark, d):
    c = F.col
    return customer(spark, d).select("c_custkey", F.char_length("c_name").cast("long").alias("len"), F.char((65 + c("c_custkey") % 26)).alias("letter"), F.concat("c_name", F.lit("-"), "c_mktsegment").alias("joined"), F.concat_ws("|", "c_name", F.when(c("c_custkey") % 2 == 0, c("c_mktsegment"))).alias("piped"), F.lower("c_name").alias("low"), F.initcap("c_mktsegment").alias("cap"), F.reverse("c_name").alias("back"))


@query("fn_string_2", "select c_custkey, replace(c_name, '#', '_') as swapped, repeat(c_mktsegment, 2) as twice, rpad(c_mktsegment, 12, '*') as r, lpad(c_mktsegment, 12, '*') as l, left(c_name, 2) || 'XX' || substr(c_name, 5) as laid, position('#' in c_name) as at, case when length(c_name) - length(replace(c_name, '0', '')) >= 2 then instr(c_name, '0') + instr(substr(c_name, instr(c_name, '0') + 1), '0') else 0 end as second from customer")
def fn_string_2(spark, d):
    return customer(spark, d).select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("_")).alias("swapped"), F.repeat("c_mktsegment", 2).alias("twice"), F.rpad("c_mktsegment", 12, "*").alias("r"), F.lpad("c_mktsegment", 12, "*").alias("l"), F.overlay("c_name", F.lit("XX"), 3, 2).alias("laid"), F.locate("#", "c_name").cast("long").alias("at"), X.instr_nth("c_name", "0", 1, 2).cast("long").alias("second"))


@query("fn_regexp", "select c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) as number from customer")
def fn_regexp(spark, d):
    return customer(spark, d).select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)", 1).alias("number"))


@query("fn_hash_codec", "select c_custkey, md5(c_name) as digest, c_name as again from customer")
def fn_hash_codec(spark, d):
    return customer(spark, d).select("c_custkey", F.md5("c_name").alias("digest"), F.unbase64(F.base64("c_name")).cast("string").alias("again"))


@query("fn_if", "select o_orderkey, case when o_totalprice > 100000 then 1 else 0 end as big from orders")
def fn_if(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.expr("if(o_totalprice > 100000, 1, 0)").alias("big"))


@query("fn_map", "select c_custkey, cast(c_custkey as varchar) as k, c_mktsegment as s from customer")
def fn_map(spark, d):
    m = F.str_to_map(F.concat(F.lit("k="), "c_custkey", F.lit(",s="), "c_mktsegment"), F.lit(","), F.lit("="))
    return customer(spark, d).select("c_custkey", m["k"].alias("k"), m["s"].alias("s"))


@query("fn_date", "select o_orderkey, strftime(o_orderdate + interval 5 day, '%Y-%m-%d') as later, strftime(o_orderdate - interval 5 day, '%Y-%m-%d') as sooner, date_diff('day', date '1992-01-01', o_orderdate::date) as days, strftime(o_orderdate, '%Y/%m/%d') as shown, epoch(o_orderdate)::bigint as seconds, strftime(date '1970-01-01' + (o_orderkey % 1000)::int, '%Y-%m-%d') as day from orders")
def fn_date(spark, d):
    when = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.date_add(when, 5).cast("string").alias("later"), F.date_sub(when, 5).cast("string").alias("sooner"), F.datediff(when, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_format(when, "yyyy/MM/dd").alias("shown"), F.unix_timestamp(when.cast("timestamp")).alias("seconds"), F.date_from_unix_date((F.col("o_orderkey") % 1000).cast("int")).cast("string").alias("day"))


@query("fn_time_build", "select event_id, date_trunc('second', ts) as sec, strftime(ts, '%H') as hh, strftime(ts, '%M') as mm, substr(event_type, 1, 3) as head from events")
def fn_time_build(spark, d):
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").select("event_id", F.timestamp_seconds(s).cast("timestamp_ntz").alias("sec"), F.date_format("ts", "HH").alias("hh"), F.date_format("ts", "mm").alias("mm"), F.substring("event_type", 0, 3).alias("head"))


@query("udf_substring", "select c_custkey, substr(c_name, 3, 6) as part from customer")
def udf_substring(spark, d):
    return customer(spark, d).select("c_custkey", X.substring_range(F.col("c_name"), 2, 8).alias("part"))


@query("udf_strlen", "select c_custkey, coalesce(length(case when c_custkey % 3 > 0 then c_name end), 0) as one, coalesce(length(case when c_custkey % 3 > 0 then c_name end), 0) + length(c_mktsegment) as two from customer")
def udf_strlen(spark, d):
    name = F.when(F.col("c_custkey") % 3 > 0, F.col("c_name"))
    return customer(spark, d).select("c_custkey", X.total_length(name).cast("long").alias("one"), X.total_length(name, F.col("c_mktsegment")).cast("long").alias("two"))


@query("udtf_split", "select c_custkey, unnest(string_split(c_name, '#')) as info from customer")
def udtf_split(spark, d):
    return customer(spark, d).select("c_custkey", F.explode(F.split("c_name", "#")).alias("info"))


@query("udtf_split_pipe", "select c_custkey, unnest(string_split(c_name || '|' || c_mktsegment, '|')) as info from customer")
def udtf_split_pipe(spark, d):
    return customer(spark, d).select("c_custkey", F.explode(F.split(F.concat("c_name", F.lit("|"), "c_mktsegment"), r"\|")).alias("info"))


@query("unnest_array", "select doc_id, word, count(*) as n from (select doc_id, unnest(string_split(text, ' ')) as word from documents) group by 1, 2")
def unnest_array(spark, d):
    return A.element_counts(t(spark, d, "documents"), ["doc_id"], F.split("text", " "), "word")


@query("unnest_map", "select c_custkey, 'name' as k, c_name as v from customer union all select c_custkey, 'segment', c_mktsegment from customer")
def unnest_map(spark, d):
    return customer(spark, d).select("c_custkey", F.explode(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")).alias("k", "v"))


def _lines(spark, d):
    lines = t(spark, d, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    return t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "lines")


@query("unnest_array_of_rows", "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 40")
def unnest_array_of_rows(spark, d):
    return _lines(spark, d).select("o_orderkey", F.inline("lines"))


@query("unnest_left_outer", "select o_orderkey, l_linenumber, l_partkey from orders left join (select * from lineitem where l_quantity > 40) on o_orderkey = l_orderkey")
def unnest_left_outer(spark, d):
    return _lines(spark, d).select("o_orderkey", F.inline_outer("lines"))
