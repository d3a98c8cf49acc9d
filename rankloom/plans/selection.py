"""Quotas, shortlists and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key, normalize_title
from ..operators import selection as S
from ..operators.ordering import global_rank
from .base import query, table


@query("""
    with p as (select o_orderkey, o_orderstatus, o_totalprice, o_orderstatus = 'O' as pool from orders),
    i as (select * from p where pool order by o_totalprice desc, o_orderkey limit 150),
    o as (select * from p where not pool order by o_totalprice desc, o_orderkey limit (1000 - (select count(*) from i)))
    select o_orderkey, o_orderstatus from (from i union all from o)
""")
def precap_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return S.pool_precap(rows, F.col("o_orderstatus") == "O", [F.desc("o_totalprice"), "o_orderkey"], 1000, 0.15).select("o_orderkey", "o_orderstatus")


@query("""
    with b as (select o_orderkey, o_custkey % 10 as topic, o_totalprice, case when year(o_orderdate) <= 1996 then 'classic' when year(o_orderdate) >= 2000 then 'recent' else 'mid' end as bucket from orders),
    r as (select *, row_number() over (partition by topic, bucket order by o_totalprice desc, o_orderkey) as k from b),
    s as (select *, case when bucket = 'classic' and k <= 8 then 1 when bucket = 'recent' and k <= 6 then 2 when bucket = 'mid' and k <= 6 then 3 else 4 end as segment from r)
    select topic, o_orderkey, bucket, row_number() over (partition by topic order by segment, o_totalprice desc, o_orderkey) as position from s qualify position <= 24
""")
def year_bucket_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    bucket = F.when(year <= 1996, "classic").when(year >= 2000, "recent").otherwise("mid")
    rows = table(spark, sf_dir, "orders").withColumn("topic", F.col("o_custkey") % 10)
    picked = S.quotas_then_fill(rows, ["topic"], bucket, {"classic": 8, "recent": 6, "mid": 6}, [F.desc("o_totalprice"), "o_orderkey"], 24)
    return picked.select("topic", "o_orderkey", "bucket", "position")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) = 1")
def per_doc_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_per(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"])


@query("""
    with x as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem),
    h as (select * from x order by l_extendedprice desc, l_orderkey, l_linenumber limit 60),
    b as (select * from x qualify row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) = 1)
    select l_orderkey, l_linenumber, l_suppkey, false as injected from h union all select l_orderkey, l_linenumber, l_suppkey, true from b where l_suppkey not in (select l_suppkey from h)
""")
def uncovered_doc_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return S.uncovered_injection(rows, "l_suppkey", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 60).drop("l_extendedprice")


@query("""
    with p as (select l_orderkey, l_linenumber, l_discount * 10 as score, row_number() over (partition by l_orderkey order by l_discount * 10 desc, l_linenumber) as pass from lineitem)
    select l_orderkey, l_linenumber, pass from p where pass <= 3 and (pass = 1 or score >= 0.5) order by pass, score desc, l_orderkey * 10 + l_linenumber limit 60
""")
def judge_candidate_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return S.passes(rows, "l_orderkey", "score", "tie", 3, 0.5, 60).select("l_orderkey", "l_linenumber", "pass")


@query("""
    select p_brand, p_partkey, p_name from (select *, trim(regexp_replace(lower(p_name), '[^\\pL\\pN]+', ' ', 'g')) as t from part) where t not in ('', 'part 1', 'part 2')
    qualify row_number() over (partition by p_brand, t order by p_retailprice desc, p_partkey) = 1
""")
def title_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = normalize_title(F.col("p_name"))
    kept = S.distinct_titles(table(spark, sf_dir, "part"), ["p_brand"], title, title.isin("", "part 1", "part 2"), [F.desc("p_retailprice"), "p_partkey"])
    return kept.select("p_brand", "p_partkey", "p_name")


@query("""
    with g as (select o_orderkey, o_custkey % 5 as lane, o_orderstatus as pool, o_totalprice from orders where o_totalprice > 100000)
    select lane, pool, o_orderkey, row_number() over (partition by lane, pool order by o_totalprice desc, o_orderkey) as rank from g qualify rank <= case when pool = 'O' then 90 else 600 end
""")
def lane_pool_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_orderkey", (F.col("o_custkey") % 5).alias("lane"), F.col("o_orderstatus").alias("pool"), "o_totalprice")
    keep = F.when(F.col("pool") == "O", max(1, int(600 * 0.15))).otherwise(600)
    return S.quota_per(gated, ["lane", "pool"], [F.desc("o_totalprice"), "o_orderkey"], keep).select("lane", "pool", "o_orderkey", "rank")


@query("select o_orderkey, greatest(o_totalprice, o_custkey * 100.0) as score from orders order by score desc, o_orderkey limit 400")
def stage_two_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.greatest("o_totalprice", F.col("o_custkey") * 100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(400)


@query("""
    with n as (select l_returnflag as provider, l_suppkey as query, count_if(l_quantity > 49) as records from lineitem group by all),
    r as (select *, row_number() over (partition by provider order by records desc, query) as best, row_number() over (partition by provider order by records, query) as worst, count_if(records = 0) over (partition by provider) as zeros from n)
    select provider, query, records, case when best <= 10 then 'top' else 'bottom' end as side, zeros > 200 as truncated from r where best <= 10 or worst <= 10
""")
def top_bottom_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider"), F.col("l_suppkey").alias("query")).agg(F.count_if(F.col("l_quantity") > 49).alias("records"))
    w = Window.partitionBy("provider")
    placed = n.withColumn("best", F.row_number().over(w.orderBy(F.desc("records"), "query"))).withColumn("worst", F.row_number().over(w.orderBy("records", "query"))).withColumn("zeros", F.count_if(F.col("records") == 0).over(w))
    return placed.filter("best <= 10 or worst <= 10").select("provider", "query", "records", F.when(F.col("best") <= 10, "top").otherwise("bottom").alias("side"), (F.col("zeros") > 200).alias("truncated"))


@query("""
    with k as (select c_custkey, (c_custkey % 12 + 1) || '.' || (c_custkey % 25) as number from customer)
    select c_custkey, number, row_number() over (order by list_transform(string_split(number, '.'), lambda p: p::int), c_custkey) as position from k
""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(".", (F.col("c_custkey") % 12 + 1).cast("string"), (F.col("c_custkey") % 25).cast("string")).alias("number"))
    return global_rank(k.withColumn("key", natural_key(F.col("number"))), ["key", "c_custkey"]).drop("key")


@query("""
    with e as (select event_id, user_id, ts, value < 2 as expired from events)
    select event_id, user_id from (select *, row_number() over (partition by user_id, expired order by ts desc, event_id desc) as k from e) where (expired or k > 5) and event_id % 50 <> 0
""")
def retention_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return S.retention(events, "user_id", "ts", "event_id", 5, F.col("value") < 2, F.col("event_id") % 50 == 0).select("event_id", "user_id")


@query("select l_orderkey, l_linenumber, round(abs(l_discount - 0.05), 6) as distance from lineitem order by distance, l_orderkey, l_linenumber limit 10")
def near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("l_discount") - 0.05), 6).alias("distance"))
    return rows.orderBy("distance", "l_orderkey", "l_linenumber").limit(10)


@query("""
    with s as (select s_suppkey, case s_nationkey % 4 when 0 then 'blue' when 1 then 'red' when 2 then 'green' end as color, case when s_acctbal > 0 then s_acctbal end as score from supplier)
    select s_suppkey, row_number() over (order by list_position(['green', 'red', 'blue'], color) nulls last, score desc nulls last, s_suppkey) as position from s
""")
def custom_category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey") % 4
    color = F.when(k == 0, "blue").when(k == 1, "red").when(k == 2, "green")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", color.alias("color"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score"))
    place = F.array_position(F.array(*map(F.lit, ("green", "red", "blue"))), F.col("color"))
    placed = global_rank(rows.withColumn("place", place), [F.col("place").asc_nulls_last(), F.col("score").desc_nulls_last(), F.col("s_suppkey")])
    return placed.select("s_suppkey", "position")


@query("with n as (select conv_id, count(*) as n from conversations group by 1) select conv_id, n, list_transform(range(0, cast(ceil(n / 5.0) as bigint)), lambda g: n // cast(ceil(n / 5.0) as bigint) + (g < n % cast(ceil(n / 5.0) as bigint))::bigint) as sizes from n")
def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    groups = F.expr("cast(ceil(n / 5) as bigint)")
    return counts.withColumn("g", groups).select("conv_id", "n", F.expr("transform(sequence(0L, g - 1), i -> n div g + if(i < n % g, 1L, 0L))").alias("sizes"))
