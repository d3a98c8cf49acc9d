"""Views for dashboards and administration: filters, leaderboards, series, ranges of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection as S
from .base import query, table


def matches(words: str, *columns: Column) -> Column:
    """Whether any column holds the words in any case; no words match everything."""
    if not words:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(T.or_empty(c)), F.lit(words.lower()))
    return found


@query("select c_custkey, c_name from customer where (contains(lower(c_name), '00012') or contains(lower(c_mktsegment), 'auto')) and c_acctbal > 0 and list_contains([c_nationkey, c_custkey % 7], 3)")
def filtered_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer")
    kept = (matches("00012", F.col("c_name")) | matches("AUTO", F.col("c_mktsegment"))) & (F.col("c_acctbal") > 0) & F.array_contains(F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 7), F.lit(3).cast("long"))
    return users.filter(kept).select("c_custkey", "c_name")


@query("select s_suppkey, score from (select s_suppkey, case when s_acctbal > 0 then s_acctbal end as score, s_nationkey % 2 as pool from supplier) where pool = 1 order by score desc nulls last, s_suppkey limit 20")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").filter("s_nationkey % 2 = 1").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score"))
    return rows.orderBy(F.desc_nulls_last("score"), "s_suppkey").limit(20)


@query("""
    with series as (select l_returnflag as lane, l_orderkey, max(l_extendedprice) as score, row_number() over (partition by l_returnflag order by max(l_extendedprice) desc, l_orderkey) as rank from lineitem group by 1, 2)
    select i as rank, max(score) filter (lane = 'A') as a, max(score) filter (lane = 'N') as n, max(score) filter (lane = 'R') as r from range(1, 201) t(i) left join series on rank = i group by i
""")
def rank_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("lane"), "l_orderkey").agg(F.max("l_extendedprice").alias("score"))
    top = S.quota_per(best, ["lane"], [F.desc("score"), "l_orderkey"], 200)
    wide = top.groupBy("rank").pivot("lane", ["A", "N", "R"]).agg(F.max("score"))
    axis = spark.range(1, 201).select(F.col("id").alias("rank"))
    return F.broadcast(axis).join(wide, "rank", "left").select("rank", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("select event_type as stage, count(*) as n, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) as elapsed, strftime(max(ts), '%Y-%m-%d %H') as last_hour from events group by 1")
def stage_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(seconds, 3).alias("elapsed"), F.date_format(F.max("ts"), "yyyy-MM-dd HH").alias("last_hour"))


@query("""
    with b as (select min(ts)::date as lo, max(ts)::date as hi from events), k as (select strftime(unnest(generate_series(hi - least(date_diff('day', lo, hi), 119)::int, hi, interval 1 day)), '%Y-%m-%d') as day from b),
    t as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as users from events group by 1)
    select k.day, coalesce(n, 0) as n, coalesce(users, 0) as users from k left join t using (day)
""")
def daily_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense axis of days, the last 120 at most."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    axis = ends.select(F.explode(F.sequence(F.greatest("lo", F.date_sub("hi", 119)), F.col("hi"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    totals = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return F.broadcast(axis).join(totals, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"))


@query("""
    with p as (select l_orderkey as page, l_quantity * 10 as x0, l_quantity * 10 + l_extendedprice / 1000 as x1 from lineitem)
    select page, count(*) as n, max(gap) >= 0.04 * 600 as multi_column from (select page, coalesce(x0 - max(x1) over (partition by page order by x0, x1 rows between unbounded preceding and 1 preceding), 0) as gap from p) group by page
""")
def multi_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose blocks leave a gap of 4 % of the width between what ends before and what begins."""
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + F.col("l_extendedprice") / 1000).alias("x1"))
    reach = F.max("x1").over(Window.partitionBy("page").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("gap", F.coalesce(F.col("x0") - reach, F.lit(0.0))).groupBy("page").agg(F.count("*").alias("n"), (F.max("gap") >= 0.04 * 600).alias("multi_column"))


@query("""
    select p_partkey, substring(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) || '-' || substring(sha256(p_name || p_partkey), 1, 12) as doc_id, round(coalesce(case when p_size % 4 = 0 then p_retailprice / 1000 end, case when p_size % 4 = 1 then 1.5 end, 1.0), 6) as rate from part
""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from a name and a content hash; a rate from the user's override, the project's, or the default."""
    digest = F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256)
    own = F.when(F.col("p_size") % 4 == 0, F.col("p_retailprice") / 1000)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", T.slugify(F.col("p_name"), 48), F.substring(digest, 1, 12)).alias("doc_id"), F.round(F.coalesce(own, F.when(F.col("p_size") % 4 == 1, 1.5), F.lit(1.0)), 6).alias("rate"))


@query("""
    select o_orderkey from (select o_orderkey, o_orderstatus, o_totalprice, o_custkey from orders qualify row_number() over (partition by o_custkey order by (o_orderstatus = 'O')::int, o_totalprice desc, o_orderkey) = 1) order by (o_orderstatus = 'O')::int, o_totalprice desc, o_orderkey limit 5
""")
def recommendation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeds: those with an abstract first, the best of each provider id."""
    order = [F.col("o_orderstatus") == "O", F.desc("o_totalprice"), "o_orderkey"]
    return S.first_per(table(spark, sf_dir, "orders"), ["o_custkey"], order).orderBy(*order).limit(5).select("o_orderkey")


@query("""
    with t as (select doc_id, case when contains(lower(text), 'thor') then 5 when contains(lower(text), 'tho') then 2 else 0 end + case when contains(lower(text), 'inin') then 2 else 0 end + case lang when 'en' then 1 when 'de' then -1 else 0 end as score from documents)
    select doc_id, score::int as score, case when score >= 7 then 'strong' when score >= 3 then 'some' else 'none' end as verdict from t
""")
def reviewer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    score = F.when(F.contains(low, F.lit("thor")), 5).when(F.contains(low, F.lit("tho")), 2).otherwise(0) + F.when(F.contains(low, F.lit("inin")), 2).otherwise(0) + F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", -1).otherwise(0)
    scored = table(spark, sf_dir, "documents").select("doc_id", score.cast("int").alias("score"))
    return scored.withColumn("verdict", F.when(F.col("score") >= 7, "strong").when(F.col("score") >= 3, "some").otherwise("none"))


@query("""
    select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as kinds, len(list_intersect(list_distinct(list(event_type)), ['click', 'error']))::int as shared from events group by 1
""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", F.array_join(F.array_sort("k"), ",").alias("kinds"), F.size(F.array_intersect("k", F.array(F.lit("click"), F.lit("error")))).alias("shared"))
