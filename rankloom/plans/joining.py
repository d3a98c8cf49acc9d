"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..operators import joins as J
from ..operators.selection import quota_per
from .base import query, table


@query("""
    with a as (select l_suppkey, l_orderkey as a_id, l_linenumber as a_line, l_partkey as a_start, l_partkey + cast(l_quantity as bigint) as a_end from lineitem where l_returnflag = 'R'),
    b as (select l_suppkey, l_orderkey as b_id, l_linenumber as b_line, l_partkey as b_start, l_partkey + 5 as b_end from lineitem where l_returnflag = 'A' and l_quantity > 45)
    select a_id, a_line, a_start, b_id, b_line, b_start from a join b using (l_suppkey) where greatest(a_start, b_start) <= least(a_end, b_end)
""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    side = lambda p, end: lines.select("l_suppkey", "l_returnflag", "l_quantity", F.col("l_orderkey").alias(f"{p}_id"), F.col("l_linenumber").alias(f"{p}_line"), F.col("l_partkey").alias(f"{p}_start"), (F.col("l_partkey") + end).alias(f"{p}_end"))
    a = side("a", F.col("l_quantity").cast("long")).filter("l_returnflag = 'R'").drop("l_returnflag", "l_quantity")
    b = side("b", F.lit(5)).filter("l_returnflag = 'A' and l_quantity > 45").drop("l_returnflag", "l_quantity")
    return J.interval_overlap(a, b, ["l_suppkey"], ("a_start", "a_end"), ("b_start", "b_end"), 50).select("a_id", "a_line", "a_start", "b_id", "b_line", "b_start")


@query("with p as (select p_partkey, [p_partkey % 25, p_size % 25, p_partkey % 25] as nations from part) select p_partkey, n_nationkey, n_name from p join nation on list_contains(nations, n_nationkey)")
def array_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_partkey") % 25, (F.col("p_size") % 25).cast("long"), F.col("p_partkey") % 25).alias("nations"))
    return J.array_contains_join(parts, "nations", table(spark, sf_dir, "nation"), "n_nationkey").select("p_partkey", "n_nationkey", "n_name")


@query("select user_id, count(distinct event_type) filter (event_type in ('click', 'view', 'purchase')) = (select count(distinct event_type) from events where event_type in ('click', 'view', 'purchase')) as complete from events group by 1")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    required = events.filter(F.col("event_type").isin("click", "view", "purchase"))
    return J.has_all(events, "user_id", "event_type", required)


@query("""
    with l as (select user_id, event_type, arg_max({'v': value, 'e': event_id}, (ts, event_id)) as last from events group by all)
    select c_custkey, event_type, last.v as value, last.e as event_id from customer left join l on user_id = c_custkey
""")
def rerank_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = J.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", F.struct("ts", "event_id").alias("at")), ["user_id", "event_type"], "at")
    users = table(spark, sf_dir, "customer").select("c_custkey")
    return users.join(last, users.c_custkey == last.user_id, "left").select("c_custkey", "event_type", "value", "event_id")


@query("""
    with k as (select c_custkey as file_id, md5((c_custkey % 500)::varchar) as sha, 'f' || (c_custkey % 700) as name, c_nationkey as size, 1 as pages from customer where c_custkey <= 750),
    f as (select c_custkey as file_id, md5((c_custkey % 600)::varchar) as sha, 'f' || (c_custkey % 700) as name, c_nationkey as size, 1 as pages from customer where c_custkey > 750),
    m as (select f.file_id, k.file_id as known_id, 0 as tier from f join k using (sha) union all select f.file_id, k.file_id, 1 from f join k using (name, size, pages))
    select file_id, arg_min(known_id, (tier, known_id)) as known_id, case min(tier) when 0 then 'hash' else 'name' end as matched_by from m group by 1
""")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer")
    side = lambda mod: users.select(F.col("c_custkey").alias("file_id"), F.md5((F.col("c_custkey") % mod).cast("string")).alias("sha"), F.concat(F.lit("f"), (F.col("c_custkey") % 700).cast("string")).alias("name"), F.col("c_nationkey").alias("size"), F.lit(1).alias("pages"))
    return J.duplicate_files(side(600).filter("file_id > 750"), side(500).filter("file_id <= 750"))


@query("""
    with a as (select distinct o_custkey as id from orders where o_totalprice > 300000), b as (select distinct o_custkey as id from orders where o_orderpriority like '1%')
    select 'both' as side, id from (select id from a intersect select id from b) union all select 'first', id from (select id from a except select id from b) union all select 'second', id from (select id from b except select id from a)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a = orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id")).distinct()
    b = orders.filter(F.col("o_orderpriority").like("1%")).select(F.col("o_custkey").alias("id")).distinct()
    named = lambda df, side: df.select(F.lit(side).alias("side"), "id")
    return named(a.intersect(b), "both").union(named(a.subtract(b), "first")).union(named(b.subtract(a), "second"))


@query("""
    with t as (select p_partkey, p_brand, list_distinct(string_split(trim(regexp_replace(lower(p_type), '[^\\pL\\pN]+', ' ', 'g')), ' ')) as w, p_size from part)
    select a.p_partkey as left_id, b.p_partkey as right_id, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 6) as similarity
    from t a join t b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey where len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1) >= 0.5
""")
def strong_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_partkey").alias("left_id"), normalize_title(F.col("p_type")).alias("a"))
    return J.similar_titles(t, ["p_brand", "p_size"], "left_id", "right_id", "a", 0.5).withColumn("similarity", F.round("similarity", 6))


@query("""
    with d as (select distinct o_custkey from orders where o_totalprice > 250000), n as (select c_custkey, c_nationkey from customer)
    select c_nationkey, count(*) filter (c_custkey in (select o_custkey from d)) as wanted, count(*) filter (c_custkey not in (select o_custkey from d)) as new from n group by 1
""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    wanted = users.join(have, "c_custkey", "left_semi").withColumn("w", F.lit(1))
    new = users.join(have, "c_custkey", "left_anti").withColumn("w", F.lit(0))
    return wanted.union(new).groupBy("c_nationkey").agg(F.sum("w").alias("wanted"), F.sum(1 - F.col("w")).alias("new"))


@query("""
    with hits as (select l_suppkey as query, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem where l_quantity > 40)
    select s_suppkey as query, count(h.rank) as n, coalesce(max(rank), 0) as max_rank, coalesce(array_to_string(list(p_name order by rank) filter (rank <= 3), '|'), '') as samples from supplier left join hits h on query = s_suppkey left join part on p_partkey = l_partkey group by 1
""")
def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = quota_per(table(spark, sf_dir, "lineitem").filter("l_quantity > 40").withColumnRenamed("l_suppkey", "query"), ["query"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 1 << 30)
    counts = hits.groupBy("query").agg(F.count("*").alias("n"), F.max("rank").alias("max_rank"))
    named = hits.filter("rank <= 3").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    samples = named.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_name"))), lambda x: x.p_name), "|").alias("samples"))
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"))
    return queries.join(counts, "query", "left").join(samples, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("max_rank", F.lit(0)).cast("long").alias("max_rank"), F.coalesce("samples", F.lit("")).alias("samples"))
