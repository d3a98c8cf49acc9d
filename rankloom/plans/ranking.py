"""Window and score queries over orders and lineitem; an order stands for a document or candidate, its lines for sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import selection as S
from ..operators import stats
from ..operators.evaluation import tournament
from ..operators.ordering import group_rank, order_statistics
from .base import query, table


@query("select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderstatus, o_orderkey) as lane_rank from orders")
def lane_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = group_rank(table(spark, sf_dir, "orders"), "o_orderpriority", [F.desc("o_totalprice"), "o_orderstatus", "o_orderkey"], "lane_rank")
    return placed.select("o_orderkey", "o_orderpriority", "lane_rank")


@query("""
    with n as (select l_orderkey, l_linenumber, l_extendedprice, count(*) over (partition by l_orderkey) as n from lineitem)
    select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank from n where l_extendedprice > 30000 qualify rank <= least(n, greatest(3, 2))
""")
def view_rank_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).filter("l_extendedprice > 30000")
    return S.quota_per(counted, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], F.least("n", F.lit(3))).select("l_orderkey", "l_linenumber", "rank")


@query("select l_orderkey, arg_max(l_linenumber, (l_returnflag = 'R', l_extendedprice, l_quantity, -l_linenumber)) as l_linenumber from lineitem group by 1")
def best_row_by_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct((F.col("l_returnflag") == "R").alias("a"), "l_extendedprice", "l_quantity", (-F.col("l_linenumber")).alias("b"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", key).alias("l_linenumber"))


@query("select l_orderkey, l_linenumber, round(case when max(l_quantity) over w > min(l_quantity) over w then (l_quantity - min(l_quantity) over w) / (max(l_quantity) over w - min(l_quantity) over w) else 0 end, 6) as prior, round(l_extendedprice / max(l_extendedprice) over w, 6) as relative from lineitem window w as (partition by l_orderkey)")
def min_max_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    top = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return lines.select("l_orderkey", "l_linenumber", F.round(S.min_max(F.col("l_quantity"), ["l_orderkey"]), 6).alias("prior"), F.round(F.col("l_extendedprice") / top, 6).alias("relative"))


@query("""
    with r as (select l_orderkey, l_extendedprice as x, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as k from lineitem)
    select l_orderkey, count(*) as n, round(max(x), 4) as top1, round(max(x) - coalesce(max(x) filter (k = 2), 0), 4) as margin, round(avg(x) filter (k <= 3), 4) as top3 from r group by 1
""")
def margin_and_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    placed = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(x), "l_linenumber")))
    second = F.coalesce(F.max(F.when(F.col("k") == 2, x)), F.lit(0.0))
    return placed.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.max(x), 4).alias("top1"), F.round(F.max(x) - second, 4).alias("margin"), F.round(F.avg(F.when(F.col("k") <= 3, x)), 4).alias("top3"))


@query("""
    with a as (select o_custkey, row_number() over (order by max(o_totalprice) desc, o_custkey) as old_rank from orders where o_orderkey % 2 = 0 group by 1),
    b as (select o_custkey, row_number() over (order by max(o_totalprice) desc, o_custkey) as new_rank from orders where o_orderkey % 2 = 1 group by 1)
    select o_custkey, old_rank, new_rank, old_rank - new_rank as shift from (select * from a where old_rank <= 200) join (select * from b where new_rank <= 200) using (o_custkey) order by abs(old_rank - new_rank) desc, o_custkey limit 6
""")
def rank_shift_between_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(side: int) -> DataFrame:
        best = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == side).groupBy("o_custkey").agg(F.max("o_totalprice").alias("score"))
        top = best.orderBy(F.desc("score"), "o_custkey").limit(200)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "o_custkey")))

    return S.rank_shift(run(0), run(1), "o_custkey", 6)


@query("""
    with r as (select row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as a, row_number() over (order by l_quantity desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as b from lineitem)
    select round(1 - 6 * sum((a - b)::double * (a - b)) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) as rho, count(*) as n from r
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return stats.spearman(lines, "l_extendedprice", "l_quantity", "tie").select(F.round("rho", 6).alias("rho"), "n")


@query("""
    with d as (select l_suppkey, abs(l_extendedprice - l_quantity * 1000) as d from lineitem)
    select l_suppkey, round(max(d), 4) as most, round(avg(d), 1) as mean, round(list_sort(list(d))[len(list(d)) // 2 + 1], 4) as upper_median from d group by 1
""")
def score_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("d"))
    basic = d.groupBy("l_suppkey").agg(F.round(F.max("d"), 4).alias("most"), F.round(F.avg("d"), 1).alias("mean"))
    middle = order_statistics(d, "l_suppkey", "d", {"upper_median": F.floor(F.col("n") / 2)})
    return basic.join(middle, "l_suppkey").withColumn("upper_median", F.round("upper_median", 4))


@query("""
    select l_orderkey, l_linenumber, round(0.8 * l_discount * 10 + 0.2 * l_tax * 10, 6) as lane, round(0.55 * l_discount * 10 + 0.45 * greatest(l_tax * 10 - 0.3, 0), 6) as semantic,
        case when l_quantity * 2 >= 85 then 'very_high' when l_quantity * 2 >= 70 then 'high' when l_quantity * 2 >= 55 then 'medium' when l_quantity * 2 >= 40 then 'low' else 'very_low' end as band,
        case when l_discount * 10 >= 0.78 then 'strong' when l_discount * 10 >= 0.55 then 'partial' else 'weak' end as support,
        round(0.62 * l_discount + 0.28 * l_tax + 0.10 * l_quantity / 50, 6) as cross_score, 3.0 * (l_linenumber % 2) + 1.6 * (l_linenumber % 3) + 1.15 * (l_linenumber % 4) + 0.55 * (l_linenumber % 5) as anchor
    from lineitem
""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q, n = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(0.8 * d * 10 + 0.2 * t * 10, 6).alias("lane"),
        F.round(0.55 * d * 10 + 0.45 * F.greatest(t * 10 - 0.3, F.lit(0.0)), 6).alias("semantic"),
        scores.band(q * 2).alias("band"),
        scores.support_label(d * 10).alias("support"),
        F.round(scores.cross_blend(t, q / 50, d), 6).alias("cross_score"),
        F.round(scores.anchor_score(n % 2, n % 3, n % 4, n % 5), 6).alias("anchor"),
    )


@query("""
    with p as (select a.doc_id as left_id, b.doc_id as right_id, case when a.quality > b.quality then 'left' when a.quality < b.quality then 'right' else 'tie' end as winner, abs(a.toxic - b.toxic) * 3 as confidence
        from labels a join labels b on b.doc_id = a.doc_id + 1),
    s as (select left_id as id, case winner when 'left' then 1 + 0.1 * confidence when 'tie' then 0.5 else 0 end as score from p union all select right_id, case winner when 'right' then 1 + 0.1 * confidence when 'tie' then 0.5 else 0 end from p)
    select id, round(sum(score)::double, 4) as score, count(*) as games from s group by id
""")
def judge_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    other = labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("right_id"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
    pairs = labels.join(other, "doc_id").select(F.col("doc_id").alias("left_id"), "right_id", F.when(F.col("quality") > F.col("q"), "left").when(F.col("quality") < F.col("q"), "right").otherwise("tie").alias("winner"), (F.abs(F.col("toxic") - F.col("t")) * 3).alias("confidence"))
    return tournament(pairs, "left_id", "right_id").select("id", F.round("score", 4).alias("score"), "games")
