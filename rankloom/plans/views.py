"""Views of a run and of a chapter tree: visible sections, reattached children, language coverage, judge against lane scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table

#: Sections of a lower score are not shown.  Fixed value.
VISIBLE_SCORE = 5.0
#: Rows of a scatter plot.  Fixed value.
SCATTER_ROWS = 160


@query("""
    select l_orderkey, l_linenumber, coalesce(try_cast(score as double), 0) as score from (select l_orderkey, l_linenumber, case when l_linenumber = 7 then 'n/a' when l_linenumber < 6 then (l_quantity / 4)::varchar end as score from lineitem)
    where coalesce(try_cast(score as double), 0) >= 5
""")
def visible_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that is missing or no number counts as 0."""
    said = F.when(F.col("l_linenumber") == 7, "n/a").when(F.col("l_linenumber") < 6, (F.col("l_quantity") / 4).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(said.try_cast("double"), F.lit(0.0)).alias("score"))
    return rows.filter(F.col("score") >= VISIBLE_SCORE)


@query("""
    with t as (select c_custkey, nullif(c_custkey // 10, 0) as parent, c_custkey % 7 = 0 as archived from customer)
    select child.c_custkey, case when up.archived and not child.archived then up.parent else child.parent end as parent from t child left join t up on child.parent = up.c_custkey
""")
def children_reattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open children of an archived chapter go to the chapter above it; archived ones stay where they are."""
    key = F.col("c_custkey")
    tree = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.floor(key / 10), F.lit(0)).cast("long").alias("parent"), (key % 7 == 0).alias("archived"))
    archived = tree.filter("archived").select(key.alias("parent"), F.col("parent").alias("above"), F.lit(True).alias("gone"))
    joined = tree.join(archived, "parent", "left")
    return joined.select("c_custkey", F.when(F.col("gone") & ~F.col("archived"), F.col("above")).otherwise(F.col("parent")).alias("parent"))


@query("select source, coalesce(string_agg(distinct lang, ',' order by lang), '') as languages, coalesce(bool_or(lang = 'en') and bool_or(lang = 'de'), false) as covered from documents group by 1")
def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each provider's queries, and whether both that are asked for are among them."""
    both = F.bool_or(F.col("lang") == "en") & F.bool_or(F.col("lang") == "de")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.coalesce(both, F.lit(False)).alias("covered"))


@query(f"""
    with first as (select l_orderkey, l_linenumber, case when l_returnflag = 'A' then 'authority' else 'match' end as lane, coalesce(nullif(l_linestatus, 'O'), 'unknown') as pool, case when l_linenumber <> 3 then l_quantity end as llm_score
        from lineitem order by l_shipdate, l_orderkey, l_linenumber limit {SCATTER_ROWS}),
    scored as (select o_orderkey, o_totalprice as match, case when o_orderstatus <> 'P' then o_totalprice / 2 end as authority from orders)
    select l_orderkey, l_linenumber, lane, pool, case when lane = 'authority' then authority else match end as lane_score, llm_score from first join scored on l_orderkey = o_orderkey
    where llm_score is not null and case when lane = 'authority' then authority else match end is not null
""")
def judge_against_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the reranking in its order, those of them with both scores; the lane names the score."""
    rows = table(spark, sf_dir, "lineitem").orderBy("l_shipdate", "l_orderkey", "l_linenumber").limit(SCATTER_ROWS)
    lane = F.when(F.col("l_returnflag") == "A", "authority").otherwise("match")
    pool = F.coalesce(F.nullif("l_linestatus", F.lit("O")), F.lit("unknown"))
    first = rows.select("l_orderkey", "l_linenumber", lane.alias("lane"), pool.alias("pool"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("llm_score"))
    scores = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("match"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 2).alias("authority"))
    lane_score = F.when(F.col("lane") == "authority", F.col("authority")).otherwise(F.col("match"))
    points = scores.join(F.broadcast(first), "l_orderkey").withColumn("lane_score", lane_score)
    return points.filter("llm_score is not null and lane_score is not null").select("l_orderkey", "l_linenumber", "lane", "pool", "lane_score", "llm_score")
