"""Support and rescue queries; lines of an order stand for passages of a section, suppliers for sub-points or facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators.workspace import dealt
from .base import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("lane"), "l_extendedprice", "l_quantity", "l_linestatus")


@query("""
    with b as (select l_orderkey, l_partkey, max(l_extendedprice) as s from lineitem group by all), r as (select *, row_number() over (partition by l_orderkey order by s desc, l_partkey) as k from b),
    l as (select l_orderkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') as lanes, count(distinct l_partkey) as n from lineitem group by 1)
    select l_orderkey, array_to_string(list(l_partkey order by k) filter (k <= 3), ',') as passages, any_value(lanes) as lanes, any_value(n) as n from r join l using (l_orderkey) group by 1
""")
def supporting_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.supporting_passages(_lines(spark, sf_dir), "l_orderkey", "l_partkey", "l_extendedprice", 3)
    return found.select("l_orderkey", F.array_join(F.col("passages").cast("array<string>"), ",").alias("passages"), F.array_join("lanes", ",").alias("lanes"), "n")


_TRUSTED = "l_quantity > 30 and l_linestatus = 'F'"


@query(f"select l_suppkey, count(*) as n, count_if({_TRUSTED}) as n_trusted, count(distinct l_orderkey) filter ({_TRUSTED}) as n_docs, arg_max(l_partkey, ({_TRUSTED}, l_extendedprice, -l_partkey)) as top from lineitem group by 1")
def support_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.support_inventory(_lines(spark, sf_dir), "l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", F.expr(_TRUSTED))


@query("""
    with i as (select l_suppkey, count_if(l_quantity > 49 and l_suppkey % 3 = 0) as n from lineitem group by 1), p as (select s_suppkey, s_nationkey, coalesce(n, 0) > 0 as ok from supplier left join i on l_suppkey = s_suppkey)
    select s_suppkey, s_nationkey from p qualify ok or count_if(ok) over (partition by s_nationkey) < 2
""")
def unsupported_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = E.support_inventory(_lines(spark, sf_dir), "l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", F.expr("l_quantity > 49 and l_suppkey % 3 = 0")).withColumnRenamed("l_suppkey", "s_suppkey")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return E.suppress_unsupported(points, inventory, "s_nationkey", "s_suppkey").select("s_suppkey", "s_nationkey")


@query("""
    with s as (select l_returnflag as facet, l_suppkey as term, count(distinct l_orderkey) as docs, count_if(l_linenumber = 1) as titles, count(*) as texts from lineitem group by all)
    select facet, term, round(4 * docs + 2 * titles + 0.2 * least(texts, 20), 6) as weight, row_number() over (partition by facet order by 4 * docs + 2 * titles + 0.2 * least(texts, 20) desc, term) as rank from s qualify rank <= 12
""")
def plan_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("facet"), F.col("l_suppkey").alias("term"))
    support = lines.agg(F.countDistinct("l_orderkey").alias("docs"), F.count_if(F.col("l_linenumber") == 1).alias("titles"), F.count("*").alias("texts"))
    return E.recalibrated_terms(support, "facet", "term", 12).select("facet", "term", F.round("weight", 6).alias("weight"), "rank")


@query("""
    with d as (select l_suppkey as chapter, l_orderkey as doc, sum(l_quantity) as score from lineitem group by all), f as (select l_suppkey as chapter, l_orderkey as doc, max(l_extendedprice / 1000) as best from lineitem where l_returnflag = 'R' group by all)
    select chapter, doc, round(score - 0.35 * coalesce(best, 0), 8) as rescue, row_number() over (partition by chapter order by round(score - 0.35 * coalesce(best, 0), 9) desc, doc) as rank from d left join f using (chapter, doc) where score - 0.35 * coalesce(best, 0) > 0 qualify rank <= 5
""")
def doc_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chapter"), F.col("l_orderkey").alias("doc"), "l_quantity", "l_extendedprice", "l_returnflag")
    lines = dealt(lines, "chapter", "doc")
    docs = lines.groupBy("chapter", "doc").agg(F.sum("l_quantity").alias("score"))
    fused = lines.filter("l_returnflag = 'R'").select("chapter", "doc", (F.col("l_extendedprice") / 1000).alias("fused"))
    return E.rescue_documents(docs, fused, "chapter", "doc", 5).withColumn("rescue", F.round("rescue", 8))


@query("""
    with x as (select o_custkey % 20 as chapter, o_orderpriority as facet, o_totalprice, o_orderkey % 700 as item from orders), b as (select chapter, facet, item, max(o_totalprice) as score from x group by all),
    t as (select *, row_number() over (partition by chapter, facet order by score desc, item) as turn from b), o as (select * from t qualify row_number() over (partition by chapter, item order by turn, facet) = 1)
    select chapter, item, facet, row_number() over (partition by chapter order by turn, facet) as position from o qualify position <= 30
""")
def round_robin_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("chapter"), F.col("o_orderpriority").alias("facet"), (F.col("o_orderkey") % 700).alias("item")).agg(F.max("o_totalprice").alias("score"))
    return E.round_robin(rows, "chapter", "facet", "item", "score", 30)


@query("""
    with s as (select * from (values ('click', false), ('view', true), ('purchase', false), ('embed', false)) t(stage, cached)), c as (select event_type as stage, count(*) as calls, sum(greatest(cast(value - 5 as decimal(18,4)), 0)) as cost, sum(cast(json_extract(props, '$.k') as bigint)) as tokens from events group by 1)
    select stage, coalesce(calls, 0) as calls, cast(case when cached then 0 else coalesce(cost, 0) end as double) as cost, coalesce(tokens, 0)::bigint as tokens from s left join c using (stage)
""")
def stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = spark.sql("select * from values ('click', false), ('view', true), ('purchase', false), ('embed', false) as t(stage, cached)")
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("value") - 5).cast("decimal(18,4)").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return E.stage_costs(calls, "stage", "cost", "tokens", stages).withColumn("cost", F.col("cost").cast("double"))


@query("""
    select o_orderkey, (o_orderkey % 3)::bigint as stages, case o_orderkey % 3 when 0 then 0.0 when 1 then o_custkey * 0.5 else o_custkey * 0.5 + 2 end as cost, case o_orderkey % 3 when 0 then 0.0 when 1 then o_custkey * 1.0 else o_custkey + 100.0 end as duration,
        case when o_orderkey % 3 = 1 or (o_orderkey % 3 = 2 and o_custkey > 100) then 'a' when o_orderkey % 3 = 2 then 'b' end as slowest from orders
""")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    first = F.concat(F.lit('"a": {"duration": '), c, F.lit('.0, "cost": '), (F.col("o_custkey") * 0.5).cast("string"), F.lit("}"))
    second = F.lit('"b": {"cost": 2.0, "duration": 100.0}')
    k = F.col("o_orderkey") % 3
    stages = F.when(k == 0, F.lit("")).when(k == 1, first).otherwise(F.concat(first, F.lit(", "), second))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('{"stages": {'), stages, F.lit("}}")).alias("metrics"))
    return E.run_index(runs, "o_orderkey", "metrics")
