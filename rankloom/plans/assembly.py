"""Assembling a run's rows from those of its stages; orders stand for candidates, their lines for stage scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as B
from ..operators import entities
from .base import query, table


@query("""
    with c as (select o_orderkey, case when o_custkey % 4 > 0 then case when o_custkey % 2 = 0 then 'with_abstract' else 'without_abstract' end end as pool from orders),
    s1 as (select l_orderkey, round(avg(l_discount), 6) as s1 from lineitem where l_linenumber <= 2 and l_returnflag <> 'A' group by 1), s2 as (select l_orderkey, round(max(l_tax), 6) as s2 from lineitem where l_quantity > 20 group by 1),
    j as (select o_orderkey, coalesce(pool, 'unknown') as pool, s1, case when pool = 'with_abstract' then s2 end as s2 from c left join s1 on s1.l_orderkey = o_orderkey left join s2 on s2.l_orderkey = o_orderkey)
    select o_orderkey, pool, case when s2 is not null then 'stage2' else 'stage1' end as stage, coalesce(s2, s1) as score, (select count(*) from j where s1 is null) as missing from j where s1 is not null
""")
def stage_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_custkey") % 4 > 0, F.when(F.col("o_custkey") % 2 == 0, "with_abstract").otherwise("without_abstract"))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    first = lines.filter("l_linenumber <= 2 and l_returnflag <> 'A'").groupBy("o_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("s1"))
    second = lines.filter("l_quantity > 20").groupBy("o_orderkey").agg(F.round(F.max("l_tax"), 6).alias("s2"))
    return B.stage_precedence(table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("pool")), first, second, "o_orderkey")


@query("""
    with j as (select *, case when p_size > 25 then p_type || ' ' || p_name else array_to_string(list_filter([p_name, case when p_size % 2 = 0 then p_brand end], lambda t: t is not null), ' | ') end as said from lineitem join part on p_partkey = l_partkey)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity > 40 then 'evidence ' || l_suppkey when length(said) > 12 then rtrim(substring(said, 1, 11)) || '…' else said end as excerpt from j
""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 25, F.concat_ws(" ", "p_type", "p_name")).alias("abstract"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("venue"))
    scored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 40, F.concat(F.lit("evidence "), F.col("l_suppkey").cast("string"))).alias("evidence"))
    return B.excerpts(scored, parts, "l_partkey", 12).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "excerpt")


@query("""
    with j as (select l_partkey as id, sum((l_discount * 100)::bigint) / count(*) / 100 as judge from lineitem where l_returnflag = 'R' group by 1)
    select p_partkey, round(case when judge is null then p_retailprice / 1000 else 0.7 * p_retailprice / 1000 + 0.3 * judge end, 10) as score, judge is not null as judged from part left join j on id = p_partkey
""")
def judge_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.sum(F.bround(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100).alias("judge"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("base")).join(judged, "p_partkey", "left")
    return rows.select("p_partkey", F.round(F.when(F.col("judge").isNull(), F.col("base")).otherwise(0.7 * F.col("base") + 0.3 * F.col("judge")), 10).alias("score"), F.col("judge").isNotNull().alias("judged"))


@query("""
    with g as (select doc_id, count(*) as n, max(quality) as best from labels group by 1)
    select d.doc_id, coalesce(n, 0) as n, coalesce(best, 0) > 0 as useful, case when n is null then 'no_ranked_sections' when best = 0 then 'low_probability' end as reason, count_if(coalesce(best, 0) > 0) over (partition by lang) as useful_of_language from documents d left join g using (doc_id)
""")
def decided_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its decision, rows or not, and the decisions of its language beside it."""
    graded = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("quality").alias("best"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(graded, "doc_id", "left").withColumn("useful", F.coalesce(F.col("best") > 0, F.lit(False)))
    by_language = docs.groupBy("lang").agg(F.count_if("useful").alias("useful_of_language"))
    return docs.join(by_language, "lang").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), "useful", F.when(F.col("n").isNull(), "no_ranked_sections").when(F.col("best") == 0, "low_probability").alias("reason"), "useful_of_language")


@query("""
    with d as (select s_suppkey, 'Data\\' || case when s_suppkey % 7 = 0 then 'Lost' else (select n_name from nation where n_nationkey = s_nationkey) end || '.PDF' as path from supplier), m as (select 'data/' || lower(n_name) || '.pdf' as path_norm, n_regionkey as pdf_id from nation)
    select s_suppkey, r_name as snapshot, pdf_id is null as unmatched from d left join m on path_norm = lower(replace(path, '\\', '/')) left join region on r_regionkey = pdf_id
""")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document to manifest by normalised path, manifest to snapshot by id."""
    nations = table(spark, sf_dir, "nation")
    suppliers = table(spark, sf_dir, "supplier").join(nations.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    docs = suppliers.select("s_suppkey", F.concat(F.lit("Data\\"), F.when(F.col("s_suppkey") % 7 == 0, "Lost").otherwise(F.col("n_name")), F.lit(".PDF")).alias("path"))
    manifest = nations.select(F.concat(F.lit("./data/"), F.lower("n_name"), F.lit(".pdf")).alias("path"), F.col("n_regionkey").alias("pdf_id"))
    snapshots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pdf_id"), F.col("r_name").alias("snapshot"))
    return B.snapshots_of(docs, manifest, snapshots).select("s_suppkey", "snapshot", F.col("pdf_id").isNull().alias("unmatched"))


@query("select event_id, user_id, event_type from events where event_type <> 'click' and (ts, event_id) < (select (ts, event_id) from events order by ts desc, event_id desc limit 1 offset 50) order by ts desc, event_id desc limit 25")
def operations_page_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cursor = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(51).agg(F.min(F.struct("ts", "event_id")).alias("at"))
    rows = events.filter("event_type <> 'click'").join(F.broadcast(cursor)).filter(F.struct("ts", "event_id") < F.col("at"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "event_type")


@query("select p_partkey, p_size / 50 as match_lane, p_retailprice / 2000 as authority_lane from part where p_partkey % 6 > 0 order by p_size / 50 desc, p_partkey limit 500")
def match_authority_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 best candidates that have a match score, by both scores."""
    match = F.when(F.col("p_partkey") % 6 > 0, F.col("p_size") / 50)
    rows = table(spark, sf_dir, "part").select("p_partkey", match.alias("match_lane"), (F.col("p_retailprice") / 2000).alias("authority_lane"))
    return rows.filter("match_lane is not null").orderBy(F.desc("match_lane"), "p_partkey").limit(500)


@query("""
    select o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority like '%URGENT%' desc, greatest(o_totalprice::bigint % 90 - 20, 0) desc, o_orderkey % 3 desc, o_orderkey % 2 = 0 desc, case when o_custkey % 2 = 0 then o_orderkey % 700 else 0 end desc, year(o_orderdate) desc, o_orderkey) as position from orders
""")
def precap_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.contains("o_orderpriority", F.lit("URGENT")), F.greatest(F.bround("o_totalprice").cast("long") % 90 - 20, F.lit(0)), F.col("o_orderkey") % 3, F.col("o_orderkey") % 2 == 0, F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 700).otherwise(0), F.year("o_orderdate")]
    priority = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(priority), "o_orderkey")).alias("position"))


@query("select c_custkey, (case when c_custkey % 3 = 0 then null else c_nationkey end) is not distinct from (case when c_custkey % 2 = 0 then null else c_nationkey end) and c_mktsegment is not distinct from 'BUILDING' as valid from customer")
def cached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary is valid for the run and the type of text that it was made from, unknown ones being equal."""
    unless = lambda n: F.when(F.col("c_custkey") % n != 0, F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", (unless(3).eqNullSafe(unless(2)) & F.col("c_mktsegment").eqNullSafe("BUILDING")).alias("valid"))


@query("select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0) as input_tokens, 0::bigint as output_tokens, round(coalesce(cast(json_extract(props, '$.k') as double), 0) * value, 6) as cost from events")
def usage_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost from the metadata of a call, 0 where it says nothing."""
    found = lambda name: F.coalesce(F.get_json_object("props", f"$.{name}").cast("long"), F.lit(0).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", found("k").alias("input_tokens"), found("output").alias("output_tokens"), F.round(found("k") * F.col("value"), 6).alias("cost"))


@query(None)
def built_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders merged one by one into candidates, with the ids and sources of all their records."""
    orders = table(spark, sf_dir, "orders")
    on = lambda n, x: F.when(F.col("o_orderkey") % 3 == n, x)
    rows = orders.select(
        F.col("o_orderkey").alias("rid"), on(0, F.concat(F.lit("10.1234/w"), (F.col("o_custkey") % 400).cast("string"))).alias("doi"), F.lit(None).cast("string").alias("arxiv"), on(1, (F.col("o_custkey") % 200).cast("string")).alias("pmid"),
        F.concat(F.lit("Work "), (F.col("o_custkey") % 900).cast("string")).alias("title"), F.year("o_orderdate").alias("year"), F.array(F.concat(F.lit("A. Name"), (F.col("o_custkey") % 7).cast("string"))).alias("authors"), F.col("o_totalprice").cast("long").alias("citations"),
        (F.col("o_orderkey") % 5 == 0).alias("is_core"), F.element_at(F.array(F.lit("one"), F.lit("two")), (F.col("o_orderkey") % 2 + 1).cast("int")).alias("provider"), F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, 8).alias("query_hash"), (F.col("o_orderkey") % 11).cast("int").alias("query"), (F.col("o_orderkey") % 30).cast("int").alias("rank"),
    )
    found = entities.build_candidates(rows, "rid")
    return found.select("candidate", "first", "n", "title", "year", "citations", F.array_join("providers", ",").alias("providers"), F.size("sources").alias("n_sources"), F.size(F.map_keys("provider_ids")).alias("n_provider_ids"))
