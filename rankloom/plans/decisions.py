"""Section and document verdicts; orders stand for documents, lines for sections, the supplier for the chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import evaluation as E
from ..operators import decisions as D
from ..operators.retrieval import ranked
from ..operators.workspace import dealt
from .base import query, table


@query("""
    with f as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 50 as rerank, l_discount * 10 as cross_score, l_linenumber as n, l_tax * 10 as coverage, case when l_returnflag = 'R' then l_quantity / 50 end as judge, case when l_linestatus = 'F' then 0.05 else 0 end as penalty from lineitem),
    g as (select *, 0.45 * least(n, 4) / 4 + 0.30 * least(n, 5) / 5 + 0.25 * least(n, 3) / 3 as density from f),
    s as (select *, 0.38 * density + 0.32 * least(n / 4, 1) + 0.22 * cross_score + coalesce(0.08 * judge, 0) as support from g)
    select l_orderkey, l_linenumber, l_partkey, round(support, 6) as support, round(least(greatest(0.52 * rerank + 0.18 * cross_score + 0.10 * support + 0.08 * least(n / 4, 1) + 0.07 * coverage + 0.05 * coalesce(judge, 0) - penalty, 0), 1), 6) as probability from s
""")
def section_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.round("support", 6).alias("support"), F.round("probability", 6).alias("probability"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity") / 50
    cross = F.col("l_discount") * 10
    judge = F.when(F.col("l_returnflag") == "R", q)
    lines = table(spark, sf_dir, "lineitem").withColumn("support", scores.support_score(scores.evidence_density(n, n, n), n, cross, judge))
    penalty = F.when(F.col("l_linestatus") == "F", 0.05).otherwise(0.0)
    return lines.withColumn("probability", scores.section_probability(q, cross, F.col("support"), n, F.col("l_tax") * 10, judge, penalty))


DECISIONS = """
    s as (select l_suppkey % 4 as chapter, l_orderkey as doc, l_linenumber * 100000 + l_partkey as section, l_quantity * 2 as score, l_discount * 10 as support, l_returnflag <> 'A' as type_ok from lineitem where l_quantity > 8),
    r as (select *, row_number() over (partition by chapter, doc order by score desc, section) as k from s),
    f as (select chapter, doc, count(*) as n_sections, max(score) as top1, avg(score) filter (k <= 3) as top3, count_if(score >= 34) as n_useful, count_if(score >= 22 and score < 34) as n_partial, avg(support) as support, avg(type_ok::int) as type_share from r group by all),
    d as (select distinct l_suppkey % 4 as chapter, l_orderkey as doc from lineitem),
    p as (select d.*, n_sections, top1, n_useful, n_partial, type_share, round(coalesce(0.55 * top1 / 100 + 0.25 * top3 / 100 + 0.10 * support + 0.10 * least(n_useful / 2, 1), 0), 6) as probability from d left join f using (chapter, doc)),
    v as (select *, case when n_sections is null then 'no_ranked_sections' when top1 < 18 then 'below_floor' when n_useful + n_partial = 0 then 'no_useful_section' when type_share = 0 then 'only_penalised_sections' when probability < 0.16 and top1 < 38 then 'low_probability' end as reason from p)
"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("chapter", F.col("l_suppkey") % 4).withColumnRenamed("l_orderkey", "doc")
    lines = dealt(lines, "chapter", "doc")
    sections = lines.filter("l_quantity > 8").select("chapter", "doc", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("section"), (F.col("l_quantity") * 2).alias("score"), (F.col("l_discount") * 10).alias("support"), (F.col("l_returnflag") != "A").alias("type_ok"))
    return D.document_decisions(lines.select("chapter", "doc").distinct(), sections, ["chapter", "doc"], D.PRODUCTION)


@query(f"with {DECISIONS} select chapter, doc, round(probability, 4) as probability, reason, reason is null as useful from v")
def doc_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("chapter", "doc", F.round("probability", 4).alias("probability"), "reason", "useful")


@query(f"""
    with {DECISIONS} select doc, count_if(reason is null) as n_useful, arg_max(chapter, (probability, -chapter)) as best_chapter,
        {", ".join(f"round(coalesce(max(probability) filter (chapter = {c}), 0), 4) as chapter_{c}" for c in range(4))} from v group by doc
""")
def cross_chapter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = D.chapter_matrix(_decisions(spark, sf_dir), "doc", "chapter", [0, 1, 2, 3])
    return wide.select("doc", "n_useful", "best_chapter", *[F.round(f"chapter_{c}", 4).alias(f"chapter_{c}") for c in range(4)])


@query("""
    with x as (select case when doc_id % 3 = 0 then 'a' else 'b' end as suite, quality = 1 as truth, n_chars > 1200 as found from labels join documents using (doc_id))
    select suite, count_if(truth and found) as tp, count_if(not truth and found) as fp, count_if(truth and not found) as fn, count_if(not truth and not found) as tn,
        round(count_if(truth and found) / greatest(count_if(found), 1), 6) as precision, round(count_if(truth and found) / greatest(count_if(truth), 1), 6) as recall from x group by 1
""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    suite = F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")
    return E.confusion(rows.withColumn("suite", suite), F.col("quality") == 1, F.col("n_chars") > 1200, ["suite"])


@query("""
    with r as (select l_suppkey, l_orderkey, row_number() over (partition by l_suppkey order by max(l_extendedprice) desc, l_orderkey) as rank from lineitem group by 1, 2),
    j as (select l_suppkey, l_orderkey from lineitem where l_quantity > 49 group by all)
    select count(*) as n, count_if(hit) as hits, round(count_if(hit) / greatest(count(*), 1), 6) as hit_rate from (select j.l_suppkey, bool_or(r.rank <= 10) as hit from j left join r using (l_suppkey, l_orderkey) group by 1)
""")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    best = lines.groupBy("l_suppkey", "l_orderkey").agg(F.max("l_extendedprice").alias("score"))
    judged = lines.filter("l_quantity > 49").select("l_suppkey", "l_orderkey").distinct()
    return E.hit_at_k(ranked(best, ["l_suppkey"], "score", ["l_orderkey"]), judged, "l_suppkey", "l_orderkey", 10)


@query("""
    with a as (select o_custkey, bool_or(o_totalprice > 200000) as v from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey, bool_or(o_totalprice > 200000) as v from orders where o_orderkey % 2 = 1 group by 1)
    select count_if(a.v is not null and b.v is not null) as shared, count_if(b.v is null) as only_old, count_if(a.v is null) as only_new, round(count_if(a.v = b.v) / greatest(count_if(a.v is not null and b.v is not null), 1), 6) as agreement from a full join b using (o_custkey)
""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    run = lambda side: orders.filter(F.col("o_orderkey") % 2 == side).groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 200000).alias("verdict"))
    return E.compare_runs(run(0), run(1), "o_custkey")
