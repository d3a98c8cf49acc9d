"""Lexical and dense lanes over documents and embeddings, their fusion and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import MARKED, PLAIN, STOP_WORDS
from ..functions.vectors import cosine, top_mean
from ..operators import retrieval as R
from ..operators.ranking import authority
from .base import query, table

_FOLD = f"lower(regexp_replace(translate(text, '{MARKED}', '{PLAIN}'), '[^\\x00-\\x7F]', '', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all({_FOLD}, '[a-z0-9]{{2,}}'), lambda t: t not in ({_STOP}))"
BM25 = f"""
    w as (select doc_id, {_TOKENS} as terms from documents),
    size as (select count(*) as n, avg(len(terms)) as mean from w),
    q as (select item_id, term, count(*) as qf from (select item_id, unnest({_TOKENS}) as term from benchmark) group by all),
    p as (select term, doc_id, length, count(*) as tf from (select doc_id, len(terms) as length, unnest(terms) as term from w) where term in (select term from q) group by all),
    df as (select term, count(*) as df from p group by term),
    bm25 as (select item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from p join df using (term) join q using (term), size group by all)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query(f"with {BM25} select item_id, doc_id, round(score, 9) as score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as lane_rank from bm25 qualify lane_rank <= 20")
def bm25_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.ranked(_bm25(spark, sf_dir).withColumn("score", F.round("score", 9)), ["item_id"], "score", ["doc_id"], 20, "lane_rank")
    return top.select("item_id", "doc_id", "score", "lane_rank")


@query(f"""
    with {BM25}, v as (select item_id % 8 as lane, doc_id, round(score, 9) as score, row_number() over (partition by item_id % 8, doc_id order by round(score, 9) desc) as k from bm25),
    f as (select lane, doc_id, sum(score * case when k = 1 then 1 else 0.2 end) as score from v where k <= 3 group by all)
    select lane, doc_id, round(score, 9) as score, row_number() over (partition by lane order by round(score, 9) desc, doc_id) as lane_rank from f qualify lane_rank <= 40
""")
def multi_view_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _bm25(spark, sf_dir).select((F.col("item_id") % 8).alias("lane"), "doc_id", F.round("score", 9).alias("score"))
    placed = R.finalize_lane(views, ["lane"], "score", 10**9, "doc_id").drop("lane_rank").withColumn("score", F.round("score", 9))
    return R.ranked(placed, ["lane"], "score", ["doc_id"], 40, "lane_rank").select("lane", "doc_id", "score", "lane_rank")


LANES = f"""
    {BM25}, l as (select 'lane' || (item_id % 4) as lane, doc_id, row_number() over (partition by item_id % 4 order by max(round(score, 9)) desc, doc_id) as lane_rank from bm25 group by 1, item_id % 4, doc_id)
"""


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _bm25(spark, sf_dir).groupBy(F.concat(F.lit("lane"), (F.col("item_id") % 4).cast("string")).alias("lane"), "doc_id").agg(F.max(F.round("score", 9)).alias("score"))
    return R.ranked(best, ["lane"], "score", ["doc_id"], None, "lane_rank")


@query(f"with {LANES} select doc_id, round(sum(case lane when 'lane0' then 1.0 when 'lane1' then 0.8 else 0.6 end / (60 + lane_rank)), 9) as fused, array_to_string(list_sort(list(distinct lane)), ',') as lanes from l where lane_rank <= 120 group by doc_id")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("lane") == "lane0", 1.0).when(F.col("lane") == "lane1", 0.8).otherwise(0.6)
    fused = R.reciprocal_rank_fusion(_lanes(spark, sf_dir).filter("lane_rank <= 120"), [], "doc_id", weight)
    return fused.select("doc_id", F.round("fused", 9).alias("fused"), F.array_join("lanes", ",").alias("lanes"))


@query(f"""
    with {LANES}, t as (select lane, doc_id from l where lane_rank <= 40)
    select a.lane as "left", b.lane as "right", count(*) filter (a.doc_id = b.doc_id) as shared, round(count(*) filter (a.doc_id = b.doc_id) / (count(distinct a.doc_id) + count(distinct b.doc_id) - count(*) filter (a.doc_id = b.doc_id)), 4) as jaccard
    from t a, t b where a.lane < b.lane group by 1, 2
""")
def lane_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lane_overlap(_lanes(spark, sf_dir), "doc_id")


@query("""
    with v as (select vec_id, label, embedding::double[] as x from embeddings)
    select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.x, v.x) / sqrt(list_dot_product(q.x, q.x) * list_dot_product(v.x, v.x)), 6) as score,
        row_number() over (partition by q.vec_id order by round(list_dot_product(q.x, v.x) / sqrt(list_dot_product(q.x, q.x) * list_dot_product(v.x, v.x)), 6) desc, v.vec_id) as rank
    from v q, v where q.vec_id % 100 = 0 qualify rank <= 10
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.cosine_best(vectors, asked, "vec_id", "query_id", "embedding", 10)


_FACETS = "f as (select label as facet, list(v order by i) as center from (select label, i, avg(embedding[i]::double) as v from embeddings, range(1, 65) r(i) group by all) group by 1), s as (select vec_id, list(round(greatest(list_dot_product(embedding::double[], center) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(center, center)), 0), 6) order by facet) as scores from embeddings, f group by vec_id)"


def _facet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the mean vector of each label, none below 0."""
    vectors = table(spark, sf_dir, "embeddings")
    spread = vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    facets = spread.groupBy(F.col("label").alias("facet")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p.v).alias("center"))
    score = F.round(F.greatest(cosine(F.col("embedding"), F.col("center")), F.lit(0.0)), 6)
    scored = vectors.join(F.broadcast(facets)).select("vec_id", "facet", score.alias("score"))  # a label's mean each: ten rows
    return scored.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("facet", "score"))), lambda p: p.score).alias("scores"))


_MATCH = "m as (select vec_id, scores, list_transform(list_zip(scores, [5, 4, 3, 2, 1, 5, 4, 3, 2, 1]), lambda z: z[1] * z[2]) as weighted, 30.0 as mass from s), t as (select vec_id, list_max(weighted) / 5 as best, list_sum(list_sort(weighted, 'DESC')[1:3]) / mass as top_m, list_sum(list_transform(list_zip(scores, [5, 4, 3, 2, 1, 5, 4, 3, 2, 1]), lambda z: z[2] * greatest(z[1] - 0.2, 0))) / mass as coverage from m)"


@query(f"with {_FACETS}, {_MATCH} select vec_id, round(best, 10) as best, round(top_m, 10) as top_m, round(coverage, 10) as coverage, round(0.55 * best + 0.25 * top_m + 0.20 * coverage, 10) as match from t")
def facet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.array(*[F.lit(float(w)) for w in (5, 4, 3, 2, 1, 5, 4, 3, 2, 1)])
    m = _facet_scores(spark, sf_dir).select("vec_id", scores.facet_match(F.col("scores"), weights, 0.2, 3).alias("m"))
    return m.select("vec_id", *[F.round(f"m.{c}", 10).alias(c) for c in ("best", "top_m", "coverage", "match")])


@query(f"with {_FACETS} select vec_id, round((list_sort(scores, 'DESC')[1] + list_sort(scores, 'DESC')[2]) / 2, 8) as mean2 from s")
def two_best_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet_scores(spark, sf_dir).select("vec_id", F.round(top_mean(F.col("scores"), 2), 8).alias("mean2"))


@query(f"with {_FACETS} select vec_id, i - 1 as facet, scores[i] as score from (select vec_id, scores, unnest(range(1, 11)) as i, list_sort(list_transform(list_zip(scores, range(1, 11)), lambda z: {{'m': -z[1], 'i': z[2]}})) as o from s) where scores[i] >= 0.3 or o[1].i = i or o[2].i = i")
def coverage_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _facet_scores(spark, sf_dir).select("vec_id", F.explode(R.coverage_tags(F.col("scores"), 0.3, 2)).alias("t"))
    return tags.select("vec_id", F.col("t.facet").cast("long").alias("facet"), F.col("t.score").alias("score"))


@query(None)
def mmr_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + F.abs(x)).alias("score"))
    return R.mmr(rows, "label", "vec_id", "score", "embedding", k=10)


@query(None)
def xquad_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facet_scores(spark, sf_dir).select("vec_id", (F.col("vec_id") % 4).alias("chapter"), F.array_max("scores").alias("base"), "scores")
    return R.xquad(rows, "chapter", "vec_id", "base", "scores", limit=12, trade=0.3)


@query("""
    with c as (select o_orderkey, o_totalprice / greatest(1, 2002 - year(o_orderdate) + 1) as per_year, year(o_orderdate) as year, o_orderpriority like '1%' as review, o_orderstatus = 'P' as core from orders),
    p as (select *, count(*) over (order by per_year range unbounded preceding) / (count(*) over () + 1) as percentile from c)
    select o_orderkey, round(least(greatest(0.85 * percentile + 0.15 / (1 + exp(-(year - 1997) / 2)) + 0.05 * review::int + 0.03 * core::int, 0), 1), 6) as authority from p
""")
def authority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    scored = authority(rows, "o_totalprice", "year", 2002, F.col("o_orderpriority").like("1%"), F.col("o_orderstatus") == "P")
    return scored.select("o_orderkey", F.round("authority", 6).alias("authority"))


@query(f"""
    with {BM25}, lex as (select item_id, doc_id, 'lexical' as lane, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as lane_rank from bm25 qualify lane_rank <= 50),
    v as (select vec_id, embedding::double[] as x from embeddings),
    den as (select b.item_id, d.vec_id as doc_id, 'dense' as lane, row_number() over (partition by b.item_id order by round(list_dot_product(q.x, d.x), 6) desc, d.vec_id) as lane_rank from benchmark b join v q on q.vec_id = b.item_id, v d where round(list_dot_product(q.x, d.x), 6) >= 0.05 qualify lane_rank <= 50),
    f as (select item_id, doc_id, sum(case lane when 'lexical' then 1.0 else 0.8 end / (60 + lane_rank)) as fused, count(*) as lanes from (from lex union all from den) group by all)
    select item_id, doc_id, round(fused, 9) as fused, lanes, row_number() over (partition by item_id order by round(fused, 9) desc, doc_id) as rank from f qualify rank <= 10
""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25 and vector lanes for every benchmark item, fused by reciprocal ranks."""
    lexical = R.ranked(_bm25(spark, sf_dir).withColumn("score", F.round("score", 9)), ["item_id"], "score", ["doc_id"], 50, "lane_rank").withColumn("lane", F.lit("lexical"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    views = table(spark, sf_dir, "benchmark").select("item_id").join(vectors.select(F.col("doc_id").alias("item_id"), "vector"), "item_id")
    dense = R.dense_lane(vectors, views, "doc_id", "item_id", -2.0).withColumn("score", F.round("score", 6)).filter("score >= 0.05")
    dense = R.ranked(dense, ["item_id"], "score", ["doc_id"], 50, "lane_rank").withColumn("lane", F.lit("dense"))
    weight = F.when(F.col("lane") == "lexical", 1.0).otherwise(0.8)
    fused = R.reciprocal_rank_fusion(lexical.unionByName(dense), ["item_id"], "doc_id", weight)
    out = fused.select("item_id", "doc_id", F.round("fused", 9).alias("fused"), F.size("lanes").cast("long").alias("lanes"))
    return R.ranked(out, ["item_id"], "fused", ["doc_id"], 10)
