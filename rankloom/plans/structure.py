"""Headings and judged sections; parts stand for headings of the document that their brand names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.records import is_atomic_exclusion
from ..operators import structure as S
from .base import query, table

_TITLES = ["2.1 Data and methods", "results of it", "ok", "***", "Proceedings vol. 3", "1. A. B. Smith", "Growth of 12%", "A 1234 5678", "Table 3 values", "Discussion", "Chapter 4", "References"]


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.array(*map(F.lit, _TITLES))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.element_at(titles, (F.col("p_partkey") % len(_TITLES) + 1).cast("int")).alias("title"))


_H = f"h as (select p_partkey, p_size, ({_TITLES!r})[1 + p_partkey % {len(_TITLES)}] as title from part)"


@query(f"""
    with {_H}, k as (select *, trim(regexp_replace(lower(title), '[^\\pL\\pN]+', ' ', 'g')) as key, regexp_matches(title, '^([0-9]+(\\.[0-9]+)*\\.?|[IVXLC]+\\.|[A-Z]\\.)\\s') as numbered from h)
    select p_partkey, case when key = '' then 'empty' when length(title) < 3 then 'too_short' when regexp_matches(title, '^\\p{{Ll}}') and not numbered then 'starts_lowercase' when p_size >= 45 and p_partkey % 2 = 0 then 'repeated_page_header'
        when regexp_matches(title, '(->|<-|=|<|>|@|\\bvol\\.|\\bno\\.|issn|isbn|doi:)', 'i') then 'metadata_or_table_signal' when regexp_matches(title, '^[0-9]+\\.\\s+([A-Z]\\.\\s*){{1,4}}[A-Z]') then 'reference_entry_signal' when regexp_matches(title, '%') then 'formula_or_numeric_signal'
        when length(regexp_replace(title, '[^0-9]', '', 'g')) >= greatest(3, ceil(length(title) * 0.18)) and not numbered then 'digit_heavy' when regexp_full_match(key, '{S.KNOWN_NOISE}') then 'known_noise_pattern' end as reason from k
""")
def noise_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headings(spark, sf_dir).select("p_partkey", S.noise_reason(F.col("title"), F.col("p_partkey") % 2 == 1, F.when(F.col("p_size") >= 45, 3).otherwise(0)).alias("reason"))


@query(f"""
    with {_H} select p_partkey, array_to_string(list_filter([case when p_size <= 15 then 'near_empty_section' end, case when title = 'References' then 'suppressed_type' end, case when title = 'Chapter 4' and (p_partkey % 3 > 0 or p_size <= 120) then 'part_or_chapter_wrapper' end,
        case when p_partkey % 3 > 0 and p_size < 40 and title not in ('References', 'Discussion', 'results of it', '2.1 Data and methods') then 'tiny_parent_wrapper' end], lambda r: r is not null), ',') as reasons from h
""")
def wrapper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("title").isin("Discussion", "results of it", "2.1 Data and methods"), "other").otherwise(T.section_type(F.col("title")))
    found = S.wrapper_reasons(F.col("title"), kind, F.col("p_size"), F.lit(1), F.col("p_partkey") % 3)
    return _headings(spark, sf_dir).select("p_partkey", F.array_join(found, ",").alias("reasons"))


@query(None)
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    blocks = parts.select("p_brand", F.col("p_partkey").alias("block"), F.col("p_size").alias("page"), F.concat_ws(" ", "p_type", "p_name").alias("said"))
    proposals = parts.select("p_brand", F.col("p_partkey").alias("proposal"), (F.col("p_size") + F.col("p_partkey") % 3).alias("page"), F.col("p_type").alias("title"))
    return S.anchor_headings(proposals, blocks, "p_brand")


@query(None)
def truth_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with odd keys stand for the judged sections of their brand, the others for the produced ones."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", T.normalize_title(F.col("p_type")).alias("title"), "p_size")
    truth = parts.filter("p_partkey % 2 = 1").select("p_brand", F.col("p_partkey").alias("truth"), F.col("title").alias("a"), F.col("p_size").alias("page"))
    produced = parts.filter("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("produced"), F.col("title").alias("b"), F.col("p_size").alias("at"))
    return S.matched_sections(truth, produced, "p_brand")


_QUERIES = ["climate NOT (policy OR \"trade law\")", "water/energy systems", "a/b/c and \"x/y\"", "NOT \"one two three four\" z", "see http://a.b/c", "plain"]


@query("""
    select s_suppkey, case s_suppkey % 6 when 1 then '(water OR energy) systems' when 2 then '(a OR b OR c) and "x/y"' when 0 then 'climate NOT (policy OR "trade law")' when 3 then 'NOT "one two three four" z' when 4 then 'see http://a.b/c' else 'plain' end as rewritten,
        case s_suppkey % 6 when 0 then 'trade law,policy' when 3 then 'one two three four' else '' end as excluded, s_suppkey % 6 <> 3 as atomic from supplier
""")
def query_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(*map(F.lit, _QUERIES)), (F.col("s_suppkey") % len(_QUERIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", q.alias("q")).withColumn("terms", S.exclusion_terms(F.col("q")))
    return rows.select("s_suppkey", S.expand_slashes(F.col("q")).alias("rewritten"), F.array_join("terms", ",").alias("excluded"), F.forall("terms", is_atomic_exclusion).alias("atomic"))
