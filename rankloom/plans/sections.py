"""Structure of documents: a conversation stands for a document's blocks, lines of an order for its headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sections as S
from .base import query, table


@query("""
    with s as (select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn) as section from conversations)
    select conv_id, section, min(turn) as first, max(turn) as last, count(*) as n_blocks from s group by all
""")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spans(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").withColumn("section", F.col("section").cast("long"))


HEADINGS = "h as (select conv_id, turn, (length(text) % 4 + 1)::int as level, role from conversations)"


@query(f"with {HEADINGS} select a.conv_id, a.turn, a.level, max(b.turn) as parent from h a left join h b on b.conv_id = a.conv_id and b.turn < a.turn and b.level < a.level group by all")
def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 4 + 1).alias("level"))
    return S.parents(headings, "conv_id", "turn", "level", 5)


@query(f"with {HEADINGS} select conv_id, turn, coalesce(turn > min(turn) filter (level = 4) over (partition by conv_id), false) as after from h")
def post_reference_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 4 + 1).alias("level"))
    return S.after_first(headings, "conv_id", "turn", F.col("level") == 4).select("conv_id", "turn", "after")


@query(f"with {HEADINGS}, p as (select a.conv_id, a.turn, max(b.turn) as parent from h a left join h b on b.conv_id = a.conv_id and b.turn < a.turn and b.level < a.level group by all) select h.conv_id, h.turn, count(p.turn) as children from h left join p on p.conv_id = h.conv_id and p.parent = h.turn group by all")
def children_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 4 + 1).alias("level"))
    counts = S.parents(headings, "conv_id", "turn", "level", 5).filter("parent is not null").groupBy("conv_id", F.col("parent").alias("turn")).agg(F.count("*").alias("children"))
    return headings.join(counts, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("children", F.lit(0)).alias("children"))


@query("""
    select lower(trim(split_part(line, '.', 1))) as heading, count(distinct doc_id) as documents, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(line) between 3 and 40 group by 1 having count(distinct doc_id) > 1
""")
def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(3, 40))
    counts = lines.groupBy(F.lower(F.trim(F.substring_index("line", ".", 1))).alias("heading")).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("n"))
    return counts.filter("documents > 1")


@query(None)
def passages_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.packed_passages(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "passage", F.md5("text").alias("digest"))


@query(None)
def abstract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overlapping_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk", F.md5("text").alias("digest"))
