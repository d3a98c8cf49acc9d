"""Headings of web pages: titles, first headings, links and short paragraphs are what several sources propose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import headings as H
from .base import query, table

_BLOCK = "<(?:h1|p)>(?:<b>)?([^<]+)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text blocks of every page; some are cut to a numbered heading or are a list of references."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1))).alias("block", "said"))
    words = lambda n: F.array_join(F.slice(F.split("said", " "), 1, n), " ")
    number = F.concat((F.floor(F.col("block") / 9) + 1).cast("string"), F.lit("."), (F.col("block") % 3).cast("string"), F.lit(" "))
    said = F.when(F.col("block") % 9 == 4, F.concat(number, words(4))).when(F.col("block") % 11 == 10, "References").otherwise(F.col("said"))
    return pages.select("doc", "block", said.alias("said"), words(4).alias("begin"))


def _display(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def _bare(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim({x}), '^(chapter|part|kapitel|teil)\\s+[0-9ivxlc]+[.:]?\\s+', '', 'i'), '^([0-9]+(\\.[0-9]+)*\\.?|[IVXLC]+\\.|[A-Z]\\.)\\s+', ''))"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({_fold(x)}), '[^a-z0-9]+', ' ', 'g'))"


def _loose(x: str) -> str:
    return f"coalesce(nullif({_key(_bare(x))}, ''), {_key(x)})"


def _kind(x: str) -> str:
    return "case " + " ".join(f"when regexp_full_match({_key(_bare(x))}, '({keys})') then '{name}'" for name, keys in T.SECTION_TYPES.items()) + " else 'body_other' end"


def _n(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _capital(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(1, ceil({_n(x)} / 2))"


_ORDER = "[" + ", ".join(f"'{s}'" for s in H.PRIORITIES) + "]"


@query(f"""
    with raw as (
        select page_id as doc, html, unnest(regexp_extract_all(html, '{_BLOCK}', 1)) as said, unnest(range(len(regexp_extract_all(html, '{_BLOCK}', 1)))) as block from pages
    ), b as (
        select doc, block, {_display(f"case when block % 9 = 4 then (block // 9 + 1) || '.' || block % 3 || ' ' || array_to_string(string_split(said, ' ')[1:4], ' ') when block % 11 = 10 then 'References' else said end")} as t, array_to_string(string_split(said, ' ')[1:4], ' ') as head from raw
    ), c as (
        select *, {_kind('t')} as kind, {_bare('t')} as bare, regexp_matches(t, '{H.NUMBERED}') as numbered, {_n('t')} as n, regexp_matches(t, '\\p{{Lu}}') and not regexp_matches(t, '\\p{{Ll}}') as upper from b
    ), h as (
        select doc, block, t as title, unnest(list_filter([
            case when numbered and {_n('bare')} <= 10 and not regexp_matches(t, '{H.CAPTION}') and not (bare like '%.' and {_n('bare')} >= 4) and ({_kind('bare')} <> 'body_other' or {_capital('bare')}) then 'numbered_gap_fill' end,
            case when kind in ({", ".join(f"'{s}'" for s in H.STRUCTURAL)}) then 'structural_gap_fill' end,
            case when n between 1 and 18 and length(t) <= 160 and (length(regexp_replace(t, '[^\\pL\\pN]', '', 'g')) / length(t) >= 0.5 or numbered) and not (t like '%.' and n > 6) and ({_capital('t')} or numbered or (upper and n <= 8) or kind <> 'body_other') then 'heuristic' end], lambda x: x is not null)) as source, false as fallback from c
    ), p as (
        select * from h
        union all select page_id, 0, regexp_extract(html, '<title>([^<]*)</title>', 1), 'outline', false from pages
        union all select doc, block, head, 'layout', false from b where block = 0 or block % 9 = 4
        union all select page_id, 2 * i, link, 'summary', i % 2 = 1 from (select page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)<', 1)) as link, unnest(range(len(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)<', 1)))) as i from pages)
    ), k as (
        select doc, block, {_display('title')} as title, source, fallback, list_position({_ORDER}, source) as rank, {_loose(_display('title'))} as key from p
    ), f as (
        select *, list_sort(list_distinct(list(source) over (partition by doc, block, key))) as sources, row_number() over (partition by doc, block, key order by rank, source, title) as n from k where key <> ''
    ), g as (
        select *, row_number() over (partition by doc, block order by rank, source, title) as place, first_value(fallback) over (partition by doc, block order by rank, source, title) as first_fallback from f where n = 1
    ), s as (
        select * from g where not (place > 1 and (fallback or first_fallback))
    ), w as (
        select *, coalesce(last_value(case when source <> 'heuristic' then block end ignore nulls) over (partition by doc order by block, rank rows between unbounded preceding and current row), -1) as before,
            first_value(case when source <> 'heuristic' then block end ignore nulls) over (partition by doc order by block, rank rows between current row and unbounded following) as after from s
    )
    select doc, block::int as block, title, source, coalesce(len(string_split(nullif(regexp_extract(title, '^([0-9]+(\\.[0-9]+){{0,4}})\\b', 1), ''), '.')), 1)::int as level, array_to_string(sources, ',') as sources from w
    where source <> 'heuristic' or ((after is null or after - before > 12) and block <> before and (after is null or block <> after))
""")
def heading_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "html")
    blocks = _blocks(spark, sf_dir)
    columns = ["doc", "block", "source", "title"]
    named = lambda rows, block, source, title: rows.select("doc", block.alias("block"), F.lit(source).alias("source"), title.alias("title"))
    outline = named(pages, F.lit(0), "outline", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    layout = named(blocks.filter("block = 0 or block % 9 = 4"), F.col("block"), "layout", F.col("begin"))
    links = pages.select("doc", F.posexplode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)<'), F.lit(1))).alias("i", "link"))
    summary = links.select("doc", (2 * F.col("i")).alias("block"), F.lit("summary").alias("source"), F.col("link").alias("title"), (F.col("i") % 2 == 1).alias("fallback"))
    plain = H.heuristic_proposals(blocks, "doc", "block", "said").select(columns).union(outline).union(layout).withColumn("fallback", F.lit(False))
    return H.merged_proposals(plain.unionByName(summary), "doc")


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for each block: its first words, its first line in other words, or all of it, and the block."""
    words = F.split("said", " ")
    part = lambda n: F.array_join(F.slice(words, 1, n), " ")
    block = F.concat(part(6), F.when(F.col("block") % 4 == 1, F.lit(": ")).when(F.col("block") % 4 == 2, F.lit("\n")).otherwise(". "), F.array_join(F.slice(words, 7, 40), " "))
    title = F.when(F.col("block") % 3 == 0, part(4)).when(F.col("block") % 3 == 1, F.concat(F.lit("x"), F.array_join(F.slice(words, 1, 6), " "))).otherwise(part(9))
    key = F.concat_ws("-", "doc", "block").alias("key")
    return _blocks(spark, sf_dir).select(key, title.alias("title"), block.alias("said"), F.when(F.col("block") == 0, "outline").otherwise("layout").alias("source"))


@query(None)
def title_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as their blocks have them, and how well the block holds the title that was proposed (character ratios are not SQL)."""
    fixed = H.repaired_titles(_proposed(spark, sf_dir), "key")
    scored = H.anchor_scores(fixed.withColumn("proposed", F.coalesce("original_title", "title")), "proposed", "said")
    return scored.select("key", "title", "original_title", "repair_score", F.round("score", 4).alias("score"))


@query(None)
def truth_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as an outline that names pages of three blocks each, checked against these pages' text and short blocks."""
    blocks = _blocks(spark, sf_dir).withColumn("page", (F.floor(F.col("block") / 3) + 1).cast("int"))
    pages = blocks.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "said"))), lambda b: b.said), "\n").alias("text"))
    visuals = blocks.filter(H.looks_like_heading(F.col("said"))).select("doc", "page", F.col("said").alias("title"))
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)<'), F.lit(1))).alias("entry", "title"))
    numbered = blocks.filter("block % 9 = 4").select("doc", (1000 + F.col("block")).alias("entry"), F.concat(F.col("begin"), F.lit("e")).alias("title"), "page")
    outline = links.select("doc", "entry", "title", (F.col("entry") % 5).cast("int").alias("page")).unionByName(numbered)
    return H.verified_outline(outline, pages, visuals, "doc")
