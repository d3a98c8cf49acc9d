"""Entity resolution over records made from orders: several orders of a customer may be one work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, normalize_arxiv, normalize_doi
from ..operators import entities as E
from .base import query, table

RECORDS = """
    r as (select o_orderkey as rid, case when o_orderkey % 3 = 0 then 'https://doi.org/10.1234/W' || (o_custkey % 400) end as doi, case when o_orderkey % 4 = 1 then 'arXiv:2101.' || lpad((o_custkey % 300)::varchar, 5, '0') end as arxiv,
        case when o_orderkey % 7 = 2 then 'PMID ' || (o_custkey % 200) end as pmid, 'Work ' || (o_custkey % 900) || case when o_orderkey % 2 = 0 then ' - revised' else '' end as title, year(o_orderdate)::int as year,
        list_transform(range(0, o_custkey % 3), lambda i: 'Ann Author' || (o_custkey % 50 + i)) as authors, o_totalprice as citations, case when o_orderstatus = 'P' then true when o_orderstatus = 'F' then false end as is_core, o_orderpriority as provider from orders)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("rid"),
        F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/W"), text(c % 400))).alias("doi"),
        F.when(k % 4 == 1, F.concat(F.lit("arXiv:2101."), F.lpad(text(c % 300), 5, "0"))).alias("arxiv"),
        F.when(k % 7 == 2, F.concat(F.lit("PMID "), text(c % 200))).alias("pmid"),
        F.concat(F.lit("Work "), text(c % 900), F.when(k % 2 == 0, " - revised").otherwise("")).alias("title"),
        F.year("o_orderdate").alias("year"),
        F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (c % 3).cast("int")), lambda i: F.concat(F.lit("Ann Author"), text(c % 50 + i))).alias("authors"),
        F.col("o_totalprice").alias("citations"),
        F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "F", False).alias("is_core"),
        F.col("o_orderpriority").alias("provider"),
    )


_KEYS = """
    list_filter(['doi:' || lower(replace(doi, 'https://doi.org/', '')), 'arxiv:' || replace(lower(arxiv), 'arxiv:', ''), 'pmid:' || replace(pmid, 'PMID ', ''),
        'fallback:' || trim(regexp_replace(lower(title), '[^\\pL\\pN]+', ' ', 'g')) || '|' || year || '|' || coalesce(lower(string_split(authors[1], ' ')[-1]), '')], lambda k: k is not null)
"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = E.candidate_keys(*[F.col(c) for c in ("doi", "arxiv", "pmid", "title", "year", "authors")])
    return _records(spark, sf_dir).withColumn("keys", keys)


@query(f"with {RECORDS} select rid, array_to_string({_KEYS}, ' ; ') as keys from r")
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("rid", F.array_join("keys", " ; ").alias("keys"))


@query(f"""
    with {RECORDS} select lower(replace(doi, 'https://doi.org/', '')) as doi, min(rid) as first, count(*) as n, arg_max(title, (length(title), -rid)) as title, array_to_string(arg_max(authors, (len(authors), -rid)), ';') as authors, min(year) as year, max(citations) as citations,
        bool_or(is_core) as is_core, array_to_string(list_sort(list(distinct provider)), ';') as providers from r where doi is not null group by 1
""")
def candidate_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _records(spark, sf_dir).filter("doi is not null").groupBy(normalize_doi(F.col("doi")).alias("doi")).agg(*E.merged_fields("rid"))
    return merged.withColumn("authors", F.array_join("authors", ";")).withColumn("providers", F.array_join("providers", ";"))


@query(f"""
    with recursive {RECORDS}, k as (select rid, unnest(keys) as key, generate_subscripts(keys, 1) as place from (select rid, {_KEYS} as keys from r)), f as (select key, min(rid) as first from k group by 1),
        step as (select rid, arg_min(first, place) as next from k join f using (key) where first < rid group by 1),
        c as (select rid, rid as cluster from r where rid not in (select rid from step) union all select step.rid, c.cluster from step join c on step.next = c.rid)
    select rid, cluster from c
""")
def candidate_dedupe_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_online(_keyed(spark, sf_dir), "rid", "keys")


@query(f"with {RECORDS} select rid, coalesce(lower(replace(doi, 'https://doi.org/', '')), 'arxiv:' || replace(lower(arxiv), 'arxiv:', ''), 'pmid:' || replace(pmid, 'PMID ', ''), 'cand_' || substring(sha256(title || chr(10) || year), 1, 16)) as id from r")
def candidate_final_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmid = F.nullif(F.regexp_extract("pmid", "[0-9]+", 0), F.lit(""))
    return _records(spark, sf_dir).select("rid", E.final_id(normalize_doi(F.col("doi")), normalize_arxiv(F.col("arxiv")), pmid, content_id(16, F.col("title"), F.col("year").cast("string"))).alias("id"))
