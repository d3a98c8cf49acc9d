"""Documents of the corpus as documents with a section for each paragraph, and the words of benchmark items as terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bridges as B
from .base import query, table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each line of a text; its title is the line's first sentence."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("section", "text"))
    kind = F.when(F.col("section") % 7 == 3, "references").otherwise("body_other")
    return lines.select("doc_id", "section", F.regexp_extract("text", "^[^.!?]*", 0).alias("title"), "text", kind.alias("kind"), (F.col("section") % 5 != 4).alias("eligible"))


_SECTIONS = """l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as section from documents),
    s as (select doc_id, section, trim(regexp_replace(regexp_extract(text, '^[^.!?]*'), '\\s+', ' ', 'g')) as title, trim(regexp_replace(text, '\\s+', ' ', 'g')) as body, section % 7 <> 3 and section % 5 <> 4 as fit from l)"""


@query(f"""
    with {_SECTIONS},
    t as (select doc_id, title, min(section) as pos from s where len(regexp_extract_all(title, '[\\pL\\pN_]+')) between 2 and 14 and length(title) <= 120 group by all),
    ts as (select doc_id, list(title order by pos, title) as titles from (select * from t qualify row_number() over (partition by doc_id order by pos, title) <= 8) group by 1),
    w as (select doc_id, section, array_to_string(string_split(body, ' ')[1:28], ' ') as cut from s where fit and len(regexp_extract_all(body, '[\\pL\\pN_]+')) >= 18),
    n as (select doc_id, case when length(cut) <= 180 then cut else rtrim(cut[1:179]) || '…' end as snippet, min(section) as pos from w group by all),
    ns as (select doc_id, list(snippet order by pos, snippet) as snippets from (select * from n qualify row_number() over (partition by doc_id order by pos, snippet) <= 2) group by 1)
    select doc_id, source, array_to_string(coalesce(titles, []), '|') as titles, array_to_string(coalesce(snippets, []), '|') as snippets from documents left join ts using (doc_id) left join ns using (doc_id)
""")
def bridge_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = B.bridge_inventory(documents, _sections(spark, sf_dir), "doc_id", ["section"])
    return found.select("doc_id", "source", F.array_join("section_titles", "|").alias("titles"), F.array_join("section_snippets", "|").alias("snippets"))


@query(f"""
    with {_SECTIONS},
    i as (select item_id, string_split(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ') as w from benchmark),
    known as (select distinct unnest(w) as k from i where item_id % 4 = 0),
    g as (select distinct k from (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) as k from i)),
    c as (select k, string_split(k, ' ') as w from g where k not in (from known)),
    v as (select k from c where w[1] not in ({_STOP}) and w[-1] not in ({_STOP})),
    b as (select doc_id, section, title, ' ' || trim(regexp_replace(lower(title), '[^\\pL\\pN]+', ' ', 'g')) || ' ' as t, ' ' || trim(regexp_replace(lower(body), '[^\\pL\\pN]+', ' ', 'g')) || ' ' as x from s),
    words as (select doc_id, section, title, t, x, unnest(list_distinct(list_concat(string_split(trim(t), ' '), string_split(trim(x), ' ')))) as word from b),
    m as (select k, doc_id, section, title, contains(t, ' ' || k || ' ') as titled, contains(x, ' ' || k || ' ') as texted from words join v on word = string_split(k, ' ')[1] where contains(t, ' ' || k || ' ') or contains(x, ' ' || k || ' ')),
    h as (select k as term, count(*) as section_hits, count(distinct doc_id) as doc_hits, count(*) filter (titled) as title_hits, count(*) filter (texted) as text_hits from m group by 1),
    e as (select k as term, array_to_string(list(title order by pos, title), '|') as example_titles from (from (select k, title, min({{'d': doc_id, 's': section}}) as pos from m where title <> '' group by k, title) qualify row_number() over (partition by k order by pos, title) <= 3) group by 1)
    select term, section_hits, doc_hits, title_hits, text_hits, coalesce(example_titles, '') as example_titles, round(4.0::double * doc_hits + 3.0::double * title_hits + 0.2::double * least(text_hits, 20) + case when contains(term, ' ') then 1 else 0 end, 6) as rank_score,
        row_number() over (order by doc_hits desc, title_hits desc, text_hits desc, length(term), term)::int as position
    from h left join e using (term) qualify position <= 12
""")
def heuristic_bridge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split(T.normalize_title(F.col("text")), " ").alias("w"))
    candidates = items.select(F.explode(F.concat("w", T.ngrams(F.col("w"), 2))).alias("term"))
    existing = items.filter("item_id % 4 = 0").select(F.explode("w").alias("term"))
    best = B.heuristic_bridge_terms(candidates, existing, _sections(spark, sf_dir), "doc_id", "section", ["case study"])
    return best.withColumn("example_titles", F.coalesce(F.array_join("example_titles", "|"), F.lit("")))
