"""Text functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import money
from .base import query, table

_FOLD = f"regexp_replace(translate(text, '{T.MARKED}', '{T.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"


@query(f"""
    select doc_id, len(regexp_extract_all(text, '[\\pL\\pN_]+'))::int as words, len(regexp_extract_all(text, '[^\\s]+'))::int as chunks,
        round(coalesce(length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) / nullif(length(text), 0), 0), 6) as alnum, length({_FOLD})::int as folded,
        case when length(text) <= 80 then text else rtrim(substring(text, 1, 79), ' ') || '…' end as short
    from documents
""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words(x).alias("words"), T.count_chunks(x).alias("chunks"), F.round(T.alnum_ratio(x), 6).alias("alnum"), F.length(T.ascii_fold(x)).alias("folded"), T.truncate(x, 80).alias("short"))


@query(f"""
    with t as (select doc_id, list_filter(regexp_extract_all(lower({_FOLD}), '[a-z0-9]{{2,}}'), lambda t: t not in ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})) as terms from documents)
    select doc_id, len(terms)::int as n, len(list_distinct(terms))::int as n_distinct, md5(array_to_string(terms, ' ')) as digest from t
""")
def ascii_fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").alias("n"), F.size(F.array_distinct("terms")).alias("n_distinct"), F.md5(F.array_join("terms", " ")).alias("digest"))


def _unescaped(sql: str) -> str:
    for entity, character in T.ENTITIES.items():
        sql = f"replace({sql}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return sql


@query(f"""
    select page_id, md5(trim(regexp_replace({_unescaped("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '[\\s\\x0B]+', ' ', 'g'))) as digest, length(html)::int as n_html from pages
""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_html(F.col("html"))).alias("digest"), F.length("html").alias("n_html"))


@query("""
    with d as (select o_orderkey, case o_orderkey % 5 when 0 then 'https://doi.org/10.1234/AB.' || o_custkey when 1 then ' doi:10.55555/x' || o_custkey || '.' when 2 then 'http://dx.doi.org/10.1000/' || o_custkey when 3 then 'none' end as raw,
        case o_orderkey % 3 when 0 then 'arXiv:2101.' || lpad((o_custkey % 100000)::varchar, 5, '0') || 'v2' when 1 then 'hep-th/9901001' end as ax from orders)
    select o_orderkey, case when regexp_extract(b, '10\\.[0-9]{4,9}/\\S+') <> '' then rtrim(regexp_extract(b, '10\\.[0-9]{4,9}/\\S+'), '.,;') end as doi,
        nullif(regexp_extract(lower(ax), '([0-9]{4}\\.[0-9]{4,5}|[a-z-]+/[0-9]{7})(v[0-9]+)?', 1), '') as arxiv
    from (select *, lower(trim(regexp_replace(trim(raw), '^(https?://(dx\\.)?doi\\.org/|doi:)', '', 'i'))) as b from d)
""")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/AB."), c)).when(k == 1, F.concat(F.lit(" doi:10.55555/x"), c, F.lit("."))).when(k == 2, F.concat(F.lit("http://dx.doi.org/10.1000/"), c)).when(k == 3, "none")
    j = F.col("o_orderkey") % 3
    arxiv = F.when(j == 0, F.concat(F.lit("arXiv:2101."), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"), F.lit("v2"))).when(j == 1, "hep-th/9901001")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_doi(raw).alias("doi"), T.normalize_arxiv(arxiv).alias("arxiv"))


@query("""
    select p_partkey, trim(regexp_replace(lower(p_name), '[^\\pL\\pN]+', ' ', 'g')) as title, substring(regexp_replace(regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64) as slug,
        substring(sha256(trim(p_name) || chr(10) || trim(p_brand)), 1, 12) as id, lower(string_split(p_name, ' ')[-1]) as lastname,
        list_contains(string_split(lower(p_type), ' '), 'steel') as steel, len(list_filter(['brass', 'tin', 'small'], lambda t: contains(lower(p_type), t)))::int as hits
    from part
""")
def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.normalize_title(name).alias("title"),
        T.slugify(F.concat_ws(" & ", kind, "p_brand")).alias("slug"),
        T.content_id(12, name, F.col("p_brand")).alias("id"),
        T.first_author_lastname(F.array(name)).alias("lastname"),
        T.contains_term(kind, F.lit("Steel")).alias("steel"),
        T.terms_hit(kind, F.array(*map(F.lit, ("brass", "tin", "small")))).alias("hits"),
    )


_HEADINGS = ["1. Introduction", "2.3 Related work", "Chapter 4: Methods and data", "IV. Results", "References", "A. Appendix", "Erratum to part one", "5.1.2 Discussion", "Fazit", "Some title"]


@query(f"""
    with h as (select p_partkey, ({_HEADINGS!r})[1 + p_partkey % 10] as title from part),
    s as (select *, trim(regexp_replace(regexp_replace(trim(title), '^(chapter|part|kapitel|teil)\\s+[0-9ivxlc]+[.:]?\\s+', '', 'i'), '^([0-9]+(\\.[0-9]+)*\\.?|[IVXLC]+\\.|[A-Z]\\.)\\s+', '')) as bare from h)
    select p_partkey, bare, coalesce(nullif(len(string_split(regexp_extract(title, '^([0-9]+(\\.[0-9]+)*)\\.?\\s', 1), '.')) * (regexp_extract(title, '^([0-9]+(\\.[0-9]+)*)\\.?\\s', 1) <> '')::int, 0), 1)::int as level,
        case {" ".join(f"when regexp_full_match(trim(regexp_replace(lower(bare), '[^a-z0-9]+', ' ', 'g')), '{w}') then '{n}'" for n, w in T.SECTION_TYPES.items())} else 'body_other' end as kind,
        regexp_matches(lower(title), '^({T.PARATEXT})\\b') as paratext, lower(title) in ({", ".join(f"'{g}'" for g in T.GENERIC_TITLES)}) or regexp_full_match(lower(title), '{T.NUMBERED_GENERIC}') as generic from s
""")
def section_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.array(*map(F.lit, _HEADINGS))
    h = table(spark, sf_dir, "part").select("p_partkey", F.element_at(titles, (F.col("p_partkey") % 10 + 1).cast("int")).alias("title"))
    t = F.col("title")
    return h.select("p_partkey", T.strip_numbering(t).alias("bare"), T.heading_level(t, F.lit(None).cast("int")).alias("level"), T.section_type(t).alias("kind"), T.is_paratext(t).alias("paratext"), T.is_generic_title(t).alias("generic"))


def _hits(words: list[str]) -> str:
    return " + ".join(f"(length(s) - length(replace(s, ' {w} ', ''))) / {len(w) + 2}" for w in words)


@query(f"""
    with s as (select doc_id, ' ' || lower({_FOLD}) || ' ' as s from documents), c as (select doc_id, {_hits(T.ENGLISH_WORDS)} as en, {_hits(T.GERMAN_WORDS)} as de from s)
    select doc_id, case when de > 1.2 * en then 'de' when en > 0 then 'en' else 'unknown' end as guess from c
""")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.language_guess(F.col("text")).alias("guess"))


@query("""
    with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as w from documents)
    select doc_id, i as chunk, md5(array_to_string(w[i * 180 + 1:i * 180 + 180], ' ')) as digest from (select doc_id, w, unnest(range(0, cast(ceil(len(w) / 180) as bigint))) as i from w)
""")
def passages_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"), 180)).alias("chunk", "said"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("said").alias("digest"))


@query("""
    with w as (select item_id, string_split(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ') as w from benchmark)
    select gram, count(*) as n, count(distinct item_id) as items from (select item_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) as gram from w where len(w) >= 2) group by gram
""")
def anchor_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(T.normalize_title(F.col("text")), " ")
    grams = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.ngrams(words, 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@query("""
    with t as (select unnest(['inonble', 'thrend', 'ations', 'der', 'onst', 'erthe']) as term), v as (select term, unnest(case when term like '%s' then [term, left(term, length(term) - 1)] else [term, term || 's'] end) as form from t)
    select term, form, count(*) filter (contains(' ' || trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) || ' ', ' ' || form || ' ')) as docs from v, documents group by all
""")
def term_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.sql("select explode(array('inonble', 'thrend', 'ations', 'der', 'onst', 'erthe')) as term").select("term", F.explode(T.plural_variants(F.col("term"))).alias("form"))
    # documents are split once; only their distinct words meet the terms
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(T.normalize_title(F.col("text")), " "))).alias("form"))
    counts = held.join(F.broadcast(terms.select("form").distinct()), "form").groupBy("form").agg(F.count("*").alias("docs"))
    return terms.join(counts, "form", "left").select("term", "form", F.coalesce("docs", F.lit(0)).alias("docs"))


@query("""
    with w as (select conv_id, turn, ((length(text) + 511) // 512) * 2 * 85 as image_tokens, greatest(length(text) - 100, 0) as fresh, least(length(text), 100) as cached from conversations)
    select conv_id, turn, image_tokens::bigint as image_tokens, round((fresh * 2500000 + cached * 1250000 + 500000000) / 1e12, 9) as cost from w
""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    cost = money.token_cost(n, F.least(n, F.lit(100)), F.lit(50), ("2.5", "1.25", "10"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", money.image_tokens(n, F.lit(1000)).alias("image_tokens"), F.round(cost, 9).alias("cost"))
