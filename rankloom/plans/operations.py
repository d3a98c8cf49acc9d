"""Calls, quality and telemetry: events stand for calls and records, documents with their lines for structured documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import migration, quality, telemetry
from ..operators.workspace import Workspace
from ..sources import lines
from ..streaming import calls, rollups
from .base import query, table

@query("""
    select event_type as stage, count(*) as call_count, sum(event_id % 900)::bigint as input_tokens, sum(event_id % 90)::bigint as cached_input_tokens, sum(event_id % 70)::bigint as output_tokens,
        round(sum(cast(value / 1000 as decimal(18, 8)))::double, 8) as cost_usd, sum(event_id % 900 + event_id % 70)::bigint as total_tokens from events group by 1
""")
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running summary after all events have been logged as calls, a few files at a time."""
    ws = Workspace(spark, "calls")
    cost = F.col("value") / 1000
    stream = rollups.read_events(spark, sf_dir, "events.parquet", 1).select(F.col("event_type").alias("stage"), (F.col("event_id") % 900).alias("input_tokens"), (F.col("event_id") % 90).alias("cached_input_tokens"), (F.col("event_id") % 70).alias("output_tokens"), cost.cast("decimal(18,8)").alias("cost_usd"))
    calls.append_calls(stream, f"{ws.path}/log", f"{ws.path}/checkpoint", ["stage"])
    return calls.running_summary(spark, f"{ws.path}/log", ["stage"]).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 8))


@query("""
    with n as (select event_type, event_id % 70 as amount from events order by ts desc, event_id desc limit 5000)
    select replace(event_type, 'e', 'E') as label, count(*) as n, sum(amount)::bigint as amount from n group by 1
""")
def log_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the newest 5,000 calls by type, page by page; the first scan is stopped after a page and another goes on."""
    ws = Workspace(spark, "backfill")
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    for stop in (1, None):
        calls.backfill(events, ws.path, ["ts", "event_id"], F.replace(F.col("event_type"), F.lit("e"), F.lit("E")), F.col("event_id") % 70, stop_after=stop)
    return calls.backfilled(spark, ws.path)


_STRUCTURED = """l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as n from documents),
    s as (select doc_id, doc_id || '-' || n as section_id, length(line) as size from l where length(line) >= 20),
    p as (select doc_id, doc_id || '-' || n as section_id from l where not (length(line) < 20 and doc_id % 3 = 0)),
    c as (select doc_id, count(*) as sections, sum(size) as size, count(*) filter (size < 60) as tiny_count from s group by 1),
    o as (select p.doc_id, count(*) as passages, count(*) filter (s.section_id is null) as orphans from p left join s using (section_id) group by 1),
    d as (select doc_id, coalesce(sections, 0) as sections, coalesce(passages, 0) as passages, coalesce(orphans, 0) as orphans, length(coalesce(text, '')) // 200 as page_count, coalesce(tiny_count, 0) as tiny_count, 100.0 * coalesce(size, 0) / greatest(length(coalesce(text, '')), 1) as coverage, doc_id % 7 = 0 as fallback, doc_id % 2 = 0 as refs from documents left join c using (doc_id) left join o using (doc_id))"""


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more are sections; of shorter ones some are passages all the same, which are orphans."""
    text = F.coalesce("text", F.lit(""))
    documents = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    named = lines.select("doc_id", F.concat_ws("-", "doc_id", "n").alias("section_id"), F.length("line").alias("size"))
    sections = named.filter("size >= 20")
    per = sections.groupBy("doc_id").agg(F.count("*").alias("section_count"), F.sum("size").alias("size"), F.count_if(F.col("size") < 60).alias("tiny_count"))
    summary = documents.join(per, "doc_id", "left").fillna(0, ["section_count", "size", "tiny_count"])
    summary = summary.select(
        "doc_id",
        "section_count",
        "tiny_count",
        F.floor(F.length("text") / 200).alias("page_count"),
        (F.lit(100.0) * F.col("size") / F.greatest(F.length("text"), F.lit(1))).alias("coverage"),
        (F.col("doc_id") % 7 == 0).cast("int").alias("fallback_count"),
        (F.col("doc_id") % 2 == 0).alias("has_references"),
    )
    return quality.structured_documents(summary, sections, named.filter("not (size < 20 and doc_id % 3 = 0)"))


_CHECKS = """k as (select *, [{'i': 0, 'c': 'sections_produced', 's': 'FAIL', 'ok': sections > 0}, {'i': 1, 'c': 'passages_produced', 's': 'FAIL', 'ok': passages > 0}, {'i': 2, 'c': 'orphan_passages', 's': 'FAIL', 'ok': orphans = 0},
        {'i': 3, 'c': 'coverage', 's': 'WARN', 'ok': coverage >= 60}, {'i': 4, 'c': 'single_section', 's': 'WARN', 'ok': not (sections <= 1 and page_count >= 10)}, {'i': 5, 'c': 'references', 's': 'WARN', 'ok': not (page_count >= 20 and not refs)},
        {'i': 6, 'c': 'fallback_anchors', 's': 'WARN', 'ok': not fallback}, {'i': 7, 'c': 'tiny_sections', 's': 'WARN', 'ok': not (page_count >= 20 and sections > 0 and tiny_count / greatest(sections, 1) >= 0.25)}] as checks from d),
    e as (select doc_id, unnest(checks) as c from k),
    x as (select c.i as place, c.c as "check", c.s as severity, count(*) filter (not c.ok) as broken, list(doc_id order by doc_id) filter (not c.ok) as bad from e group by all)"""


@query(f"""
    with {_STRUCTURED}, {_CHECKS}
    select place::int as place, "check", case when broken = 0 then 'OK' else severity end as status, broken, coalesce(array_to_string(bad[1:5], ', '), 'none') as examples from x
""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.expectation_rows(_structured(spark, sf_dir), "doc_id", quality.document_expectations()).drop("expected")


@query(f"""
    with {_STRUCTURED}, {_CHECKS}, t as (select coalesce(sum(broken) filter (severity = 'FAIL'), 0)::bigint as failures, coalesce(sum(broken) filter (severity = 'WARN'), 0)::bigint as warnings from x)
    select case when failures > 0 then 'failed' when warnings > 0 then 'success_with_warnings' else 'success' end as status, case when failures > 0 then 'insufficient' when warnings > 0 then 'acceptable_with_issues' else 'high' end as quality_band, failures = 0 as can_continue, failures, warnings, (select count(*) from documents) as documents from t
""")
def quality_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _structured(spark, sf_dir)
    return quality.assessment(quality.expectation_rows(documents, "doc_id", quality.document_expectations()), documents)


@query("""
    with r as (select event_type as provider, user_id as query_id, case when user_id % 2 = 0 then 'match' else 'authority' end as intent, case when event_id % 3 = 0 then 'de' else 'en' end as language, extract(hour from ts)::int as year, event_id % 11 = 0 as failed, case when user_id % 9 = 4 then 0 else event_id % 5 end as hits from events),
    q as (select provider, query_id, sum(hits)::bigint as hits from r group by all),
    p as (select provider, count(*) as n, sum(hits)::bigint as hits, round(count(*) filter (failed) / count(*), 6) as f, round(count(*) filter (hits = 0) / count(*), 6) as w from r group by 1),
    s as (select provider, round(avg(hits), 6) as mean, round(quantile_cont(hits, 0.5), 6) as p50, round(quantile_cont(hits, 0.9), 6) as p90 from q group by 1),
    i as (select provider, intent, language, count(*) as n, sum(hits)::bigint as hits from r group by all),
    y as (select provider, year, count(*) as n from r group by all),
    t as (select *, row_number() over (partition by provider order by hits desc, query_id) as top, row_number() over (partition by provider order by hits, query_id) as bottom from q),
    h as (select least(hits * 10 // greatest((select max(hits) from q), 1), 9) as bin, count(*) as n from q group by 1)
    select (select count(*) from r) as n, (select count(*) filter (failed) from r) as failed, (select sum(hits)::bigint from r) as hits,
        (select list([provider, n::varchar, hits::varchar] order by provider) from p) as providers, (select list([f, w, mean, p50, p90] order by p.provider) from p join s using (provider)) as shares,
        (select list(provider || ' ' || intent || ' ' || language || ' ' || n || ' ' || hits order by provider, intent, language) from i) as by_intent, (select list(provider || ' ' || year || ' ' || n order by provider, year) from y) as by_year,
        (select list(provider || ' ' || query_id || ' ' || hits order by provider, top) from t where top <= 10) as top_queries, (select list(provider || ' ' || query_id || ' ' || hits order by provider, bottom) from t where bottom <= 10) as bottom_queries,
        (select list(provider || ' ' || query_id order by provider, query_id) from (select * from q where hits = 0 qualify row_number() over (partition by provider order by query_id) <= 200)) as zero_queries,
        (select list(coalesce(n, 0)::bigint order by b) from range(10) as x(b) left join h on bin = b) as hits_histogram
""")
def run_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a run: types are providers, users queries, hours years."""
    e, u = F.col("event_id"), F.col("user_id")
    records = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"),
        u.alias("query_id"),
        F.when(u % 2 == 0, "match").otherwise("authority").alias("intent"),
        F.when(e % 3 == 0, "de").otherwise("en").alias("language"),
        F.hour("ts").alias("year"),
        (e % 11 == 0).alias("failed"),
        F.when(u % 9 == 4, 0).otherwise(e % 5).alias("hits"),
    )
    row = telemetry.telemetry(records)
    line = lambda c, *names: F.transform(c, lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in names])).alias(c)
    return row.select(
        "totals.*",
        F.transform("providers", lambda p: F.array(p.provider, p.n.cast("string"), p.hits.cast("string"))).alias("providers"),
        F.transform("providers", lambda p: F.array(p.failed_share, p.without_share, p.mean, p.p50, p.p90)).alias("shares"),
        line("by_intent", "provider", "intent", "language", "n", "hits"),
        line("by_year", "provider", "year", "n"),
        line("top_queries", "provider", "query_id", "hits"),
        line("bottom_queries", "provider", "query_id", "hits"),
        line("zero_queries", "provider", "query_id"),
        F.transform("hits_histogram", lambda h: h.n).alias("hits_histogram"),
    )


@query("select doc_id, lang, length(text) as size, md5(text) as digest from documents")
def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines in batches and read again by byte ranges."""
    ws = Workspace(spark, "lines")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines.write_line_documents(documents, ws.path)
    back = lines.read_line_documents(spark, ws.path, "doc_id long, lang string, text string", 1 << 20)
    return back.select("doc_id", "lang", F.length("text").alias("size"), F.md5("text").alias("digest"))


_ITEMS = migration.Level("items", "line", {"part": "r.partNo", "quantity": "cast(r.qty as double)", "title": "coalesce(r.title, 'untitled')"})
_ORDERS = migration.Level("orders", "id", {"archived": "r.state = 'F'", "archived_at": "case when r.state = 'F' then coalesce(r.archivedAt, r.updatedAt) end", "updated_at": "r.updatedAt"}, "items", _ITEMS)
_USERS = migration.Level("users", "id", {"name": "coalesce(r.name, '')", "owner": "coalesce(r.ownerId, r.id)"}, "orders", _ORDERS)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders and these with their items in one record each, in the old form."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    item = F.struct(F.when(F.col("n") % 5 != 0, F.col("n")).alias("line"), F.col("l_partkey").alias("partNo"), F.col("l_quantity").cast("string").alias("qty"))
    items = table(spark, sf_dir, "lineitem").withColumn("n", number).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x.item).alias("items"))
    order = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("date").alias("updatedAt"), "items")
    orders = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", order.alias("order")))).alias("all"))
    joined = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return joined.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.transform("all", lambda x: x.order).alias("orders"))


@query("""
    with o as (select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer)), i as (select o_orderkey from o join lineitem on l_orderkey = o_orderkey),
    c as (select 'users' as level, count(*) as n from customer union all select 'orders', count(*) from o union all select 'items', count(*) from i)
    select level, n as records, n as rows, 0::bigint as orphans, 0::bigint as missing from c
""")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = Workspace(spark, "migration").save(_nested(spark, sf_dir))
    return migration.migration_check(nested, migration.migrate(nested, _USERS), _USERS)


@query("""
    with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem)
    select c_custkey || '/' || o_orderkey || '/' || case when n % 5 = 0 then '#' || (n - 1) else n::varchar end as path, c_custkey || '/' || o_orderkey as parent, o_orderstatus = 'F' as archived, case when o_orderstatus = 'F' then o_orderdate::date::varchar end as archived_at,
        l_partkey as part, l_quantity::double as quantity, 'untitled' as title, case when c_custkey % 3 = 0 then '' else c_name end as name, c_custkey as owner
    from n join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
""")
def migrated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the new form with what their order and their user have there."""
    tables = migration.migrate(_nested(spark, sf_dir), _USERS)
    orders = tables["orders"].select(F.col("path").alias("parent"), F.col("parent").alias("user"), "archived", F.col("archived_at").cast("string").alias("archived_at"))
    users = tables["users"].select(F.col("path").alias("user"), "name", "owner")
    return tables["items"].join(orders, "parent").join(users, "user").select("path", "parent", "archived", "archived_at", "part", "quantity", "title", "name", "owner")
