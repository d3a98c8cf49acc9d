"""Usage, cost and ledger queries; events stand for operations, orders for priced runs, customers for users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import money, stats
from .base import query, table

MONEY = "decimal(38,4)"


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "ts", "user_id", F.col("event_type").alias("op"), F.col("value").cast(MONEY).alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


OPS = "ops as (select event_id, ts, user_id, event_type as op, cast(value as decimal(38,4)) as cost, cast(json_extract(props, '$.k') as bigint) as tokens from events)"


@query(f"with {OPS} select op, count(*) as n, cast(sum(cost) as double) as cost, round(cast(sum(cost) as double) / count(*), 6) as mean_cost, sum(tokens)::bigint as tokens from ops group by op")
def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.sum("cost").cast("double")
    return _operations(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), cost.alias("cost"), F.round(cost / F.count("*"), 6).alias("mean_cost"), F.sum("tokens").alias("tokens"))


@query("""
    with m as (select strftime(unnest(generate_series(date '2001-03-01', date '2001-10-01', interval 1 month)), '%Y-%m') as month),
    t as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, sum(cast(o_totalprice as decimal(38,4))) as cost from orders group by 1)
    select m.month, coalesce(n, 0) as n, cast(coalesce(cost, 0) as double) as cost from m left join t using (month)
""")
def usage_by_month_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("cost"))
    return stats.dense(totals, stats.months(spark, "2001-03", "2001-10"), "month", ["n", "cost"])


@query(f"""
    with {OPS}, d as (select *, strftime(ts, '%Y-%m-%d') as day, case when tokens % 2 = 0 then 'even' else 'odd' end as model from ops)
    select coalesce(case when grouping(op) = 0 then 'op' end, case when grouping(day) = 0 then 'day' end, 'model') as dimension,
        coalesce(op, day, model) as key, count(*) as n, cast(sum(cost) as double) as cost from d group by grouping sets ((op), (day), (model))
""")
def usage_breakdowns_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _operations(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("model", F.when(F.col("tokens") % 2 == 0, "even").otherwise("odd"))
    return stats.breakdowns(rows, ["op", "day", "model"], {"n": F.count("*"), "cost": F.sum("cost").cast("double")})


@query(f"with {OPS} select coalesce(case when op in ('click', 'view') then op else 'other' end, 'total') as stage, count(*) as n, cast(sum(cost) as double) as cost from ops group by rollup (case when op in ('click', 'view') then op else 'other' end)")
def usage_total_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _operations(spark, sf_dir).withColumn("stage", F.when(F.col("op").isin("click", "view"), F.col("op")).otherwise("other"))
    return staged.rollup("stage").agg(F.count("*").alias("n"), F.sum("cost").cast("double").alias("cost")).withColumn("stage", F.coalesce("stage", F.lit("total")))


@query("select c_custkey, c_name, n, cost from (select o_custkey as c_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(38,4))) as double) as cost from orders group by 1 order by cost desc, c_custkey limit 25) left join customer using (c_custkey)")
def top_users_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("cost"))
    top = totals.orderBy(F.desc("cost"), "c_custkey").limit(25)
    # at most 25 rows are broadcast; the users are scanned once
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(F.broadcast(top), "c_custkey", "right").select("c_custkey", "c_name", "n", "cost")


@query("""
    with t as (select l_suppkey, count(*) as n, sum(cast(l_extendedprice as decimal(38,4))) as cost from lineitem where l_suppkey % 3 <> 0 group by 1)
    select coalesce(s_suppkey, l_suppkey) as project, coalesce(s_name, 'project ' || l_suppkey) as name, coalesce(n, 0) as n, cast(coalesce(cost, 0) as double) as cost
    from (select * from supplier where s_suppkey % 5 <> 0) s full join t on s_suppkey = l_suppkey
""")
def cost_by_project_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 <> 0").select("s_suppkey", "s_name")
    totals = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 0").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("cost"))
    both = names.join(totals, F.col("s_suppkey") == F.col("l_suppkey"), "full")
    return both.select(F.coalesce("s_suppkey", "l_suppkey").alias("project"), F.coalesce("s_name", F.concat(F.lit("project "), F.col("l_suppkey").cast("string"))).alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query(f"with {OPS}, c as (select ts, event_id from ops where event_id = 77) select event_id, op, cast(cost as double) as cost from ops where (ts, event_id) < (select (ts, event_id) from c) order by ts desc, event_id desc limit 50")
def ops_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations = _operations(spark, sf_dir)
    cursor = operations.filter("event_id = 77").select(F.col("ts").alias("at"), F.col("event_id").alias("after"))
    return money.keyset_page(operations, cursor, "ts", "event_id", 50).select("event_id", "op", F.col("cost").cast("double").alias("cost"))


@query(f"with {OPS} select event_id, user_id, op, cast(cost as double) as credits from ops where op not in ('click', 'view') order by ts desc, event_id desc limit 100")
def ledger_non_usage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _operations(spark, sf_dir).filter(~F.col("op").isin("click", "view"))
    return ledger.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "op", F.col("cost").cast("double").alias("credits"))


@query(f"with {OPS} select event_id, user_id, cast(sum(case when op = 'purchase' then cost else -cost / 4 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as double) as balance from ops")
def balance_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("op") == "purchase", F.col("cost")).otherwise(-F.col("cost") / 4)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _operations(spark, sf_dir).select("event_id", "user_id", F.sum(signed).over(order).cast("double").alias("balance"))


@query(f"""
    with {OPS}, d as (select event_id, user_id, cost, sum(cost) over (partition by user_id order by ts, event_id rows unbounded preceding) as spent, case when user_id % 4 = 0 then 0 else 1000 end as subscription, 500 as topup from ops)
    select event_id, user_id, cast(greatest(subscription - spent, 0) as double) as subscription_left, cast(topup - greatest(spent - subscription, 0) as double) as topup_left,
        cast(greatest(least(subscription - (spent - cost), cost), 0) as double) as from_subscription from d
""")
def balance_debit_two_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    debits = _operations(spark, sf_dir).withColumn("subscription", F.when(F.col("user_id") % 4 == 0, 0).otherwise(1000)).withColumn("topup", F.lit(500))
    return money.debit_two_buckets(debits, "user_id", ["ts", "event_id"], "cost").select("event_id", "user_id", *[F.col(c).cast("double").alias(c) for c in ("subscription_left", "topup_left", "from_subscription")])


@query(f"""
    with {OPS}, r as (select user_id, case when event_id % 3 = 0 then null else greatest(cost, 0) end as cost, case when event_id % 3 = 1 then null else greatest(cost * 2, 0) end as credits from ops)
    select user_id, cast(sum(coalesce(credits, cost * 2)) as double) as credits, cast(sum(coalesce(cost, credits / 2)) as double) as cost from r group by user_id
""")
def credits_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _operations(spark, sf_dir).select("user_id", F.when(F.col("event_id") % 3 != 0, F.col("cost")).alias("cost"), F.when(F.col("event_id") % 3 != 1, F.col("cost") * 2).alias("credits"))
    filled = money.backfill_credits(given, rate=2)
    return filled.groupBy("user_id").agg(F.sum("credits").cast("double").alias("credits"), F.sum("cost").cast("double").alias("cost"))


@query("""
    with q as (select l_suppkey as query, l_returnflag as provider, count_if(l_quantity > 45) as n from lineitem group by 1, 2)
    select provider, count(*) as queries, round(count_if(n = 0) / count(*), 6) as zero_rate, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.9) as p90, max(n) as most, round(max(n) / sum(n), 6) as dominance from q group by provider
""")
def provider_query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query"), F.col("l_returnflag").alias("provider")).agg(F.count_if(F.col("l_quantity") > 45).alias("n"))
    n = F.col("n")
    return counts.groupBy("provider").agg(F.count("*").alias("queries"), F.round(F.count_if(n == 0) / F.count("*"), 6).alias("zero_rate"), F.round(F.avg(n), 6).alias("mean"), stats.fixed_percentile(n, 0.5).alias("median"), stats.fixed_percentile(n, 0.9).alias("p90"), F.max(n).alias("most"), F.round(F.try_divide(F.max(n), F.sum(n)), 6).alias("dominance"))


@query("""
    with s as (select l_returnflag, list_sort(list(l_extendedprice)) as v, avg(l_extendedprice) as mean from lineitem group by 1)
    select l_returnflag, len(v) as n, round(mean, 4) as mean, v[1] as least, v[-1] as most, v[cast(round_even((len(v) - 1) * 0.5, 0) as bigint) + 1] as p50, v[cast(round_even((len(v) - 1) * 0.9, 0) as bigint) + 1] as p90, v[cast(round_even((len(v) - 1) * 0.99, 0) as bigint) + 1] as p99 from s
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("select l_linestatus, quantile_disc(l_quantity, 0.5) as p50, quantile_disc(l_quantity, 0.9) as p90, quantile_disc(l_quantity, 1.0) as p100 from lineitem group by 1")
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*[stats.fixed_percentile(x, q, "rank").alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p100", 1.0))])


@query("""
    with b as (select least(greatest(floor((o_totalprice - 0) / (400000.0 / 20)), 0), 19)::int as bin, count_if(o_orderstatus = 'F') as with_abstract, count_if(o_orderstatus <> 'F') as without_abstract from orders group by 1)
    select i::int as bin, coalesce(with_abstract, 0) as with_abstract, coalesce(without_abstract, 0) as without_abstract from range(20) t(i) left join b on b.bin = i
""")
def hist_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select("o_orderstatus", stats.uniform_bin(F.col("o_totalprice"), 20, 0.0, F.lit(400000.0)).alias("b"))
    return stats.histogram(spark, values, "b", {"with_abstract": F.col("o_orderstatus") == "F", "without_abstract": F.col("o_orderstatus") != "F"}, 20)


@query("""
    with t as (select (n_chars // 1000) * 1000 as edge, count_if(lang = 'en') as en, count_if(lang <> 'en') as other from documents group by 1)
    select e as edge, coalesce(en, 0) as en, coalesce(other, 0) as other from generate_series(0::bigint, (select max(edge) from t), 1000::bigint) g(e) left join t on t.edge = e
""")
def hist_binwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").select((F.floor(F.col("n_chars") / 1000) * 1000).alias("edge"), "lang")
    counts = lengths.groupBy("edge").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"))
    axis = counts.agg(F.max("edge").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(1000).cast("long"))).alias("edge"))
    return stats.dense(counts, axis, "edge", ["en", "other"])


@query("""
    with x as (select log10(1 + o_totalprice) as v, o_orderstatus from orders), h as (select greatest(1, max(v)) as high from x),
    b as (select least(greatest(floor(v / (high / 10)), 0), 9)::int as bin, count(*) as n from x, h group by 1)
    select i::int as bin, coalesce(n, 0) as n from range(10) t(i) left join b on b.bin = i
""")
def log10_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select(F.log10(1 + F.col("o_totalprice")).alias("v"))
    high = x.agg(F.greatest(F.lit(1.0), F.max("v")).alias("high"))
    binned = x.join(F.broadcast(high)).select(stats.uniform_bin(F.col("v"), 10, 0.0, F.col("high")).alias("b"))
    return stats.histogram(spark, binned, "b", {"n": F.lit(True)}, 10)


@query("""
    with t as (select case when n >= 8 then '8+' else n::varchar end as tags, count(*) as rows from (select o_custkey, count(*) as n from orders group by 1) group by 1)
    select a.tags, coalesce(rows, 0) as rows from (select case when i = 8 then '8+' else i::varchar end as tags from range(9) r(i)) a left join t using (tags)
""")
def count_overflow_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    bucket = lambda c: F.when(c >= 8, F.lit("8+")).otherwise(c.cast("string"))
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy(bucket(n).alias("tags")).agg(F.count("*").alias("rows"))
    return stats.dense(counts, spark.range(9).select(bucket(F.col("id")).alias("tags")), "tags", ["rows"])


@query("select l_suppkey as facet, count(*) as n, arg_min(l_returnflag, (l_orderkey, l_linenumber)) as label from lineitem group by 1 order by n desc, facet limit 15")
def facet_frequency_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("facet")).agg(F.count("*").alias("n"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber")).alias("label"))
    return counts.orderBy(F.desc("n"), "facet").limit(15)


@query("select year(o_orderdate)::int as year, count_if(o_orderstatus = 'F') as f, count_if(o_orderstatus = 'O') as o, count_if(o_orderstatus = 'P') as p from orders group by 1")
def year_pool_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return pivoted.select("year", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query(f"""
    with {OPS}, c as (select op, tokens % 3 as model, count(*) as n, sum(cost) as cost from ops group by 1, 2)
    select op, sum(n)::bigint as n, cast(sum(cost) as double) as cost, string_agg(model || '=' || n, ',' order by model) as models from c group by op
""")
def operations_with_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _operations(spark, sf_dir).groupBy("op", (F.col("tokens") % 3).alias("model")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    pairs = F.array_sort(F.collect_list(F.struct("model", "n")))
    return inner.groupBy("op").agg(F.sum("n").alias("n"), F.sum("cost").cast("double").alias("cost"), F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p.model.cast("string"), p.n.cast("string"))), ",").alias("models"))


@query("select o_orderpriority, count(*) as n, min(o_totalprice) as least, max(o_totalprice) as most, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as deviation, round(avg(abs(o_totalprice - 150000)), 4) as disagreement from orders group by 1")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("deviation"), F.round(F.avg(F.abs(x - 150000)), 4).alias("disagreement"))


@query("""
    with i as (select o_custkey, bool_or(o_orderpriority like '1%') as a, bool_or(o_orderpriority like '5%') as m from orders group by 1)
    select case when a and m then 'both' when a then 'authority_only' when m then 'match_only' else 'none' end as intent, count(*) as n from i group by 1
""")
def intent_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("intents"))
    a, m = F.array_contains("intents", "1"), F.array_contains("intents", "5")
    return intents.groupBy(F.when(a & m, "both").when(a, "authority_only").when(m, "match_only").otherwise("none").alias("intent")).agg(F.count("*").alias("n"))


@query("""
    with g as (select l_shipmode_group, fingerprint, count(*) as n from (select l_suppkey % 7 as l_shipmode_group, l_returnflag || l_linestatus as fingerprint from lineitem) group by 1, 2)
    select l_shipmode_group as query_group, round(max(n) / sum(n), 6) as top_share, max(n) / sum(n) <= 0.75 as within_budget from g group by 1
""")
def share_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("query_group"), F.concat("l_returnflag", "l_linestatus").alias("fingerprint")).agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.groupBy("query_group").agg(F.round(share, 6).alias("top_share"), (share <= 0.75).alias("within_budget"))


@query("""
    with p as (select * from (values ('large', 0.002, 1), ('large-2024', 0.003, 0), ('lar', 0.001, 2), ('default', 0.0005, 9)) t(name, price, priority)),
    m as (select conv_id, turn, case conv_id % 4 when 0 then 'large' when 1 then 'large-2024' when 2 then 'largest' else 'small' end as model, length(text) // 4 as tokens from conversations),
    j as (select m.*, p.price, row_number() over (partition by conv_id, turn order by case when p.name = model then 0 when model like p.name || '%' then 1 else 2 end, length(p.name) desc) as k from m join p on p.name = model or model like p.name || '%' or p.name = 'default')
    select model, count(*) as n, sum(tokens)::bigint as tokens, cast(sum(cast(tokens as decimal(18,0)) * cast(price as decimal(10,6))) as double) as cost from j where k = 1 group by model
""")
def pricing_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.sql("select * from values ('large', 0.002), ('large-2024', 0.003), ('lar', 0.001), ('default', 0.0005) as t(name, price)")
    turns = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    used = turns.select("conv_id", "turn", F.when(k == 0, "large").when(k == 1, "large-2024").when(k == 2, "largest").otherwise("small").alias("model"), F.floor(F.length("text") / 4).alias("tokens"))
    priced = money.best_price(used, prices, "model")
    return priced.groupBy("model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens").cast("decimal(18,0)") * F.col("price").cast("decimal(10,6)")).cast("double").alias("cost"))
