"""Queries over event logs with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..operators.workspace import Workspace
from ..streaming import rollups
from .base import query, table


@query("""
    with recursive e as (select event_id, event_type as provider, epoch_us(ts) // 1000 as ms, row_number() over (partition by event_type order by ts, event_id) as i from events),
    r(provider, i, event_id, ms, reserved) as (select provider, i, event_id, ms, ms + 50 from e where i = 1 union all select e.provider, e.i, e.event_id, e.ms, greatest(e.ms + 50, case when r.reserved + 600000 > e.ms + 86400000 then e.ms else r.reserved + 600000 end) from r join e on e.provider = r.provider and e.i = r.i + 1)
    select event_id, provider, reserved, reserved - ms as wait from r
""")
def rate_limiter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return S.rate_limit(requests, "provider", "at", ["ts", "event_id"], 600_000, 50).select("event_id", "provider", "reserved", "wait")


@query("""
    with l as (select user_id, event_id % 40 as task, arg_max(case event_type when 'purchase' then 'success' when 'error' then 'failed' else 'running' end, (ts, event_id)) as s from events group by all)
    select user_id, count_if(s not in ('success', 'failed')) as pending, count_if(s = 'success') as succeeded, count_if(s = 'failed') as failed, count_if(s not in ('success', 'failed')) = 0 and count_if(s = 'failed') = 0 as done from l group by 1
""")
def task_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("running")
    events = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("task"), status.alias("status"), "ts", "event_id")
    return S.task_counters(events, "user_id", "task", "status", ["ts", "event_id"])


@query("""
    with recursive e as (select user_id || '-' || event_id % 7 as task, event_id, case when event_type = 'purchase' then 'complete' else 'claim' end as action, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id, event_id % 7 order by epoch_us(ts) // 1000, event_id) as i from events),
    r(task, i, event_id, status, claimed, outcome) as (select distinct task, 0::bigint, null::bigint, 'queued', null::bigint, null::varchar from e union all
        select task, i, event_id, case when outcome in ('claimed', 'reclaimed') then 'running' when outcome = 'completed' then 'success' else status end, case when outcome in ('claimed', 'reclaimed') then ms else claimed end, outcome
        from (select e.task, e.i, e.event_id, e.ms, r.status, r.claimed, case when r.status = 'success' then 'already_done' when e.action = 'claim' and r.status = 'queued' then 'claimed' when e.action = 'claim' and e.ms - r.claimed > 43200000 then 'reclaimed' when e.action = 'complete' and r.status = 'running' then 'completed' else 'refused' end as outcome from r join e on e.task = r.task and e.i = r.i + 1))
    select task, event_id, outcome from r where i > 0
""")
def task_lease_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "complete").otherwise("claim")
    events = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("task"), "event_id", action.alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return S.lease_replay(events, "task", ["at", "event_id"], 1_800_000 * 24).select("task", "event_id", "outcome")


@query("""
    with recursive e as (select user_id, event_id, event_id % 23 + 1 as op, event_type = 'purchase' as release, value as required, row_number() over (partition by user_id order by event_id) as i from events),
    r(user_id, i, event_id, available, held, done, outcome) as (select distinct user_id, 0::bigint, null::bigint, 100.0::double, list_transform(range(23), lambda x: null::double), list_transform(range(23), lambda x: false), null::varchar from e union all
        select user_id, i, event_id, available + case outcome when 'released' then held[op] when 'reserved' then -required else 0 end, list_transform(held, lambda h, k: case when k = op and outcome = 'released' then null when k = op and outcome = 'reserved' then required else h end), list_transform(done, lambda d, k: d or (k = op and outcome = 'released')), outcome
        from (select r.user_id, e.i, e.event_id, r.available, r.held, r.done, e.op, e.required, case when r.done[e.op] then 'finalized' when e.release then case when r.held[e.op] is null then 'unknown' else 'released' end when r.held[e.op] is not null then 'already_reserved' when r.available < e.required then 'blocked' else 'reserved' end as outcome from r join e on e.user_id = r.user_id and e.i = r.i + 1))
    select user_id, event_id, outcome, round(available, 6) as available from r where i > 0
""")
def credit_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "release").otherwise("reserve")
    requests = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 23).alias("operation"), kind.alias("kind"), F.col("value").alias("required"), F.lit(100.0).alias("balance"))
    return S.reservations(requests, "user_id", ["event_id"]).withColumn("available", F.round("available", 6))


@query("""
    with g as (select event_id % 5000 as grant_id, user_id % 50 as user_id, case when event_id % 5000 % 3 = 0 then 'subscription' else 'topup' end as kind, event_id % 5000 % 17 as credits, event_id % 5000 % 100 as period_end from events),
    o as (select grant_id, grant_id % 50 as user_id, any_value(kind) as kind, any_value(credits) as credits, any_value(period_end) as period_end from g group by grant_id)
    select user_id, sum(credits) filter (kind = 'topup')::bigint as topup, arg_max(credits, (period_end, grant_id)) filter (kind = 'subscription') as subscription from o group by user_id
""")
def grant_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("event_id") % 5000
    rows = table(spark, sf_dir, "events").select(g.alias("grant_id"), (g % 50).alias("user_id"), F.when(g % 3 == 0, "subscription").otherwise("topup").alias("kind"), (g % 17).alias("credits"), (g % 100).alias("period_end"))
    return S.grants(rows, "user_id", "grant_id")


@query("select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, cast(sum(cast(value as decimal(38,4))) as double) as cost from events group by all")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "rollup")
    events = rollups.read_events(spark, sf_dir, "events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    totals = rollups.rollup(events, ["event_type", "day"], {"n": F.count("*"), "cost": F.sum(F.col("value").cast("decimal(38,4)")).cast("double")})
    rollups.keep_table(totals, f"{ws.path}/table", f"{ws.path}/checkpoint")
    return spark.read.parquet(f"{ws.path}/table")
