"""Telemetry of a run as one nested row, ready for charts: every figure from one scan with grouping sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

PROVIDER, INTENT, YEAR, QUERY = ["provider"], ["provider", "intent", "language"], ["provider", "year"], ["provider", "query_id"]
NO_QUERY_LIST = 200


def figures(records: DataFrame) -> DataFrame:
    """Counts and sums of records (provider, query_id, intent, language, year, failed, hits) in all, by provider, by intent and language, by year and by
    query, in one scan; ``level`` tells which.

    Records are pre-combined in every task for each of the five sets.
    """
    sets = [[], PROVIDER, INTENT, YEAR, QUERY]
    keys = ["provider", "intent", "language", "year", "query_id"]
    added = [F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), F.count_if(F.coalesce("hits", F.lit(0)) == 0).alias("without")]
    level = F.concat(*[F.grouping(k).cast("string") for k in keys])
    rows = records.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(level.alias("level"), *added)
    names = {"".join("0" if k in s else "1" for k in keys): name for s, name in zip(sets, ["all", "provider", "intent", "year", "query"], strict=True)}
    named = reduce(lambda out, x: out.when(F.col("level") == x[0], x[1]), names.items(), F)
    return rows.withColumn("level", named)


def _listed(rows: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """One row with the rows' values as an array in order; the rows are few by then."""
    placed = rows.select(F.struct(F.struct(*order).alias("at"), value.alias("value")).alias("x"))
    return placed.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.value).alias(name))


def telemetry(records: DataFrame, top: int = 10, bins: int = 10) -> DataFrame:
    """One row: totals, providers, by_intent, by_year, top_queries, bottom_queries, zero_queries and hits_histogram as arrays of structs.

    Providers come with the shares of failed records and of those without hits, and mean, median and 90th percentile (interpolated) of hits by query. Queries are the ``top`` with
    most and with fewest hits of each provider (ties by id), and up to 200 without any. The histogram has ``bins`` equal bins from 0 to the most hits a query has.
    Without records there are totals of 0 and empty arrays.
    """
    base = Workspace(records.sparkSession, "telemetry").save(figures(records))
    queries = base.filter("level = 'query'")
    stats = queries.groupBy("provider").agg(F.avg("hits").alias("mean"), F.expr("percentile(hits, 0.5)").alias("p50"), F.expr("percentile(hits, 0.9)").alias("p90"))
    providers = base.filter("level = 'provider'").join(stats, "provider", "left")
    share = lambda c: F.round(F.col(c) / F.col("n"), 6).alias(f"{c}_share")
    provider = F.struct("provider", "n", "hits", share("failed"), share("without"), F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))

    def best(order: list[Column], most: int, rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(*order)))
        return placed.filter(F.col("place") <= most)

    query = F.struct("provider", "query_id", "hits")
    in_order = [F.col("provider"), F.col("place")]
    highest = queries.agg(F.greatest(F.max("hits"), F.lit(1)).alias("highest"))
    binned = queries.crossJoin(highest).withColumn("bin", F.least(F.floor(F.col("hits") * bins / F.col("highest")), F.lit(bins - 1)).cast("int"))  # one row
    counted = binned.groupBy("bin").agg(F.count("*").alias("n"))
    every = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = base.filter("level = 'all'").agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).alias("totals"))
    parts = [
        total,
        _listed(providers, provider, [F.col("provider")], "providers"),
        _listed(base.filter("level = 'intent'"), F.struct("provider", "intent", "language", "n", "hits"), [F.col(c) for c in INTENT], "by_intent"),
        _listed(base.filter("level = 'year'"), F.struct("provider", "year", "n"), [F.col(c) for c in YEAR], "by_year"),
        _listed(best([F.desc("hits"), F.col("query_id")], top, queries), query, in_order, "top_queries"),
        _listed(best([F.asc("hits"), F.col("query_id")], top, queries), query, in_order, "bottom_queries"),
        _listed(best([F.col("query_id")], NO_QUERY_LIST, queries.filter("hits = 0")), F.struct("provider", "query_id"), in_order, "zero_queries"),
        _listed(every, F.struct("bin", "n"), [F.col("bin")], "hits_histogram"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each

