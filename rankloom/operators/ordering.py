"""Running sums, ranks and order statistics over all rows or within few large groups, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


def running_sum(rows: DataFrame, order: list[Column | str], amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows before them in ``order``, which must tell all rows apart.

    Rows are sorted by ranges; what meets in one task is a sum per range.
    """
    ws = Workspace(rows.sparkSession, "ordering")
    ranged = ws.save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_shift") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("_range", "_shift")


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Rank from 1 over all rows."""
    return running_sum(rows, order, F.lit(1), "_before").withColumn(name, F.col("_before") + 1).drop("_before")


def group_rank(rows: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """Rank from 1 within groups, however few and large they are."""
    placed = running_sum(rows, [group, *order], F.lit(1), "_before")
    starts = placed.groupBy(group).agg(F.min("_before").alias("_start"))
    return placed.join(starts, group).withColumn(name, F.col("_before") - F.col("_start") + 1).drop("_before", "_start")


def order_statistics(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """(key, names): of each key's sorted values those at the given places, counted from 0; a place is an expression of ``n``, the key's number of values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    placed = running_sum(counts, [key, value], F.col("_n"), "_before")
    starts = placed.groupBy(key).agg(F.min("_before").alias("_start"), F.sum("_n").alias("n"))
    at = placed.join(starts, key).withColumn("_low", F.col("_before") - F.col("_start"))
    held = lambda place: (F.col("_low") <= place) & (place < F.col("_low") + F.col("_n"))
    return at.groupBy(key).agg(*[F.max(F.when(held(place), F.col(value))).alias(name) for name, place in places.items()])
