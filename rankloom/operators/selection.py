"""Ranks, quotas and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_at = 1").drop("_at")


def quota_per(rows: DataFrame, key: list[str], order: list[Column | str], quota: Column | int, name: str = "rank") -> DataFrame:
    """The first rows of each key, as many as its quota; their rank as ``name``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(name) <= quota)


def quotas_then_fill(rows: DataFrame, group: list[str], bucket: Column, quotas: dict[str, int], order: list[Column | str], limit: int) -> DataFrame:
    """``limit`` rows a group: those within their bucket's quota, bucket by bucket as listed, then the rest by order."""
    names = list(quotas)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("_bucket"))
    allowed = F.coalesce(*[F.when(F.col("_bucket") == n, q) for n, q in quotas.items()], F.lit(0))
    out = rows.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    out = out.withColumn("_in", F.col("_rank") <= allowed)
    segment = F.when(F.col("_in"), place).otherwise(len(names) + 1)
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(segment, *order)))
    return out.filter(F.col("position") <= limit).withColumnRenamed("_bucket", "bucket").drop("_rank", "_in")


def pool_precap(rows: DataFrame, pool: Column, order: list[Column | str], cap: int, share: float) -> DataFrame:
    """At most ``cap`` rows, of which those in the pool take at most floor(cap * share) and leave the rest to the others.

    A rank over all rows is needed only among the first ``cap`` of each side, which a limit finds.
    """
    inside = rows.filter(pool).orderBy(*order).limit(int(cap * share))
    others = rows.filter(~pool).orderBy(*order).limit(cap)
    both = others.withColumn("_side", F.lit(1)).unionByName(inside.withColumn("_side", F.lit(0)))
    return both.orderBy("_side", *order).limit(cap).drop("_side")


def uncovered_injection(rows: DataFrame, group: str, order: list[Column | str], top: int) -> DataFrame:
    """The ``top`` rows and the best row of each group that has none among them."""
    head = rows.orderBy(*order).limit(top)
    best = first_per(rows, [group], order)
    missing = best.join(head.select(group).distinct(), group, "left_anti")
    return head.withColumn("injected", F.lit(False)).unionByName(missing.withColumn("injected", F.lit(True)))


def passes(rows: DataFrame, group: str, score: str, tie: str, most: int, least: float, limit: int) -> DataFrame:
    """Rows in passes: the best of each group, then the second ones and so on up to ``most``; after the first pass only with ``least`` or more."""
    placed = quota_per(rows, [group], [F.desc(score), tie], most, "pass").filter((F.col("pass") == 1) | (F.col(score) >= least))
    return placed.orderBy("pass", F.desc(score), tie).limit(limit)


def distinct_titles(rows: DataFrame, group: list[str], title: Column, junk: Column, order: list[Column | str]) -> DataFrame:
    """Without junk titles; of equal titles the first by order."""
    named = rows.withColumn("_title", title).filter(~junk)
    return first_per(named, [*group, "_title"], order).drop("_title")


def min_max(x: Column, group: list[str]) -> Column:
    """x between its group's ends, 0 where they are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.coalesce(F.try_divide(x - low, F.when(high > low, high - low)), F.lit(0.0))


def retention(rows: DataFrame, group: str, at: str, key: str, keep: int, expired: Column, pinned: Column) -> DataFrame:
    """Rows to delete: expired ones, and beyond the ``keep`` newest of a group; pinned ones stay."""
    live = rows.withColumn("_expired", expired)
    order = Window.partitionBy(group, "_expired").orderBy(F.desc(at), F.desc(key))
    return live.withColumn("_at", F.row_number().over(order)).filter((F.col("_expired") | (F.col("_at") > keep)) & ~pinned).drop("_at", "_expired")


def rank_shift(before: DataFrame, after: DataFrame, item: str, top: int) -> DataFrame:
    """(item, old_rank, new_rank, shift) of the ``top`` items that moved most; only items of both."""
    both = before.select(item, F.col("rank").alias("old_rank")).join(after.select(item, F.col("rank").alias("new_rank")), item)
    return both.withColumn("shift", F.col("old_rank") - F.col("new_rank")).orderBy(F.desc(F.abs("shift")), item).limit(top)
