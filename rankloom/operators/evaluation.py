"""Comparing rankings and decisions with judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tournament(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(id, score, games) from pairs with winner (left, right, tie) and confidence: a win is 1 + 0.1 * confidence, a tie 0.5 each."""
    win = 1 + 0.1 * F.col("confidence")
    sides = F.array(*[F.struct(F.col(i).alias("id"), F.when(F.col("winner") == side, win).when(F.col("winner") == "tie", 0.5).otherwise(0.0).cast("double").alias("score")) for i, side in ((left, "left"), (right, "right"))])
    return pairs.select(F.explode(sides).alias("s")).groupBy("s.id").agg(F.sum("s.score").alias("score"), F.count("*").alias("games"))


def confusion(rows: DataFrame, truth: Column, found: Column, group: list[str]) -> DataFrame:
    """(group, tp, fp, fn, tn, precision, recall); ratios are over 1 at least."""
    tp, fp, fn = F.count_if(truth & found), F.count_if(~truth & found), F.count_if(truth & ~found)
    safe = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return rows.groupBy(*group).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~truth & ~found).alias("tn"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"))


def hit_at_k(ranking: DataFrame, judged: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(n, hits, hit_rate): judged queries with a relevant item among their first k."""
    hits = ranking.filter(F.col("rank") <= k).join(judged, [query, item], "left_semi").select(query).distinct().withColumn("hit", F.lit(1))
    per_query = judged.select(query).distinct().join(hits, query, "left")
    return per_query.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).withColumn("hit_rate", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 6))


def compare_runs(before: DataFrame, after: DataFrame, item: str) -> DataFrame:
    """One row: items of both runs and of one only, and how often their verdicts agree."""
    both = before.select(item, F.col("verdict").alias("old")).join(after.select(item, F.col("verdict").alias("new")), item, "full")
    shared = F.col("old").isNotNull() & F.col("new").isNotNull()
    return both.agg(F.count_if(shared).alias("shared"), F.count_if(F.col("new").isNull()).alias("only_old"), F.count_if(F.col("old").isNull()).alias("only_new"), F.round(F.count_if(F.col("old") == F.col("new")) / F.greatest(F.count_if(shared), F.lit(1)), 6).alias("agreement"))
