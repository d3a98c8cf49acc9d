"""Support for sub-points, rescue of documents, plans adjusted to what the corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import first_per, quota_per


def supporting_passages(passages: DataFrame, section: str, passage: str, score: str, most: int = 8) -> DataFrame:
    """(section, passages, lanes, n): the best ``most`` passages of a section in order, and the lanes that found any.

    A passage found by several lanes counts once, with its best score.
    """
    lanes = passages.groupBy(section).agg(F.array_sort(F.collect_set("lane")).alias("lanes"), F.countDistinct(passage).alias("n"))
    best = passages.groupBy(section, passage).agg(F.max(score).alias("_score"))
    top = quota_per(best, [section], [F.desc("_score"), passage], most, "_at")
    listed = top.groupBy(section).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", passage))), lambda p: p[passage]).alias("passages"))
    return listed.join(lanes, section)


def support_inventory(rows: DataFrame, point: str, doc: str, item: str, score: str, trusted: Column) -> DataFrame:
    """(point, n, n_trusted, n_docs, top): per sub-point what supports it; top is the best trusted item, else the best one."""
    key = F.struct(trusted.alias("t"), F.col(score).alias("s"), (-F.col(item)).alias("i"))
    docs = F.countDistinct(F.when(trusted, F.col(doc)))
    return rows.groupBy(point).agg(F.count("*").alias("n"), F.count_if(trusted).alias("n_trusted"), docs.alias("n_docs"), F.max_by(item, key).alias("top"))


def suppress_unsupported(points: DataFrame, inventory: DataFrame, group: str, point: str) -> DataFrame:
    """Points with trusted support, where a group has two of them or more; all its points otherwise."""
    joined = points.join(inventory.select(point, "n_trusted"), point, "left").withColumn("_ok", F.coalesce("n_trusted", F.lit(0)) > 0)
    counted = joined.withColumn("_kept", F.count_if("_ok").over(Window.partitionBy(group)))
    return counted.filter(F.col("_ok") | (F.col("_kept") < 2)).drop("_ok", "_kept", "n_trusted")


def recalibrated_terms(support: DataFrame, group: str, term: str, most: int) -> DataFrame:
    """The ``most`` terms of a group that the corpus supports best: 4 a document, 2 a title, a fifth a text up to 20."""
    weight = 4 * F.col("docs") + 2 * F.col("titles") + 0.2 * F.least(F.col("texts"), F.lit(20))
    return quota_per(support.withColumn("weight", weight), [group], [F.desc("weight"), term], most)


def rescue_documents(doc_scores: DataFrame, fused: DataFrame, group: str, doc: str, limit: int, share: float = 0.35) -> DataFrame:
    """(group, doc, rescue): documents whose own score stands out most from ``share`` of what their sections have; only positive ones."""
    best = fused.groupBy(group, doc).agg(F.max("fused").alias("_best"))
    gap = F.col("score") - share * F.coalesce("_best", F.lit(0.0))
    ranked = doc_scores.join(best, [group, doc], "left").withColumn("rescue", gap).filter("rescue > 0")
    return quota_per(ranked, [group], [F.desc("rescue"), doc], limit).select(group, doc, "rescue", "rank")


def round_robin(rows: DataFrame, group: str, facet: str, item: str, score: str, limit: int) -> DataFrame:
    """(group, item, facet, position): the best item of each facet in turn, then the second ones; an item is taken where it comes first."""
    turns = quota_per(rows, [group, facet], [F.desc(score), item], 1 << 30, "_turn")
    once = first_per(turns, [group, item], ["_turn", facet])
    placed = once.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("_turn", facet)))
    return placed.filter(F.col("position") <= limit).select(group, item, facet, "position")


def stage_costs(calls: DataFrame, stage: str, cost: str, tokens: str, stages: DataFrame) -> DataFrame:
    """A row for every stage: calls, cost and tokens, nothing below 0; a stage that was a cache hit costs 0."""
    clean = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    sums = calls.groupBy(stage).agg(F.count("*").alias("calls"), F.sum(clean(F.col(cost))).alias("cost"), F.sum(clean(F.col(tokens))).alias("tokens"))
    joined = F.broadcast(stages).join(sums, stage, "left")
    return joined.select(stage, clean(F.col("calls")).alias("calls"), F.when(F.col("cached"), 0).otherwise(clean(F.col("cost"))).alias("cost"), clean(F.col("tokens")).alias("tokens"))


def run_index(runs: DataFrame, run: str, metrics: str) -> DataFrame:
    """(run, stages, cost, duration, slowest) from JSON metrics: {"stages": {name: {"cost": x, "duration": y}}}."""
    parsed = runs.select(run, F.from_json(F.get_json_object(metrics, "$.stages"), "map<string,struct<cost:double,duration:double>>").alias("m"))
    flat = parsed.select(run, F.explode_outer("m").alias("stage", "v"))
    longest = F.max_by("stage", F.struct("v.duration", "stage"))
    return flat.groupBy(run).agg(F.count("stage").alias("stages"), F.coalesce(F.sum("v.cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("v.duration"), F.lit(0.0)).alias("duration"), longest.alias("slowest"))
