"""Inspecting a run against judged sections, and choices inside documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assessments import doc_verdict


def inspection(sections: DataFrame, doc: str, key: list[str], steps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``sections`` with a rank in its document for each step (condition, order); null where a step did not keep the section."""
    out = sections
    for name, (kept, order) in steps.items():
        place = Window.partitionBy(doc, kept).orderBy(order, *key)
        out = out.withColumn(name, F.when(kept, F.row_number().over(place)))
    return out


def judged_documents(rows: DataFrame, doc: str, expected: str, usefulness: str, depths: dict[str, tuple[str, int]]) -> DataFrame:
    """(doc, verdict, expected, <step>_hits..., label): judged sections found within a depth after each step; the last step makes a document useful.

    label is 3 if a judged section has a usefulness of 8 or more, 2 if there is any, null if none.
    """
    within = {name: F.coalesce(F.col(rank) <= depth, F.lit(False)) for name, (rank, depth) in depths.items()}
    last = list(within.values())[-1]
    hits = [F.count_if(F.col(expected) & found).alias(f"{name}_hits") for name, found in within.items()]
    label = F.max(F.when(F.col(expected), F.when(F.col(usefulness) >= 8, 3).otherwise(2)))
    return rows.groupBy(doc).agg(doc_verdict(F.bool_or(expected), F.bool_or(last)).alias("verdict"), F.count_if(F.col(expected)).alias("expected"), *hits, label.alias("label"))


def anchor_shares(queries: DataFrame, text: str, anchors: DataFrame, most: float = 0.9) -> DataFrame:
    """(anchor, queries, variable) of every anchor that some query holds.  Queries are taken together by their text, and anchors are a stated list."""
    texts = queries.groupBy(text).agg(F.count("*").alias("_n"))
    total = queries.agg(F.count("*").alias("_total"))
    held = texts.join(F.broadcast(anchors), F.contains(F.col(text), F.col("anchor")))
    counted = held.groupBy("anchor").agg(F.sum("_n").alias("queries")).join(F.broadcast(total))
    return counted.select("anchor", "queries", ((F.col("queries") < F.col("_total")) & (F.col("queries") / F.col("_total") < most)).alias("variable"))


def rescue_sections(rows: DataFrame, doc: str, key: list[str], most: int) -> DataFrame:
    """(doc, key..., score, position) of the best sections of each document, by what retrieval gave, terms hit, kind and page.

    rows: prelim, lanes (null: not retrieved), title_hits, body_hits, preferred, substantial, generic, page.
    Where no section of a document scores above 0, preferred kinds go first, then earlier pages.
    """
    plus = lambda holds, x: F.when(holds, x).otherwise(0.0)
    nothing = F.col("generic") & (F.col("title_hits") <= 0) & (F.col("body_hits") <= 0) & (F.col("prelim") <= 0)
    score = 3.5 * F.col("prelim") + 2.0 * F.col("title_hits") + 0.65 * F.col("body_hits") + F.coalesce(0.65 + 0.08 * F.col("lanes"), F.lit(0.0))
    score = score + plus(F.col("preferred"), 0.5) + plus(F.col("substantial"), 0.15) + plus(F.col("page") <= 3, 0.15) - plus(nothing, 0.25)
    scored = rows.withColumn("score", F.round(score, 8)).withColumn("_good", F.max("score").over(Window.partitionBy(doc)) > 0)
    by_score = F.when(F.col("_good"), F.col("score")).otherwise(F.col("preferred").cast("int"))
    second = F.when(F.col("_good"), F.col("prelim")).otherwise(-F.col("page"))
    place = Window.partitionBy(doc).orderBy(F.desc(by_score), F.desc(second), F.desc(F.when(F.col("_good"), ~F.col("generic"))), "page", *key)
    return scored.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= most).select(doc, *key, "score", "position")
