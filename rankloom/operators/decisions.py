"""From section scores to verdicts on documents and on chapters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Section scores from 0 to 100 and the least probability of a document."""

    useful: float
    partial: float
    document: float
    floor: float
    strong: float


DEFAULT = Thresholds(useful=55, partial=40, document=0.5, floor=30, strong=70)
PRODUCTION = Thresholds(useful=34, partial=22, document=0.16, floor=18, strong=38)


def document_decisions(documents: DataFrame, sections: DataFrame, key: list[str], at: Thresholds) -> DataFrame:
    """One row for every document: the features of its sections (score, support, type_ok), a probability, the verdict and why not.

    Documents without sections get reason no_ranked_sections.
    """
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "section")
    placed = sections.withColumn("_at", F.row_number().over(order))
    top = lambda n: F.max(F.when(F.col("_at") == n, F.col("score")))
    features = placed.groupBy(*key).agg(
        F.count("*").alias("n_sections"),
        top(1).alias("top1"),
        F.avg(F.when(F.col("_at") <= 3, F.col("score"))).alias("top3"),
        (top(1) - F.coalesce(top(2), F.lit(0.0))).alias("margin"),
        F.count_if(F.col("score") >= at.useful).alias("n_useful"),
        F.count_if((F.col("score") >= at.partial) & (F.col("score") < at.useful)).alias("n_partial"),
        F.avg("support").alias("support"),
        F.avg(F.col("type_ok").cast("double")).alias("type_share"),
    )
    all_docs = documents.join(features, key, "left")
    p = 0.55 * F.col("top1") / 100 + 0.25 * F.col("top3") / 100 + 0.10 * F.col("support") + 0.10 * F.least(F.col("n_useful") / 2, F.lit(1.0))
    out = all_docs.withColumn("probability", F.round(F.coalesce(p, F.lit(0.0)), 6))
    reason = (
        F.when(F.col("n_sections").isNull(), "no_ranked_sections")
        .when(F.col("top1") < at.floor, "below_floor")
        .when(F.col("n_useful") + F.col("n_partial") == 0, "no_useful_section")
        .when(F.col("type_share") == 0, "only_penalised_sections")
        .when((F.col("probability") < at.document) & (F.col("top1") < at.strong), "low_probability")
    )
    return out.withColumn("reason", reason).withColumn("useful", reason.isNull())


def chapter_matrix(decisions: DataFrame, document: str, chapter: str, chapters: list) -> DataFrame:
    """A row a document: its probability in each chapter (0 where it has none), how many find it useful, and the best one."""
    best = F.max_by(chapter, F.struct("probability", (-F.col(chapter)).alias("_first")))
    own = [F.coalesce(F.max(F.when(F.col(chapter) == c, F.col("probability"))), F.lit(0.0)).alias(f"chapter_{c}") for c in chapters]
    return decisions.groupBy(document).agg(F.count_if("useful").alias("n_useful"), best.alias("best_chapter"), *own)
