"""Joins that assemble a run's rows from those of its stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate


def stage_precedence(candidates: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, pool, stage, score, missing): the second stage's score s2 where the pool has abstracts and there is one, else the first's s1.

    Candidates without a first stage are left out and counted in ``missing``.
    """
    joined = candidates.join(first, key, "left").join(second, key, "left")
    lost = joined.agg(F.count_if(F.col("s1").isNull()).alias("missing"))
    s2 = F.when(F.col("pool") == "with_abstract", F.col("s2"))
    stage = F.when(s2.isNotNull(), "stage2").otherwise("stage1")
    return joined.filter("s1 is not null").join(F.broadcast(lost)).select(key, F.coalesce("pool", F.lit("unknown")).alias("pool"), stage.alias("stage"), F.coalesce(s2, F.col("s1")).alias("score"), "missing")


def excerpts(scored: DataFrame, candidates: DataFrame, key: str, most: int = 240) -> DataFrame:
    """``scored`` (evidence) with the first of evidence, abstract, or title and venue of its candidate that is not blank, cut to ``most`` characters."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    meta = F.nullif(F.concat_ws(" | ", filled(F.col("title")), filled(F.col("venue"))), F.lit(""))
    cut = lambda c: truncate(c, most)
    shown = F.coalesce(filled(F.col("evidence")), cut(filled(F.col("abstract"))), cut(meta), F.lit(""))
    return scored.join(candidates, key, "left").withColumn("excerpt", shown).drop("evidence", "abstract", "title", "venue")


def normalised_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "^\\./", "")


def snapshots_of(docs: DataFrame, manifest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``docs`` (path) with pdf_id of the manifest's row of the same path and what ``snapshots`` hold for it; null where there is none."""
    listed = manifest.select(normalised_path(F.col("path")).alias("_path"), "pdf_id").dropDuplicates(["_path"])
    return docs.withColumn("_path", normalised_path(F.col("path"))).join(listed, "_path", "left").join(snapshots, "pdf_id", "left").drop("_path")
