"""Scores that need all rows to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip01, logistic
from .ordering import running_sum


def authority(rows: DataFrame, citations: str, year: str, as_of: int, review: Column | None = None, core: Column | None = None) -> DataFrame:
    """``rows`` with authority: the percentile of citations per year among cited rows, and how recent the year is.

    The percentile counts rows with at most as many citations per year, over one more than the cited ones.
    """
    age = F.greatest(F.lit(1), as_of - F.col(year) + 1)
    per_year = F.coalesce(F.col(citations), F.lit(0)) / F.coalesce(age, F.lit(10))
    rows = rows.withColumn("per_year", per_year)
    values = rows.filter("per_year > 0").groupBy("per_year").agg(F.count("*").alias("n"))
    cited = values.agg(F.sum("n").alias("cited"))
    counted = running_sum(values, ["per_year"], F.col("n"), "before").join(F.broadcast(cited))  # one row
    ranks = counted.select("per_year", ((F.col("before") + F.col("n")) / (F.col("cited") + 1)).alias("percentile"))
    recency = F.coalesce(logistic((F.col(year) - (as_of - 5)) / 2), F.lit(0.5))
    bonus = 0.05 * F.coalesce(review, F.lit(False)).cast("int") + 0.03 * F.coalesce(core, F.lit(False)).cast("int")
    return rows.join(ranks, "per_year", "left").withColumn("authority", clip01(0.85 * F.coalesce("percentile", F.lit(0.0)) + 0.15 * recency + bonus)).drop("per_year", "percentile")
