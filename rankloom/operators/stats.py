"""Roll-ups, histograms and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_rank, order_statistics


def breakdowns(rows: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """(dimension, key, measures): one total per value of each dimension, in a single pass (GROUPING SETS)."""
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    out = sets.agg(*[c.alias(n) for n, c in measures.items()], *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    dimension = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions])
    key = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dimensions])
    return out.select(dimension.alias("dimension"), key.alias("key"), *measures)


def dense(totals: DataFrame, axis: DataFrame, on: str, zero: list[str]) -> DataFrame:
    """``axis`` (its column ``on``) with the totals; keys without rows get 0.  The axis is small by construction."""
    return F.broadcast(axis).join(totals, on, "left").select(on, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def months(spark, first: str, last: str) -> DataFrame:
    """All months yyyy-MM from ``first`` to ``last``."""
    return spark.sql(f"select date_format(m, 'yyyy-MM') as month from (select explode(sequence(date '{first}-01', date '{last}-01', interval 1 month)) as m)")


def uniform_bin(x: Column, bins: int, low: float, high: Column | float) -> Column:
    """Index of the bin of ``x``; values beyond the ends go to the first or last bin, non-finite ones to none."""
    width = (high - F.lit(low)) / bins
    index = F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bins - 1))
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), index.cast("int"))


def histogram(spark, values: DataFrame, bin_col: str, series: dict[str, Column], bins: int) -> DataFrame:
    """(bin, one count per series) of all ``bins``, empty ones too; ``series`` are conditions."""
    counts = values.filter(F.col(bin_col).isNotNull()).groupBy(F.col(bin_col).alias("bin")).agg(*[F.count_if(c).alias(n) for n, c in series.items()])
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return dense(counts, axis, "bin", list(series))



def fixed_percentile(x: Column, q: float, method: str = "linear") -> Column:
    """Percentile aggregate: interpolated ("linear") or nearest rank ("rank"); 0 without rows."""
    agg = F.expr(f"percentile({x._jc.toString()}, {q})") if method == "linear" else F.expr(f"percentile_disc({q}) within group (order by {x._jc.toString()})")
    return F.coalesce(agg, F.lit(0.0))


def spearman(rows: DataFrame, left: str, right: str, tie: str) -> DataFrame:
    """(rho, n): rank correlation 1 - 6 sum d2 / (n (n2 - 1)); ranks descend, ties by ``tie``; 1 for a single row."""
    ranked = global_rank(global_rank(rows.select(left, right, tie), [F.desc(left), tie], "a"), [F.desc(right), tie], "b")
    total = ranked.agg(F.count("*").alias("n"), F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("d2"))
    n = F.col("n").cast("double")  # the cube of two million rows is beyond 64 bits
    return total.select(F.when(n < 2, 1.0).otherwise(1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("rho"), "n")


def latency_summary(rows: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Count, mean, ends and nearest-index percentiles per key: the element round((n - 1) * q), halves to even."""
    basic = rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return basic.join(order_statistics(rows, key, value, {name: F.bround((F.col("n") - 1) * q, 0) for name, q in quantiles.items()}), key)
