"""Prices, credits, balances and pages of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types whose products and quotients keep all their digits.
TOKENS, PRICE = "decimal(18,0)", "decimal(12,6)"


def keyset_page(rows: DataFrame, cursor: DataFrame, at: str, key: str, size: int) -> DataFrame:
    """The page of ``size`` rows after the cursor row (at, after), newest first; an empty cursor gives the first page."""
    after = rows.join(F.broadcast(cursor.limit(1)), how="left")
    older = F.col("at").isNull() | (F.struct(at, key) < F.struct("at", "after"))
    return after.filter(older).orderBy(F.desc(at), F.desc(key)).limit(size).drop("at", "after")


def debit_two_buckets(debits: DataFrame, user: str, order: list[str], amount: str) -> DataFrame:
    """Debits take from ``subscription`` first and then from ``topup``, which may go below 0.

    With non-negative debits the state after each is a function of the sum so far,
    so one running sum replaces a replay.
    """
    spent = F.sum(amount).over(Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = debits.withColumn("spent", spent)
    before = F.col("spent") - F.col(amount)
    return (
        out.withColumn("subscription_left", F.greatest(F.col("subscription") - F.col("spent"), F.lit(0)))
        .withColumn("topup_left", F.col("topup") - F.greatest(F.col("spent") - F.col("subscription"), F.lit(0)))
        .withColumn("from_subscription", F.greatest(F.least(F.col("subscription") - before, F.col(amount)), F.lit(0)))
    )


def backfill_credits(rows: DataFrame, rate: float) -> DataFrame:
    """Missing credits are cost * rate, missing costs credits / rate; neither is below 0."""
    cost, credits = F.greatest("cost", F.lit(0)), F.greatest("credits", F.lit(0))
    given = rows.withColumn("_cost", F.when(F.col("cost").isNotNull(), cost)).withColumn("_credits", F.when(F.col("credits").isNotNull(), credits))
    return given.withColumn("credits", F.coalesce("_credits", F.col("_cost") * rate)).withColumn("cost", F.coalesce("_cost", F.col("_credits") / rate)).drop("_cost", "_credits")


def best_price(usage: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """``usage`` with the price of the best matching name: equal, else the longest prefix, else ``default``.

    Models are few, so the match is made once per model and joined back.
    """
    models = usage.select(F.col(model).alias("_model")).distinct()
    starts = F.col("_model").startswith(F.col("name"))
    kind = F.when(F.col("_model") == F.col("name"), 0).when(starts, 1).otherwise(2)
    matches = models.join(F.broadcast(prices), starts | (F.col("name") == "default"))
    best = matches.groupBy("_model").agg(F.min_by("price", F.struct(kind, -F.length("name"))).alias("price"))
    return usage.join(best, usage[model] == best["_model"]).drop("_model")


def token_cost(input_tokens: Column, cached: Column, output: Column, prices: tuple[str, str, str]) -> Column:
    """Cost per million tokens in decimals; cached tokens are part of the input and never more than it."""
    fresh = F.greatest(input_tokens - cached, F.lit(0))
    parts = [x.cast(TOKENS) * F.lit(p).cast(PRICE) / 1_000_000 for x, p in zip((fresh, cached, output), prices, strict=True)]
    return (parts[0] + parts[1] + parts[2]).cast("double")


def image_tokens(width: Column, height: Column) -> Column:
    """85 for each tile of 512 pixels."""
    return (F.ceil(width / 512) * F.ceil(height / 512) * 85).cast("long")
