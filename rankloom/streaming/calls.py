"""A log of calls with its running summary, and scans of it that go on where they were stopped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a running summary adds up.
MEASURES = ["input_tokens", "cached_input_tokens", "output_tokens", "cost_usd"]


def append_calls(calls: DataFrame, log: str, checkpoint: str, keys: list[str] | None = None) -> None:
    """Append all calls there are on a stream to ``log``/calls, with the sums of each batch beside them in ``log``/sums.

    Both are written under the batch's number, sums last; a batch that was killed and is run again replaces what it left, so
    every call counts once. ``keys`` are columns that the summary keeps apart.
    """
    keys = keys or []

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{log}/calls/batch={number}")
            sums = batch.groupBy(*keys).agg(F.count("*").alias("call_count"), *[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in MEASURES])
            sums.coalesce(1).write.mode("overwrite").parquet(f"{log}/sums/batch={number}")
        finally:
            batch.unpersist()

    calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def logged_calls(spark: SparkSession, log: str) -> DataFrame:
    """Calls of finished batches: those that have sums."""
    done = spark.read.parquet(f"{log}/sums").select("batch").distinct()
    return spark.read.parquet(f"{log}/calls").join(F.broadcast(done), "batch", "left_semi").drop("batch")


def running_summary(spark: SparkSession, log: str, keys: list[str] | None = None) -> DataFrame:
    """call_count, tokens and cost so far, by ``keys``; reads a few rows a batch, not the calls."""
    sums = spark.read.parquet(f"{log}/sums")
    added = [F.sum(c).alias(c) for c in ["call_count", *MEASURES]]
    return sums.groupBy(*(keys or [])).agg(*added).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost_usd", F.round("cost_usd", 10))


def _pages(spark: SparkSession, state: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{state}/pages")
    except AnalysisException:  # nothing there yet
        return None


def backfill(rows: DataFrame, state: str, keys: list[str], label: Column, amount: Column, most: int = 5000, page: int = 500, stop_after: int | None = None) -> bool:
    """Scan the newest ``most`` rows by ``keys`` (descending) page by page, and keep each page's sums by label and its cursor under ``state``.

    A page is one file written at once, so a scan that was stopped, or killed while it wrote, goes on after the last
    page that is there. ``stop_after`` pages it stops by itself; the result tells whether it is done.
    ``most`` is a limit of the feature: only so much history is scanned.
    """
    spark = rows.sparkSession
    done = _pages(spark, state)
    last = done.orderBy(F.desc("page")).select("page", "seen", "short", "cursor").first() if done is not None else None
    number, seen, short, cursor = (last.page, last.seen, last.short, last.cursor) if last else (0, 0, False, None)
    made = 0
    while seen < most and not short:
        if stop_after is not None and made >= stop_after:
            return False
        left = rows
        if cursor is not None:
            after = F.lit(False)
            for i in reversed(range(len(keys))):
                after = (F.col(keys[i]) < F.lit(cursor[keys[i]])) | ((F.col(keys[i]) == F.lit(cursor[keys[i]])) & after)
            left = rows.filter(after)
        taken = left.orderBy(*[F.desc(k) for k in keys]).limit(min(page, most - seen))
        by_label = taken.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.coalesce(amount, F.lit(0)), F.lit(0))).alias("amount"), F.min(F.struct(*keys)).alias("least"))
        sums = by_label.agg(F.sort_array(F.collect_list(F.struct("label", "n", "amount"))).alias("sums"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("least").alias("cursor"))
        number, made = number + 1, made + 1
        out = f"{state}/pages/page={number}"
        sums.select((F.col("rows") + seen).alias("seen"), (F.col("rows") < min(page, most - seen)).alias("short"), "cursor", "sums").coalesce(1).write.mode("overwrite").parquet(out)
        found = spark.read.parquet(out).first()
        seen, short, cursor = found.seen, found.short, found.cursor
    return True


def backfilled(spark: SparkSession, state: str) -> DataFrame:
    """(label, n, amount) of all pages scanned."""
    return spark.read.parquet(f"{state}/pages").select(F.explode("sums").alias("s")).groupBy("s.label").agg(F.sum("s.n").alias("n"), F.sum("s.amount").alias("amount"))
