"""Structured Streaming: roll-ups kept up to date, grants counted once, reservations with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import MAX_FUTURE, reserve


def read_events(spark: SparkSession, directory: str, file: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files named ``file`` (a glob) in a directory."""
    schema = spark.read.option("pathGlobFilter", file).parquet(directory).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def rollup(events: DataFrame, keys: list[str], measures: dict) -> DataFrame:
    """Sums and counts per key; on a stream its state is one row a key."""
    return events.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def keep_table(totals: DataFrame, table: str, checkpoint: str) -> None:
    """Run a roll-up over all input there is and leave it in ``table``; a restart goes on from the checkpoint."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    totals.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once(rows: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once, as far apart as ``delay``; the state forgets older ones."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, length: str, delay: str, key: str) -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.window(at, length), key).agg(F.count("*").alias("n"))


def rate_limit(requests: DataFrame, key: str, interval: int, buffer: int, max_future: int = MAX_FUTURE) -> DataFrame:
    """(key, at, reserved) of a stream of requests with a millisecond clock ``at``; the state is the time of the next slot, reset to now where it is more than ``max_future`` ahead."""
    kind = requests.schema[key].dataType.simpleString()

    def replay(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following = state.get[0] if state.exists else 0
        for pdf in batches:
            at = pdf["at"].sort_values()
            reserved = []
            for now in at:
                reserved.append(reserve(now, following, buffer, max_future))
                following = reserved[-1] + interval
            yield pd.DataFrame({key: name[0], "at": at.to_numpy(), "reserved": reserved})
        state.update((following,))

    return requests.groupBy(key).applyInPandasWithState(replay, f"{key} {kind}, at long, reserved long", "following long", "append", GroupStateTimeout.NoTimeout)
