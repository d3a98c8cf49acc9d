"""State machines over logs of events: closed forms where there is one, replays per key where there is none."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A slot further ahead than this is taken for an error of the clock.
MAX_FUTURE = 86_400_000


def rate_limit(requests: DataFrame, key: str, at: str, order: list[str], interval: int, buffer: int, max_future: int = MAX_FUTURE) -> DataFrame:
    """``requests`` with reserved and wait: each takes the later of now + buffer and the last reservation + interval.

    A next slot more than ``max_future`` ahead of now is reset to now (never, where that is 0), so
    there is no closed form: each key's requests are replayed in order, a batch at a time, and
    what is kept between batches is the next slot. A request without a time reserves nothing.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("reserved", T.LongType()), T.StructField("wait", T.LongType())])

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, following = None, 0
        for batch in batches:
            reserved, wait = [], []
            for name, now in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if name != last:
                    last, following = name, 0
                if now is None:
                    reserved.append(None)
                    wait.append(None)
                    continue
                slot = reserve(now, following, buffer, max_future)
                following = slot + interval
                reserved.append(slot)
                wait.append(slot - now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reserved, pa.int64()), pa.array(wait, pa.int64())], [*batch.schema.names, "reserved", "wait"])

    return requests.repartition(key).sortWithinPartitions(key, *order).mapInArrow(replay, schema)


def reserve(now: int, following: int, buffer: int, max_future: int) -> int:
    """The slot of a request at ``now`` where the next free one is ``following``."""
    if max_future > 0 and following > now + max_future:
        following = now
    return max(now + buffer, following)


def task_counters(events: DataFrame, group: str, task: str, status: str, order: list[str]) -> DataFrame:
    """(group, pending, succeeded, failed, done) from the last status of each task; repeated events do no harm."""
    last = events.groupBy(group, task).agg(F.max_by(status, F.struct(*order)).alias("s"))
    counts = last.groupBy(group).agg(F.count_if(~F.col("s").isin("success", "failed")).alias("pending"), F.count_if(F.col("s") == "success").alias("succeeded"), F.count_if(F.col("s") == "failed").alias("failed"))
    return counts.withColumn("done", (F.col("pending") == 0) & (F.col("failed") == 0))


def lease_replay(events: DataFrame, task: str, order: list[str], lease: int) -> DataFrame:
    """(task, order..., outcome) of claim and complete events with a millisecond clock ``at``.

    A claim succeeds on a queued task or where the running claim is older than ``lease``; a
    complete event ends a running task once; everything else is refused.
    """
    def replay(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, status, claimed = None, "queued", None
        for row in rows:
            name, action, at = row[0], row[-2], row[-1]
            if last is None or name != last[0]:
                last, status, claimed = (name,), "queued", None
            outcome = "refused"
            if status == "success":
                outcome = "already_done"
            elif action == "claim" and (status == "queued" or (at is not None and claimed is not None and at - claimed > lease)):
                outcome = "claimed" if status == "queued" else "reclaimed"
                status, claimed = "running", at
            elif action == "complete" and status == "running":
                outcome, status = "completed", "success"
            yield (outcome,)

    return _replayed(events.select(task, *order, F.col("action").alias("_action"), F.col("at").alias("_at")), task, order, replay, [T.StructField("outcome", T.StringType())], ["_action", "_at"])


def _replayed(rows: DataFrame, key: str, order: list[str], replay, fields: list[T.StructField], inputs: list[str]) -> DataFrame:
    """``rows`` less ``inputs`` (its last columns) with what ``replay`` gives for each row, in order within each key.

    A partition's keys follow one another through one call of ``replay``, a batch at a time; no key is gathered.
    """
    kept = [f for f in rows.schema.fields if f.name not in inputs]
    schema = T.StructType([*kept, *fields])
    own = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []

        def each() -> Iterator[tuple]:
            for batch in batches:
                waiting.append(batch)
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        out: list = []
        for row in replay(each()):
            out.append(row)
            if len(out) == waiting[0].num_rows:
                yield from emit(waiting.pop(0), out)
                out = []

    def emit(batch: pa.RecordBatch, out: list) -> Iterator[pa.RecordBatch]:
        made = pa.RecordBatch.from_pylist([dict(zip(own, row, strict=True)) for row in out], schema=arrow)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made.columns], [*[f.name for f in kept], *own])

    arrow = pa.schema([(f.name, pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string()) for f in fields])
    return rows.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order]).mapInArrow(run, schema)


def reservations(requests: DataFrame, user: str, order: list[str]) -> DataFrame:
    """(user, order..., outcome, available) of requests with operation, kind (reserve, release) and required, against ``balance``.

    A reservation is blocked where what is available is less than required, and named
    already_reserved or finalized when its operation holds or has released one.
    """
    def replay(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, held, over, available = None, {}, set(), 0.0
        for row in rows:
            name, (operation, kind, required, balance) = row[0], row[-4:]
            required, balance = (math.nan if x is None else float(x) for x in (required, balance))
            if last is None or name != last[0]:
                last, held, over, available = (name,), {}, set(), balance
            if operation in over:
                outcome = "finalized"
            elif kind == "release":
                outcome = "released" if operation in held else "unknown"
                available += held.pop(operation, 0.0)
                over |= {operation} if outcome == "released" else set()
            elif operation in held:
                outcome = "already_reserved"
            elif available < required:
                outcome = "blocked"
            else:
                outcome, held[operation] = "reserved", required
                available -= required
            yield outcome, None if math.isnan(available) else available

    inputs = ["operation", "kind", "required", "balance"]
    rows = requests.select(user, *order, *[F.col(c).alias(f"_{c}") for c in inputs])
    return _replayed(rows, user, order, replay, [T.StructField("outcome", T.StringType()), T.StructField("available", T.DoubleType())], [f"_{c}" for c in inputs])


def grants(rows: DataFrame, user: str, grant: str) -> DataFrame:
    """(user, topup, subscription): top-ups add up once per grant id, the subscription is that of the latest period."""
    once = rows.dropDuplicates([grant])
    return once.groupBy(user).agg(F.sum(F.when(F.col("kind") == "topup", F.col("credits"))).alias("topup"), F.max_by(F.when(F.col("kind") == "subscription", F.col("credits")), F.when(F.col("kind") == "subscription", F.struct("period_end", grant))).alias("subscription"))
