"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workspace import Workspace, spread

#: At least so many last bits of a segment are looked up inside a group, and so many at most; the bits before them name the group.
LOW_BITS, MOST_LOW_BITS = 8, 14
#: Codes of a group above which it is dealt to several tasks.
PART = 50_000
#: Probes, slots and candidates that are in memory at once.
CHUNK = 1 << 18


def _segments(bits: int, codes: int) -> list[tuple[int, int]]:
    """(first bit, length): about log2(codes) bits each, which is where probes and candidates balance; 63 at most."""
    n = max(1, round(bits / max(LOW_BITS, math.log2(max(codes, 2)))), math.ceil(bits / 63))
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:])]))


def _encode(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("vector").flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, bits)
                packed = np.packbits(values > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "code"])

    return run


def _segment_values(codes: np.ndarray, bits: int, segment: tuple[int, int]) -> np.ndarray:
    first, length = segment
    spread = np.unpackbits(codes, axis=1)[:, first : first + length].astype(np.int64)
    return spread @ (1 << np.arange(length - 1, -1, -1, dtype=np.int64))


def _low(length: int) -> int:
    """Where there are enough bits, 64 groups or more a segment."""
    return min(length, max(LOW_BITS, min(MOST_LOW_BITS, length - 6)))


def _matrix(column: pa.Array | pa.ChunkedArray, bits: int) -> np.ndarray:
    """The bytes of codes, a row each."""
    column = column.cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    width = (bits + 7) // 8
    first = np.frombuffer(offsets, np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[first : first + width * len(column)].reshape(-1, width)


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit numbers, filled up with zeros."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def _masks(length: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(length), weight)], np.int64)


def _indexed(bits: int, segments: list[tuple[int, int]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("code")
            codes = _matrix(code, bits)
            for j, segment in enumerate(segments):
                value = _segment_values(codes, bits, segment)
                low = _low(segment[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), j, np.int32)), pa.array(value >> low), pa.array(value & (1 << low) - 1), code, batch.column("ids")], ["segment", "coarse", "low", "code", "ids"])

    return run


def _probing(bits: int, segments: list[tuple[int, int]], radius: int):
    """The groups that may hold codes at ``radius`` from the query in a segment, and how far from its own last bits to look there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _matrix(batch.column("code"), bits)
            for j, segment in enumerate(segments):
                low = _low(segment[1])
                value = _segment_values(codes, bits, segment)
                for weight in range(max(0, radius - low), min(radius, segment[1] - low) + 1):
                    masks = _masks(segment[1] - low, weight)
                    for start in range(0, len(codes) * len(masks), CHUNK):
                        at, mask = np.divmod(np.arange(start, min(start + CHUNK, len(codes) * len(masks))), len(masks))
                        own = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [own.column("code"), own.column("bound"), pa.array(np.full(len(at), j, np.int32)), pa.array((value[at] >> low) ^ masks[mask]), pa.array(value[at] & (1 << low) - 1), pa.array(np.full(len(at), radius - weight, np.int32))],
                            ["code", "bound", "segment", "coarse", "own", "weight"],
                        )

    return run


def _shares(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches with about CHUNK together, one element at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        yield start, stop
        start = stop


def _least(query: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The first k rows of each query in that order, the last key first."""
    rows = np.lexsort((*order, query))
    sorted_ = query[rows]
    return rows[np.arange(len(rows)) - np.searchsorted(sorted_, sorted_) < k]


def _verified(bits: int, segments: list[tuple[int, int]], k: int):
    """The k codes, and of these the k ids, of a group that are nearest to each query and within its bound."""

    def run(key: tuple, probes: pa.Table, index: pa.Table) -> pa.Table:
        found = []
        if probes.num_rows and index.num_rows:
            low = _low(segments[key[0].as_py()][1])
            values = index.column("low").to_numpy()
            place = np.argsort(values, kind="stable")
            bounds = np.searchsorted(values[place], np.arange((1 << low) + 1))
            codes = _words(_matrix(index.column("code"), bits))[place]
            ids = index.column("ids").combine_chunks()
            n_ids = ids.value_lengths().to_numpy()
            first_id, n_ids, ids = (np.cumsum(n_ids) - n_ids)[place], n_ids[place], ids.flatten().to_numpy()
            asked, own, most, weights = _words(_matrix(probes.column("code"), bits)), probes.column("own").to_numpy(), probes.column("bound").to_numpy(), probes.column("weight").to_numpy()
            for weight in np.unique(weights):
                of, masks = np.flatnonzero(weights == weight), _masks(low, int(weight))
                for a, b in _shares(np.full(len(of), len(masks))):
                    slots = own[of[a:b], None] ^ masks
                    first, n = bounds[slots], bounds[slots + 1] - bounds[slots]
                    for c, d in _shares(n.sum(axis=1)):
                        slot = np.flatnonzero(n[c:d])
                        many = n[c:d].ravel()[slot]
                        query = of[a + c + np.repeat(slot // len(masks), many)]
                        row = np.repeat(first[c:d].ravel()[slot] - np.cumsum(many) + many, many) + np.arange(len(query))
                        distance = sum(np.bitwise_count(codes[row, w] ^ asked[query, w]).astype(np.int32) for w in range(codes.shape[1]))
                        near = np.flatnonzero(distance <= most[query])
                        # of equal distances, the codes with the least ids: a code has k of its ids at most
                        near = near[_least(query[near], (ids[first_id[row[near]]], distance[near]), k)]
                        many = n_ids[row[near]]
                        query, distance, at = np.repeat(query[near], many), np.repeat(distance[near], many), np.repeat(first_id[row[near]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                        keep = _least(query, (ids[at], distance), k)
                        found.append((query[keep], distance[keep], ids[at[keep]]))
        query, distance, id_ = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        return pa.table({"code": probes.column("code").take(pa.array(query)), "distance": distance, "id": id_})

    return run


def nearest_codes(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, distance): the k rows of ``vectors`` nearest to each row of ``queries``, by distance, then id.

    A code has a bit for each dimension, set where the value is above 0; distance
    is Hamming's.  Codes are cut into segments and indexed by each.  In round r a
    query looks up, in every segment, the values at distance r from its own, and
    candidates are verified on the whole code.  After round r all codes within
    segments * (r + 1) - 1 are known; a query is done when its k-th distance is
    within that, the others go on.  The result is exact.

    Equal codes are one index entry with their k least ids.  A group with many
    codes is dealt to several tasks, and a task returns at most k rows of a query, none
    beyond the k-th distance known so far.  Queries with equal codes are searched once.

    What a round looks up is made from few queries and may be large, which its
    estimate does not show; it is only joined in ways that never broadcast it.

    Rows with a null id or vector, or of another length than the longest vector, are left
    out of both sides; null elements count as 0.  Rows that repeat an id and
    a code count once.  Fewer than k rows in all: all of them.  A query that is among
    the vectors finds itself.
    """
    ws = Workspace(vectors.sparkSession, "hamming")
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and size(vector) > 0")
    given, asked = take(vectors), take(queries)
    bits = given.agg(F.max(F.size("vector"))).first()[0]
    empty = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, distance int")
    if not bits:
        return empty
    coded = given.filter(F.size("vector") == bits).mapInArrow(_encode(bits), "id long, code binary").distinct()
    least = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = ws.save(coded.withColumn("n", least).filter(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    segments = _segments(bits, codes.count())
    index = ws.save(codes.mapInArrow(_indexed(bits, segments), "segment int, coarse long, low long, code binary, ids array<long>"))
    groups = ws.save(index.groupBy("segment", "coarse").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    heavy = ws.save(groups.filter("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    index = ws.save(index.join(heavy, ["segment", "coarse"], "left").withColumn("part", F.pmod(F.xxhash64("code"), parts).cast("int")).drop("parts"))

    given = ws.save(asked.filter(F.size("vector") == bits).mapInArrow(_encode(bits), "id long, code binary").distinct())
    open_queries = ws.save(given.select("code", F.lit(bits).alias("bound")).distinct())
    tasks = spread(vectors.sparkSession)
    best, done = None, []
    for radius in range(max(length for _, length in segments) + 1):
        probes = open_queries.mapInArrow(_probing(bits, segments, radius), "code binary, bound int, segment int, coarse long, own long, weight int")
        probes = probes.join(groups, ["segment", "coarse"], "left_semi").join(heavy, ["segment", "coarse"], "left")
        probes = ws.save(probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"))
        key = ["segment", "coarse", "part"]
        probed = index.join(probes.select(*key).distinct(), key, "left_semi")  # the rest of the index stays where it is
        sides = [side.repartition(tasks, *key).groupBy(*key) for side in (probes, probed)]  # few bytes, but much work
        found = sides[0].cogroup(sides[1]).applyInArrow(_verified(bits, segments, k), "code binary, distance int, id long")
        merged = (found if best is None else found.union(best)).distinct()
        order = Window.partitionBy("code").orderBy("distance", "id")
        top = ws.save(merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        covered = len(segments) * (radius + 1) - 1
        full = top.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = ws.save(open_queries.join(full, "code", "left").select("code", F.when(F.col("n") >= k, F.col("last")).otherwise(bits).alias("bound"), F.coalesce((F.col("n") >= k) & (F.col("last") <= covered), F.lit(False)).alias("known")))
        last = radius == max(length for _, length in segments)
        left = ws.save(state.filter("not known").drop("known"))
        if last or left.isEmpty():
            done.append(top)
            break
        done.append(top.join(state.filter("known").select("code"), "code", "left_semi"))
        best = top.join(left.select("code"), "code", "left_semi").select("code", "distance", "id")
        open_queries = left
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = given.select("code", F.col("id").alias("query_id")).join(out, "code")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "distance")
