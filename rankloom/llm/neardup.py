"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texts
from ..operators.components import components
from ..operators.workspace import Workspace

BAND_ROWS = 4
#: The chance that two texts just at the threshold share no band.
MISS = 1e-5
#: Sets, and shingles in them, of half a block on average.
BLOCK, BLOCK_SHINGLES = 256, 150_000
BIN = 0.05


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**BAND_ROWS))


def superminhash(hashes: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, ``rows`` by ``m``; a row without elements is all inf.

    Each element draws its own permutation of the m positions, step by step,
    and offers j + r (r uniform in [0, 1)) to the j-th position.  A row is done
    as soon as all its values are below the next j, after one step for long texts.
    """
    signature = np.full(rows * m, np.inf)
    permutation = np.zeros((0, 0), np.uint16)
    for j in range(m):
        if j:
            open_rows = (signature.reshape(rows, m) >= j).any(axis=1)
            keep = open_rows[row]
            if not keep.any():
                break
            if j == 1:
                first = signature_position
                permutation = np.tile(np.arange(m, dtype=np.uint16), (int(keep.sum()), 1))
                at = np.arange(len(permutation))
                permutation[at, first[keep]] = 0
                permutation[:, 0] = first[keep]
            elif not keep.all():
                permutation = permutation[keep]
            hashes, row = hashes[keep], row[keep]
        draw = texts.mix(hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = j + (draw >> np.uint64(32)) * 2.0**-32
        position = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            signature_position = position
        else:
            at = np.arange(len(permutation))
            swapped = permutation[at, position]
            permutation[at, position] = permutation[:, j]
            permutation[:, j] = swapped
            position = swapped.astype(np.int64)
        np.minimum.at(signature, row * m + position, value)
    return signature.reshape(rows, m)


def _names(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit names of every set: the sums of two mixes of its elements."""
    sums = np.zeros((2, len(offsets) - 1), np.uint64)
    if len(sets):
        full = np.diff(offsets) > 0
        for i in range(2):
            sums[i, full] = np.add.reduceat(texts.mix(sets + np.uint64(i + 1)), offsets[:-1][full])
    return sums.view(np.int64)


def _signed(k: int, bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.chunks(batches):
            sets, offsets = texts.shingle_sets(part.column("text"), k)
            sizes = np.diff(offsets)
            full = sizes > 0
            signature = superminhash(sets, np.repeat(np.arange(len(sizes)), sizes), len(sizes), bands * BAND_ROWS)
            bits = signature.view(np.uint64).reshape(len(sizes), bands, BAND_ROWS)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2])
            for i in range(BAND_ROWS):
                band = texts.mix(band * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
            names = _names(sets, offsets)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)), pa.array(band[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(names[0]), pa.array(names[1]), keys], ["id", "n", "h1", "h2", "bands"])

    return run


def _sets_of(k: int):
    """Shingles of the texts that have the set (h1, h2, n) asked for; other texts of the same id are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.chunks(batches):
            sets, offsets = texts.shingle_sets(part.column("text"), k)
            asked = [part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "n")]
            right = np.logical_and.reduce([a == b for a, b in zip(asked, [*_names(sets, offsets), np.diff(offsets)], strict=True)])
            out = pa.RecordBatch.from_arrays([part.column("set"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))], ["set", "shingles"])
            yield out.filter(pa.array(right))

    return run


def _shared(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def _block_links(percent: int):
    """Compares all pairs of a block by one matrix product; returns as few links as join what is linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        sizes = pdf.shingles.str.len().to_numpy()
        _, column = np.unique(np.concatenate(pdf.shingles.to_numpy()), return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        shared = np.zeros((n, n), np.float32)
        step = 20_000
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = int(column[-1]) + 1
        for start in range(0, width, step):
            a, b = np.searchsorted(column, [start, start + step])
            matrix = np.zeros((n, min(step, width - start)), np.float32)
            matrix[row[a:b], column[a:b] - start] = 1
            shared += matrix @ matrix.T
        union = sizes[:, None] + sizes[None, :] - shared
        linked = 100 * shared >= percent * union
        label = np.arange(n)
        while True:  # the least label among a row's links
            least = np.where(linked, label[None, :], n).min(axis=1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        ids = pdf.set.to_numpy()
        joined = label != np.arange(n)
        return pd.DataFrame({"a": ids[joined], "b": ids[label[joined]]})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of ``docs``.

    Two rows are linked when 100 * shared >= percent * union of their sets of
    distinct k-word shingles (a text of fewer words has one shingle, of all its
    words).  component_id is the smallest id that links reach, and kept marks it.

    1.  Every text gets a SuperMinHash signature in bands of four.  Rows with
        equal sets become one set, which gets a number; its smallest id stands for it.
    2.  In every bucket (sets that share a band) each set is compared, on full
        shingle sets, with one centre: the set that shares most buckets.
    3.  Sets that met the same centre and are still apart are compared in
        blocks, again on full sets.  Linked sets lie at most 1 - percent/100
        apart, so blocks whose distances to the centre differ by more are left
        out (Jaccard distance is a metric), as are blocks already in one component.
    4.  Components of all links.

    No step holds a whole group: copies are pre-aggregated, bucket sizes and
    centres are partial aggregates, blocks have a bounded size, and joins on a
    hot key read saved tables, which Spark splits.

    Null and empty texts have an empty set and no links.  A null id is kept as a
    row of its own with its set size, a null component_id and kept true.  Rows that repeat an id
    are returned once each, all in that id's component, which the links of all its texts join.
    Other columns of ``docs`` are ignored.
    """
    ws = Workspace(docs.sparkSession, "neardup")
    bands = bands_for(percent / 100)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = ws.save(given.mapInArrow(_signed(k, bands), "id long, n long, h1 long, h2 long, bands array<long>"))

    # 1. one row a set, numbered as it is written; ids joined to it
    usable = signed.filter("id is not null and n > 0")
    named = usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    numbered = ws.save(named.withColumn("set", F.monotonically_increasing_id()))
    copies = usable.withColumnRenamed("id", "a").join(numbered.filter("rows > 1"), ["h1", "h2", "n"]).filter("a <> id").select("a", F.col("id").alias("b"))
    set_bands = usable.join(numbered, ["h1", "h2", "n", "id"]).select("set", "bands")
    keys = ws.save(set_bands.select(F.col("set").alias("rep"), F.explode("bands").alias("key")).distinct())

    # 2. each set against the centre of each of its buckets
    buckets = ws.save(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    members = ws.save(keys.join(buckets, "key"))
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = ws.save(members.join(weight, "rep").select("key", "rep", "weight"))
    centres = ws.save(weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre")))
    stars = ws.save(weighed.join(centres, "key").filter("rep <> centre").select("rep", "centre").distinct())
    ws.drop(keys, buckets, members, weighed, centres)

    met_sets = stars.select(F.col("rep").alias("set")).union(stars.select("centre")).distinct()
    needed = ws.save(numbered.join(met_sets, "set").select("id", "h1", "h2", "n", "set"))
    held = given.join(needed.hint("shuffle_hash"), "id").select("set", "h1", "h2", "n", "text").mapInArrow(_sets_of(k), "set long, shingles array<long>")
    sets = ws.save(held.groupBy("set").agg(F.max("shingles").alias("shingles")))  # rows may repeat
    side = lambda name: sets.select(F.col("set").alias(name), F.col("shingles").alias(f"{name}_set"))
    shared = stars.join(side("rep"), "rep").join(side("centre"), "centre").select("rep", "centre", _shared(F.col("rep_set"), F.col("centre_set")).alias("shared"), (F.size("rep_set") + F.size("centre_set")).alias("both"), F.size("rep_set").alias("held"))
    met = ws.save(shared.select("rep", "centre", "held", (100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).alias("linked"), (1 - F.col("shared") / (F.col("both") - F.col("shared"))).alias("distance")))
    star_links = met.filter("linked").select(F.col("rep").alias("a"), F.col("centre").alias("b"))

    # 3. sets around one centre that are still apart
    first = components(star_links, ws)
    around = met.join(first.select(F.col("id").alias("rep"), F.col("component").alias("own")), "rep", "left").join(first.select(F.col("id").alias("centre"), F.col("component").alias("home")), "centre", "left")
    around = ws.save(around.select("centre", "rep", "held", F.coalesce(F.col("own") == F.col("home"), F.lit(False)).alias("inner"), F.floor(F.col("distance") / BIN).cast("int").alias("bin")))
    counted = around.groupBy("centre", "inner", "bin").agg(F.count("*").alias("size"), F.sum("held").alias("held")).groupBy("centre").agg(F.collect_list(F.struct("inner", "bin", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("held") / BLOCK_SHINGLES)).cast("int").alias("parts"))).alias("chunks"), F.count_if(~F.col("inner")).alias("open"), F.sum("size").alias("all"))
    chunks = ws.save(counted.filter("open > 0 and all > 1").select("centre", "chunks"))
    reach = math.ceil((1 - percent / 100) / BIN - 1e-9)
    dealt = around.join(chunks, "centre").withColumn("own", F.expr("filter(chunks, c -> c.inner = inner and c.bin = bin)[0].parts"))
    dealt = dealt.withColumn("chunk", F.struct(F.col("inner").alias("inner"), F.col("bin").alias("bin"), F.pmod(F.xxhash64("rep"), F.col("own")).cast("int").alias("part")))
    others = F.expr(f"flatten(transform(filter(chunks, c -> abs(c.bin - bin) <= {reach} and not (c.inner and inner)), c -> transform(sequence(0, c.parts - 1), p -> struct(c.inner as inner, c.bin as bin, p as part))))")
    pairs = dealt.select("centre", "rep", "chunk", F.explode(others).alias("other")).select("centre", F.col("rep").alias("set"), F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    blocks = pairs.join(sets, "set")
    block_links = blocks.groupBy("centre", "low", "high").applyInPandas(_block_links(percent), "a long, b long")

    # 4. all links, from set to set, then of the ids that stand for them
    links = star_links.union(block_links)
    for end in ("a", "b"):
        links = links.join(numbered.select(F.col("set").alias(end), F.col("id").alias(f"{end}_id")), end)
    found = components(copies.union(links.select("a_id", "b_id")).filter("a <> b"), ws)
    out = signed.join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
