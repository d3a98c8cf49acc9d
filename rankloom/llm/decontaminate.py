"""Benchmark items inside documents: MinHash containment search by item size, exact verification; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.workspace import Workspace

#: Item sizes (distinct shingles, up to), minima kept of an item, and minima that a document must hold to be verified.
#: An item contained to 0.8 has each minimum in the document with probability 0.8, so these miss it less than once in a
#: million times; the smallest items keep every shingle and are not missed at all.
SIZE_CLASSES = ((8, 8, 0.8), (40, 18, 4), (1 << 62, 30, 10))
#: The items' minima or shingles are broadcast if they take at most so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 100_000_000
#: Below it the chances of larger items shrink; their minima are bits of one number.
LEAST_PERCENT = 20


def _class(minima: int, needed: int, percent: int) -> tuple[int, int]:
    """Minima kept and needed: the table's at 80 percent or more; below, as many that a document with ``percent`` of an item misses it less than once in a million times."""
    if percent >= 80:
        return minima, needed
    p = max(percent, LEAST_PERCENT) / 100
    minima = max(minima, math.ceil(-6 / math.log10(1 - p)))
    chances = [math.comb(minima, held) * p**held * (1 - p) ** (minima - held) for held in range(minima)]
    return minima, max(n for n in range(1, minima + 1) if n == 1 or sum(chances[:n]) <= 1e-6)


def _words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(k: int, join: str) -> Column:
    """All k-word shingles of the column ``words``; one of all words where there are fewer, none without words."""
    rest = "".join(f", get(words, i + {j})" for j in range(1, k))
    return F.expr(
        f"case when size(words) >= {k} then transform(slice(words, 1, greatest(size(words) - {k - 1}, 0)), (w, i) -> {join}w{rest}))"
        f" when size(words) > 0 then array({join}array_join(words, ' '))) end"
    )


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, n_shared, n_item, containment) of every document that holds an item.

    A document holds an item if 100 * shared >= percent * the item's distinct k-word
    shingles (words are lower-cased runs of letters and digits; of fewer than k words all together
    are one shingle, so such an item is only found in a text of just these words).

    Items are partitioned by size.  Each keeps the shingles that are least under
    some permutations, more for larger items; how many of them a document holds
    estimates the containment of the item in the document, and does not depend
    on how long the document is.  Pairs with enough are verified on full sets of
    shingles as texts.  Only the few shingles that are some item's minimum leave
    the scan of the documents, and they are combined per pair before the shuffle.

    Documents without text hold nothing; items without words are in nothing.
    Rows that repeat an id count as one document or item; rows with a null id are
    left out.  Below 80 ``percent`` items keep more minima and documents need fewer of them, so that the chances stay, down to 20.
    Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    given = docs.select(F.col(id_col).alias("doc"), _words(text_col).alias("words")).filter("doc is not null")
    wanted = items.select(F.col(item_col).alias("item"), _words(item_text_col).alias("words")).filter("item is not null")
    grams = ws.save(_grams(wanted, k).distinct())
    sizes = grams.groupBy("item").agg(F.count("*").alias("n_item"))
    smallest = f"greatest(1, ceil(n_item * {min(percent, 80)} / 100))"
    classes = [(size, minima, smallest) if needed < 1 else (size, *_class(minima, needed, percent)) for size, minima, needed in SIZE_CLASSES]
    by_size = lambda at: F.expr("case " + " ".join(f"when n_item <= {c[0]} then {c[at]}" for c in classes) + " end")
    classed = sizes.select("item", "n_item", by_size(1).alias("minima"), by_size(2).alias("needed"))
    classed = ws.save(classed)

    # the least shingle under each permutation; the smallest items keep all
    drawn = grams.join(classed, "item").select("item", "n_item", "hash", F.expr(f"case when n_item <= {SIZE_CLASSES[0][0]} then array() else sequence(0, minima - 1) end").alias("turns"))
    minima = drawn.select("item", "hash", F.explode("turns").alias("turn")).groupBy("item", "turn").agg(F.min_by("hash", F.xxhash64("turn", "hash")).alias("hash"))
    every = drawn.filter(F.size("turns") == 0).groupBy("item").agg(F.array_sort(F.collect_set("hash")).alias("all")).select("item", F.posexplode("all").alias("turn", "hash"))
    kept = ws.save(minima.select("hash", "item", "turn").union(every.select("hash", "item", "turn")))
    kept, grams = _small(kept, F.lit(48)), _small(grams, F.octet_length("gram") + 48)

    hashes = given.select("doc", F.explode_outer(_shingles(k, "xxhash64(")).alias("hash"))
    met = hashes.join(kept, "hash").groupBy("doc", "item").agg(F.bit_or(F.expr("shiftleft(1L, turn)")).alias("turns"))
    candidates = ws.save(met.join(classed, "item").filter(F.bit_count("turns") >= F.col("needed")).select("doc", "item", "n_item"))

    texts = given.join(candidates.select("doc").distinct(), "doc", "left_semi")
    held = _grams(texts, k, "doc").join(grams.withColumnRenamed("hash", "item_hash"), "gram").select("doc", "item", "gram").distinct()
    shared = held.groupBy("doc", "item").agg(F.count("*").alias("n_shared")).join(candidates, ["doc", "item"])
    return shared.filter(100 * F.col("n_shared") >= percent * F.col("n_item")).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _small(table: DataFrame, row_bytes: Column) -> DataFrame:
    size = table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _grams(rows: DataFrame, k: int, key: str = "item") -> DataFrame:
    """(key, gram, hash): every shingle as text and as the hash that the scan computes."""
    both = rows.select(key, F.arrays_zip(_shingles(k, "concat_ws(' ', ").alias("gram"), _shingles(k, "xxhash64(").alias("hash")).alias("pairs"))
    # not explode(): for that, Spark adds a filter on the array's size and moves it below the words, which are then made anew for every word
    return both.select(key, F.explode_outer("pairs").alias("p")).select(key, F.col("p.gram").alias("gram"), F.col("p.hash").alias("hash")).filter("gram is not null")
