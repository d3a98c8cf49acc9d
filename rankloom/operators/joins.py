"""Joins beyond plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import spread


def interval_overlap(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs with equal ``on`` whose closed integer intervals overlap.

    Intervals are dealt to cells of ``width``; a pair meets in the cell where the later one
    starts and only there, so nothing has to be made distinct and a hot key is spread over its cells.
    """
    cells = lambda span: F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width)))
    met = left.withColumn("_cell", cells(left_span)).join(right.withColumn("_cell", cells(right_span)), [*on, "_cell"])
    start = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    return met.filter((start <= F.least(F.col(left_span[1]), F.col(right_span[1]))) & (F.floor(start / width) == F.col("_cell"))).drop("_cell")


def against_all(rows: DataFrame, queries: DataFrame, key: str, block: int = 2000) -> DataFrame:
    """Every row with every row of a stated set of queries, block by block: what is broadcast at once is about ``block`` queries."""
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    parts = [rows.join(F.broadcast(dealt.filter(F.col("_block") == b).drop("_block"))) for b in range(blocks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def array_contains_join(left: DataFrame, ids: str, right: DataFrame, key: str) -> DataFrame:
    """Each left row with each right row whose key is in its array; a key listed twice counts once."""
    return left.withColumn("_key", F.explode(F.array_distinct(ids))).join(right, F.col("_key") == right[key]).drop("_key")


def has_all(rows: DataFrame, group: str, item: str, required: DataFrame) -> DataFrame:
    """(group, complete): whether a group has every required item (relational division)."""
    needed = required.select(item).distinct()
    total = needed.agg(F.count("*").alias("_total"))
    have = rows.join(needed, item, "left_semi").select(group, item).distinct().groupBy(group).agg(F.count("*").alias("_have"))
    every = rows.select(group).distinct().join(have, group, "left").join(F.broadcast(total))
    return every.select(group, (F.coalesce("_have", F.lit(0)) == F.col("_total")).alias("complete"))


def last_wins(rows: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    """One row a key, the last by order."""
    columns = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return best.select(*key, "_row.*")


def duplicate_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file_id, known_id, matched_by): a file is known by its hash, else by name, size and pages; the least known id counts."""
    by_hash = files.join(known.select(F.col("file_id").alias("known_id"), "sha"), "sha").select("file_id", "known_id", F.lit(0).alias("tier"))
    same = ["name", "size", "pages"]
    by_name = files.join(known.select(F.col("file_id").alias("known_id"), *same), same).select("file_id", "known_id", F.lit(1).alias("tier"))
    best = by_hash.union(by_name).groupBy("file_id").agg(F.min(F.struct("tier", "known_id")).alias("best"))
    return best.select("file_id", F.col("best.known_id").alias("known_id"), F.when(F.col("best.tier") == 0, "hash").otherwise("name").alias("matched_by"))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the words of two normalised titles."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def similar_titles(rows: DataFrame, group: list[str], left: str, right: str, title: str, least: float) -> DataFrame:
    """(left, right, similarity) of all pairs of a group, the smaller key left, whose normalised titles are ``least`` similar.

    Titles are compared once in a group, so a pair of rows costs no more than its join. The rows are few beside
    their pairs, so they are spread by number: partitions of a size that Spark aims at would put all pairs into few tasks.
    """
    n = spread(rows.sparkSession)
    titles = rows.select(*group, title).distinct()
    similar = titles.join(titles.withColumnRenamed(title, "_other"), group).withColumn("similarity", title_similarity(F.col(title), F.col("_other"))).filter(F.col("similarity") >= least)
    met = rows.join(similar, [*group, title]).select(*group, left, "_other", "similarity").repartition(n, *group, "_other")
    others = rows.select(*group, F.col(left).alias(right), F.col(title).alias("_other")).repartition(n, *group, "_other")
    return met.join(others, [*group, "_other"]).filter(F.col(left) < F.col(right)).select(left, right, "similarity")
