"""Blocks to headings, sections, their tree, and passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(blocks: DataFrame, doc: str, order: str, is_heading: Column) -> DataFrame:
    """(doc, section, first, last): every heading's blocks up to the next heading; what stands before the first is section 0."""
    by_order = Window.partitionBy(doc).orderBy(order)
    numbered = blocks.withColumn("section", F.sum(is_heading.cast("int")).over(by_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "section").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_blocks"))


def parents(headings: DataFrame, doc: str, order: str, level: str, deepest: int = 6) -> DataFrame:
    """``headings`` with parent: the ``order`` of the nearest earlier heading of a smaller level, null at the top.

    One running maximum for each level, of which there are few; then the latest of those above.
    """
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == n, F.col(order))).over(before).alias(f"_last{n}") for n in range(1, deepest)]
    above = F.greatest(*[F.when(F.col(level) > n, F.col(f"_last{n}")) for n in range(1, deepest)], F.lit(None).cast("long"))
    return headings.select("*", *last).withColumn("parent", above).drop(*[f"_last{n}" for n in range(1, deepest)])


def after_first(rows: DataFrame, doc: str, order: str, mark: Column) -> DataFrame:
    """``rows`` with after: whether they come after the document's first marked row."""
    first = F.min(F.when(mark, F.col(order))).over(Window.partitionBy(doc))
    return rows.withColumn("after", F.coalesce(F.col(order) > first, F.lit(False)))


def packed_passages(sections: DataFrame, key: str, text: str, target: int = 180, most: float = 1.35) -> DataFrame:
    """(key, passage, text): lines packed up to ``target`` words; a line of more than target * most words is split at target.

    Packing is greedy, so a section is one step; sections stay in their rows and nothing is shuffled.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, body in zip(pdf["key"], pdf["body"], strict=True):
                pieces = []
                for line in (body or "").split("\n"):
                    w = line.split()
                    step = target if len(w) > target * most else max(1, len(w))
                    pieces += [w[i : i + step] for i in range(0, len(w), step)]
                current: list[str] = []
                passages = []
                for w in pieces:
                    if current and len(current) + len(w) > target:
                        passages.append(current)
                        current = []
                    current = current + w
                passages += [current] if current else []
                out += [(k, i, " ".join(p)) for i, p in enumerate(passages)]
            yield pd.DataFrame(out, columns=["key", "passage", "said"])

    kind = sections.schema[key].dataType.simpleString()
    packed = sections.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInPandas(pack, f"key {kind}, passage int, said string")
    return packed.select(F.col("key").alias(key), "passage", F.col("said").alias("text"))


def _sentences(body: str, most: int) -> list[tuple[str, bool]]:
    """(text, whether it is a piece) of sentences of at most ``most`` characters: longer ones are cut at blanks, and words that are longer still after ``most`` characters."""
    out = []
    for whole in filter(None, re.split(r"(?<=[.!?])\s+", body.strip())):
        s = whole
        while len(s) > most:
            cut = s.rfind(" ", 1, most + 1)
            cut = most if cut < 1 else cut
            out.append((s[:cut], True))
            s = s[cut:].lstrip()
        if s:
            out.append((s, s != whole))
    return out


def overlapping_chunks(rows: DataFrame, key: str, text: str, most: int = 900) -> DataFrame:
    """(key, chunk, text): the sentences of whole texts packed up to ``most`` characters; a chunk begins with the sentence that ended the one
    before, if that had several. So the last sentence of several is also a chunk of its own. Equal sentences that would be chunks one after another are one.

    Sentences that are longer are cut at blanks, so no character but white space between sentences or pieces is lost. Texts without
    any have no chunk.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, body in zip(pdf["key"], pdf["body"], strict=True):
                parts = _sentences(re.sub(r"\s+", " ", body or ""), most)
                kept, first = [], 0
                while first < len(parts):
                    last, size = first, len(parts[first][0])
                    while last + 1 < len(parts) and size + 1 + len(parts[last + 1][0]) <= most:
                        last += 1
                        size += 1 + len(parts[last][0])
                    chunk = " ".join(said for said, _ in parts[first : last + 1])
                    if not kept or kept[-1] != chunk or (parts[first][1] and first == last):
                        kept.append(chunk)
                    first = max(last, first + 1)
                out += [(k, i, c) for i, c in enumerate(kept)]
            yield pd.DataFrame(out, columns=["key", "chunk", "said"])

    kind = rows.schema[key].dataType.simpleString()
    packed = rows.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInPandas(pack, f"key {kind}, chunk int, said string")
    return packed.select(F.col("key").alias(key), "chunk", F.col("said").alias("text"))
