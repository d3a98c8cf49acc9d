"""Repeated runs of lines: a suffix array over line numbers by prefix doubling; later copies go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workspace import Workspace

WORD = "[^\\x20\\x09-\\x0D]+"
KEY = ("doc", "version")


def _ranked(keys: DataFrame, columns: list[str], ws: Workspace) -> DataFrame:
    """``keys`` (columns and n, the number of suffixes) with place: how many suffixes sort before the key.

    A sort by ranges; only the sums of the ranges meet in one task.
    """
    ranged = ws.save(keys.repartitionByRange(*columns).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("range").agg(F.sum("n").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    out = ws.save(ranged.join(F.broadcast(shifts), "range").select(*columns, (F.col("shift") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("place")))
    ws.drop(ranged)
    return out


def repeated_runs(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, runs): the line runs of each document that an earlier one holds, as (first, last) line from 0.

    doc is the id (the least bigint for null) and version a hash of the text.

    Lines that occur once end every repeated run, so suffixes are only built of
    the others, up to the next such line or the document's end.  Their ranks start
    as those of single lines and are doubled: the rank of 2n lines is that of the
    pair of ranks n lines apart.  Every suffix asks for its shortest prefix of
    ``min_words`` words; the suffixes that share it (a longest-common-prefix
    interval at that depth, named by two ranks) are copies of a run, all but the first by
    (doc, line) are later copies.  The shortest stretches of ``min_words`` words that END at each line are
    asked for too; both kinds together cover every line of a maximal run.
    Doubling ends at the longest stretch asked for.
    """
    ws = Workspace(docs.sparkSession, "linededup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("line", "said"))
    lines = ws.save(split.select(*KEY, "line", F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"), F.regexp_count("said", F.lit(WORD)).alias("words")))
    again = ws.save(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"))
    first_ranks = _ranked(again, ["h1", "h2"], ws)
    found = ws.save(lines.join(first_ranks, ["h1", "h2"]).select(*KEY, "line", "words", F.col("place").alias("rank")).dropDuplicates([*KEY, "line"]))
    ws.drop(lines, again, first_ranks)

    # how many lines make up min_words: the next line before which so many more words stand
    by_line = Window.partitionBy(*KEY).orderBy("line")
    in_stretch = Window.partitionBy(*KEY, "stretch")
    stretches = found.withColumn("stretch", F.col("line") - F.row_number().over(by_line))
    stretches = stretches.withColumn("before", F.sum("words").over(in_stretch.orderBy("line")) - F.col("words"))
    stretches = stretches.withColumn("end", F.max("line").over(in_stretch) + 1).withColumn("all", F.sum("words").over(in_stretch))
    kinds = [0, 1, 2]  # a line itself, the prefix from it, the stretch that ends with it
    at = F.col("before") + F.when(F.col("kind") == 1, min_words).when(F.col("kind") == 2, F.col("words") - min_words).otherwise(0)
    asked = stretches.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).withColumn("at", at)
    itself = F.col("kind") == 0
    from_behind = in_stretch.orderBy(F.desc("at"), "kind", F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    from_front = in_stretch.orderBy("at", "kind", "line").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("stop", F.last(F.when(itself, F.col("line")), ignorenulls=True).over(from_behind))
    asked = asked.withColumn("start", F.last(F.when(itself, F.struct("line", "before")), ignorenulls=True).over(from_front))
    asked = asked.filter("kind > 0")
    stop = F.coalesce("stop", F.when(F.col("all") - F.col("before") >= min_words, F.col("end")))
    due = asked.filter("kind = 1").select(*KEY, "line", (stop - F.col("line")).alias("depth")).filter("depth > 0")
    # those that are the shortest from their first line are prefixes already
    ending = asked.filter("kind = 2").filter(F.col("before") - F.col("start.before") >= min_words)
    due = due.union(ending.select(*KEY, F.col("start.line").alias("line"), (F.col("line") - F.col("start.line") + 1).alias("depth")))
    asked = ws.save(due)
    suffixes = ws.save(found.select(*KEY, "line", "rank"))
    ws.drop(found)

    deepest = asked.agg(F.max("depth")).first()[0] or 0
    prefixes = []
    length = 1
    while length <= deepest:
        due = asked.filter(f"depth >= {length} and depth < {2 * length}").join(suffixes, [*KEY, "line"]).withColumn("other", F.col("line") + F.col("depth") - length)
        ends = suffixes.select(*KEY, F.col("line").alias("other"), F.col("rank").alias("rank2"))
        exact = due.filter(f"depth = {length}").withColumn("rank2", F.col("rank"))
        columns = [*KEY, "line", "depth", "rank", "rank2"]
        prefixes.append(ws.save(exact.select(columns).union(due.filter(f"depth > {length}").join(ends, [*KEY, "other"]).select(columns))))
        if 2 * length <= deepest:
            ahead = F.when(F.lead("line", length).over(by_line) == F.col("line") + length, F.lead("rank", length).over(by_line)).otherwise(-1)
            paired = suffixes.withColumn("ahead", ahead)
            ranks = _ranked(paired.groupBy("rank", "ahead").agg(F.count("*").alias("n")), ["rank", "ahead"], ws)
            doubled = ws.save(paired.join(ranks, ["rank", "ahead"]).select(*KEY, "line", F.col("place").alias("rank")))
            ws.drop(suffixes)
            suffixes = doubled
        length *= 2
    if not prefixes:
        return suffixes.select(*KEY, F.array().cast("array<struct<first:int,last:int>>").alias("runs")).limit(0)
    copies = prefixes[0]
    for more in prefixes[1:]:
        copies = copies.union(more)
    same = ["depth", "rank", "rank2"]
    place = F.struct(*KEY, "line")
    firsts = ws.save(copies.groupBy(*same).agg(F.min(place).alias("original"), F.count("*").alias("n")).filter("n > 1"))
    later = copies.join(firsts, same).filter(place != F.col("original"))
    # stretches that overlap or touch are one; their lines are never written out one by one
    until = F.max(F.col("line") + F.col("depth")).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    joined = later.groupBy(*KEY, "line").agg(F.max("depth").alias("depth")).withColumn("opens", (F.coalesce(until, F.lit(-1)) < F.col("line")).cast("int"))
    islands = joined.withColumn("island", F.sum("opens").over(by_line)).groupBy(*KEY, "island").agg(F.min("line").alias("first"), F.max(F.col("line") + F.col("depth") - 1).cast("int").alias("last"))
    return islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text", out: str = "removed") -> DataFrame:
    """``docs`` without the later copies of repeated line runs; ``out`` holds the runs removed, as (first, last) line from 0.

    A run is one or more whole lines of ``min_words`` words or more together;
    its first copy by (id, line) stays.  Every line that goes has an equal line earlier, so the
    first of any line is never removed.  Lines are equal by two 64-bit hashes.

    A null text stays null and an empty one empty, with nothing removed; a text of
    which all lines go becomes empty.  A null id sorts before all others.  Rows
    with the same id and text count as one document and get the same result.
    Other columns stay; a column already named ``out`` is replaced.
    """
    ws = Workspace(docs.sparkSession, "linededup-out")
    docs = docs.drop(out)
    runs = ws.save(repeated_runs(docs, min_words, id_col, text_col)).withColumnsRenamed({"doc": "_doc", "version": "_version", "runs": out})
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    version = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.join(runs.hint("shuffle_hash"), (key == F.col("_doc")) & (version == F.col("_version")), "left").drop("_doc", "_version")
    kept = F.expr(f"array_join(filter(split({text_col}, '\n'), (_, i) -> not exists({out}, r -> i between r.first and r.last)), '\n')")
    return joined.withColumn(text_col, F.when(F.col(out).isNull(), F.col(text_col)).otherwise(kept)).withColumn(out, F.coalesce(out, F.array().cast("array<struct<first:int,last:int>>")))
