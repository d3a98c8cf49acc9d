"""Chat formatting in budgeted windows of whole turns, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workspace import Workspace

OPEN, CLOSE = "<s>", "</s>"
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Tokens that a turn's marks take.
MARKS = 4
BLOCK_TURNS = 256


def escape(text: Column) -> Column:
    """``text`` without control strings; unescape() gives it back."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, r"<(?=/?s>|/?\|)", "&lt;")
    return F.regexp_replace(out, r"\[(?=/?INST\])", "&lb;")


def unescape(text: Column) -> Column:
    for entity, character in (("&nl;", "\n"), ("&lb;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"), escape(text), F.lit(CLOSE))


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256, system: int = 256) -> DataFrame:
    """(conv_id, window, text, n_context, loss) from rows of (conv_id, turn, role, text).

    A turn is written ``<s>role\\ntext</s>``; control strings inside role and text
    are escaped, reversibly.  Prefix sums of turn tokens cut a conversation into
    windows of whole turns: a turn goes to the window in whose share of the sum
    its last token falls.  A share is half of the budget that ``history`` and
    ``system`` leave, so a window keeps to the budget unless a turn is longer than
    a share or the system turn is longer than ``system``; such a turn stays whole.

    A later window first repeats the conversation's first system turn and then
    the last turns of the window before that fit in ``history`` tokens.  n_context
    counts these repeated turns.  ``loss`` holds (start, length) of the assistant
    texts, in characters of ``text``; repeated turns are left out, so every
    assistant text is learned once.

    Prefix sums are taken within blocks of turns and then over blocks, so a
    conversation of any length is spread over tasks.  Null roles and texts count
    as empty, rows with a null conv_id as one conversation and null turns as
    first; rows of the same turn are ordered by role and text, repeated rows are
    kept.  Other columns are ignored.
    """
    ws = Workspace(turns.sparkSession, "chat")
    share = (budget - history - system) // 2
    order = ["turn", "role", "text"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))

    in_block = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = ws.save(rows.withColumn("end", F.sum("tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0))).withColumn("number", F.row_number().over(in_block)))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"))
    blocks = ws.save(blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("shift"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    placed = rows.join(blocks, rows.conv_id.eqNullSafe(F.col("b_conv")) & (rows.block == F.col("b_block")))
    placed = placed.select("conv_id", "role", "text", (F.col("number") + F.col("earlier")).alias("number"), (F.col("end") + F.col("shift") - F.col("tokens")).alias("start"), F.floor((F.col("end") + F.col("shift") - 1) / share).alias("window"))
    placed = ws.save(placed.withColumn("said", _turn(F.col("role"), F.col("text"))).withColumn("assistant", F.col("role") == "assistant").withColumn("length", F.when(F.col("assistant"), F.char_length(escape(F.col("text"))))).drop("text"))

    following = Window.partitionBy("conv_id").orderBy("window")
    windows = placed.groupBy("conv_id", "window").agg(F.min("start").alias("first"))
    windows = ws.save(windows.select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), "first", F.lead("window").over(following).alias("next"), F.lead("first").over(following).alias("next_first")))
    heads = ws.save(placed.filter("role = 'system'").groupBy(F.col("conv_id").alias("h_conv")).agg(F.min(F.struct("number", "window", "said")).alias("head")))

    new = placed.select("conv_id", "window", F.lit(2).alias("part"), "number", "said", "length")
    repeated = placed.join(windows.filter("next is not null"), placed.conv_id.eqNullSafe(F.col("w_conv")) & (placed.window == F.col("w_window")))
    repeated = repeated.filter(F.col("start") >= F.col("next_first") - history).join(heads, F.col("conv_id").eqNullSafe(F.col("h_conv")), "left")
    repeated = repeated.filter("head is null or number <> head.number").select("conv_id", F.col("next").alias("window"), F.lit(1).alias("part"), "number", "said", F.lit(None).cast("int").alias("length"))
    retained = windows.join(heads, F.col("w_conv").eqNullSafe(F.col("h_conv"))).filter("w_window > head.window").select(F.col("w_conv").alias("conv_id"), F.col("w_window").alias("window"), F.lit(0).alias("part"), F.col("head.number").alias("number"), F.col("head.said").alias("said"), F.lit(None).cast("int").alias("length"))

    parts = new.union(repeated).union(retained).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("part", "number", "said", "length"))).alias("parts"))
    ends = F.expr("aggregate(parts, array(0), (ends, p) -> concat(ends, array(element_at(ends, -1) + char_length(p.said))))")
    parts = parts.withColumn("ends", ends)
    return parts.select(
        "conv_id",
        "window",
        F.expr("array_join(transform(parts, p -> p.said), '')").alias("text"),
        F.expr("size(filter(parts, p -> p.part < 2))").alias("n_context"),
        # a turn's text ends before its closing mark
        F.expr(f"filter(transform(parts, (p, i) -> struct(ends[i + 1] - {len(CLOSE)} - p.length as start, p.length as length)), s -> s.length is not null)").alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars): every turn once as (role, text), and what the loss mask covers."""
    own = windows.withColumn("own", F.expr(f"slice(split(text, '{CLOSE}'), n_context + 1, greatest(size(split(text, '{CLOSE}')) - 1 - n_context, 0))"))
    own = own.withColumn("covered", F.expr("transform(loss, s -> substring(text, s.start + 1, s.length))"))
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "own", "covered"))).alias("all"), F.sum(F.char_length("text").cast("long")).alias("formatted_chars"))
    role = lambda t: F.substring_index(t, "\n", 1)
    turns = F.transform(F.flatten(F.col("all.own")), lambda t: F.struct(unescape(F.substr(role(t), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(t, F.char_length(role(t)) + 2)).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.transform(F.flatten(F.col("all.covered")), unescape).alias("loss_texts"), "formatted_chars")
