"""Literal quotes ("anchors") and the evidence they come from: found word by word whatever the typography, with their place in the original text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .assessments import composed
from .text import let

#: White space as it is in running text, beyond ASCII too.
BLANKS = "\t\n\x0b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that stand for others.
QUOTES_AND_DASHES = {"“": '"', "”": '"', "„": '"', "‟": '"', "’": "'", "‘": "'", "‛": "'", "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-", "‒": "-"}
_MARK = "\u0001"


def plain_blanks(x: Column) -> Column:
    """Each white space character as a plain blank; characters keep their places."""
    return F.translate(F.coalesce(x, F.lit("")), BLANKS, " " * len(BLANKS))


def single_blanks(x: Column) -> Column:
    return F.trim(let(plain_blanks(x), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t)))


def _plain(x: Column) -> Column:
    """Compatibility forms composed (ligatures too), soft hyphens gone, quotes and dashes plain."""
    return F.translate(composed(x), "".join(QUOTES_AND_DASHES) + "­", "".join(QUOTES_AND_DASHES.values()))


def match_form(x: Column) -> Column:
    """Compatibility forms composed (ligatures too), soft hyphens gone, quotes and dashes plain, single blanks."""
    return single_blanks(_plain(F.coalesce(x, F.lit(""))))


def _forms(lines: Column) -> Column:
    """Words as they are compared, one a line: lower case, without punctuation at their ends and without hyphens.

    Lines are stripped all at once, which is far cheaper than word by word.
    """
    low = let(F.lower(lines), lambda x: F.when(F.contains(x, F.lit(" ")), F.regexp_replace(x, "(?md)^ +| +$", "")).otherwise(x))
    return F.replace(F.regexp_replace(low, "(?md)^[^\\p{L}\\p{N}_\n]+|[^\\p{L}\\p{N}_\n]+$", ""), F.lit("-"), F.lit(""))


def word_forms(words: Column) -> Column:
    """Each word as it is compared: lower case, without punctuation at its ends and without hyphens."""
    return F.split(_forms(_plain(F.array_join(words, "\n"))), "\n", -1)


def _place(marked: Column, needle: Column) -> Column:
    """Words before the first place of ``needle`` in ``marked``, both with marks between and around their words; else null."""
    found = lambda at: F.when(at > 0, F.length(F.regexp_replace(F.substr(marked, F.lit(1), at - 1), f"[^{_MARK}]+", "")))
    return let(F.instr(marked, needle), found)


def sequence_start(hay: Column, needle: Column) -> Column:
    """Index from 0 of the first place where the words of ``needle`` stand together in ``hay``, else null."""
    marked = lambda forms: F.concat(F.lit(_MARK), F.array_join(forms, _MARK), F.lit(_MARK))
    return F.when(F.size(needle) > 0, let(marked(hay), lambda h: _place(h, marked(needle))))


def expanded(start: Column, n: Column, total: Column, least: int = 8, most: int = 20) -> tuple[Column, Column]:
    """A span of words grown to ``least`` words, to the right first, and cut at ``most``; null where the text is too short."""
    left = F.greatest(start, F.lit(0))
    right = F.least(total, F.greatest(F.least(total, start + n), left + least))
    left = F.least(left, F.greatest(F.lit(0), right - least))
    size = F.least(right - left, F.lit(most))
    fits = start.isNotNull() & (size >= least)
    return F.when(fits, left), F.when(fits, size)


def place_of_words(text: Column, first: Column, n: Column) -> Column:
    """(start, end) in characters of the original text of ``n`` words from word ``first`` on."""
    pieces = F.split(plain_blanks(text), " ", -1)

    def step(s: Column, piece: Column) -> Column:
        is_word, size = piece != "", F.length(piece)
        return F.struct(
            (s.words + is_word.cast("int")).alias("words"),
            (s.at + size + 1).alias("at"),
            F.when(is_word & (s.words == first), s.at).otherwise(s.start).alias("start"),
            F.when(is_word & (s.words == first + n - 1), s.at + size).otherwise(s.end).alias("end"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("at"), none.alias("start"), none.alias("end"))
    return F.when(first.isNotNull(), F.aggregate(pieces, start, step, lambda s: F.when(s.start.isNotNull(), F.struct(s.start.alias("start"), s.end.alias("end")))))


def validate_anchor(anchor: Column, evidence: Column, least: int, most: int) -> Column:
    """(text, ok, reason, start, n): whether an anchor is literally in the evidence.

    A match word by word gives the anchor as the evidence has it and its words' place; one that only the
    whole normalised text holds has no place. Empty anchors, ellipses and other numbers of words than ``least`` to ``most`` are refused.
    """
    lines = lambda x: _plain(F.replace(single_blanks(x), F.lit(" "), F.lit("\n")))
    # Python's parts (_plain) cannot be inside let()
    texts = F.struct(single_blanks(evidence).alias("said"), single_blanks(anchor).alias("given"), lines(evidence).alias("lines"), lines(anchor).alias("needle"))

    def of(t: Column) -> Column:
        mark = lambda x: F.concat(F.lit(_MARK), F.replace(_forms(x), F.lit("\n"), F.lit(_MARK)), F.lit(_MARK))
        start = F.when(t.said != "", let(mark(t.lines), lambda hay: _place(hay, mark(t.needle))))
        flat = lambda x: F.lower(single_blanks(x))
        within = let(flat(t.needle), lambda n: (n != "") & F.contains(flat(t.lines), n))
        n = F.size(F.split(t.given, " "))
        reason = lambda start, n: (
            F.when(t.given == "", "empty")
            .when(F.contains(t.given, F.lit("…")) | F.contains(t.given, F.lit("...")), "ellipsis")
            .when((n < least) | (n > most), "word_count")
            .when(start.isNotNull(), "snapped")
            .when(within, "normalized_substring")
            .otherwise("not_found_in_evidence")
        )
        judged = let(F.struct(start.alias("start"), n.alias("n")), lambda s: F.struct(s.start.alias("start"), s.n.alias("n"), reason(s.start, s.n).alias("reason")))
        return let(judged, lambda j: result(t, j, j.reason == "snapped"))

    def result(t: Column, j: Column, snapped: Column) -> Column:
        return F.struct(
            F.when(snapped, F.array_join(F.slice(F.split(t.said, " "), j.start + 1, j.n), " ")).otherwise(t.given).alias("text"),
            j.reason.isin("snapped", "normalized_substring").alias("ok"),
            j.reason.alias("reason"),
            F.when(snapped, j.start).alias("start"),
            F.when(snapped, j.n).alias("n"),
        )

    return let(texts, of)


def shorter_anchor(evidence: Column, start: Column, n: Column, least: int = 6, most: int = 14) -> Column:
    """The first words of a span, ten at most and ``least`` at least."""
    take = F.greatest(F.lit(least), F.least(F.lit(10), n, F.lit(most)))
    return F.when(start.isNotNull(), F.array_join(F.slice(F.split(single_blanks(evidence), " "), start + 1, take), " "))
