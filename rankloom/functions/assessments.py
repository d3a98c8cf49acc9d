"""Column expressions that judge titles, terms, calls, headings and runs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import STOP_WORDS, ascii_fold, clean_text, count_words, normalize_title, tokens

#: Titles that say nothing about a section, alone.  Fixed values.
FURNITURE = ["front matter", "contents", "table of contents", "references", "acknowledgments", "acknowledgements", "preface", "title page", "copyright page", "index", "appendix"]
PLAIN_SECTIONS = ["abstract", "introduction", "background", "discussion", "conclusion", "results", "methods", "literature review"]
#: Words that make an anchor term more specific.  Fixed values.
SPECIFIC = ["architecture", "nudging", "confidence", "electronics", "uncertainty", "transparency", "autonomie"]
#: Ranks of a parser's status.  Fixed values.
PARSER_STATUS = {"success": 4, "partial_success": 3, "failure": 2, "error": 1}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2212"


def contains_tokens(hay: Column, needle: Column) -> Column:
    """Whether the tokens of ``needle`` stand side by side in ``hay``; never for no tokens."""
    padded = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(padded(hay), padded(needle))


def is_bridge_title(title: Column) -> Column:
    """2 to 14 words, 120 characters at most, and no furniture or plain section title, numbered or not."""
    shown = clean_text(title)
    low = F.lower(shown)
    plain = low.isin(*FURNITURE, *PLAIN_SECTIONS) | low.rlike("^[0-9]+\\.?\\s+(introduction|discussion|conclusion|results|methods?)$")
    return count_words(shown).between(2, 14) & (F.length(shown) <= 120) & ~plain


def is_low_signal_title(title: Column) -> Column:
    shown = clean_text(title)
    return (shown == "") | F.contains(F.lower(ascii_fold(shown)), F.lit("proof")) | (F.size(tokens(shown)) < 2)


def section_prior(kind: Column, flags: Column, preferred: list[str], penalised: list[str]) -> Column:
    factor = lambda holds, x: F.when(holds, x).otherwise(1.0)
    return factor(kind.isin(preferred), 1.08) * factor(kind.isin(penalised), 0.25) * factor(F.array_contains(flags, "tiny_section"), 0.65) * factor(F.array_contains(flags, "synthetic"), 0.85)


def anchor_term_score(term: Column, origins: Column, generic: list[str]) -> Column:
    """How well a term anchors a search: its length, where it was found, and how specific it is."""
    words = count_words(term)
    parts = F.split(normalize_title(term), " ")
    plus = lambda holds, x: F.when(holds, x).otherwise(0.0)
    found = lambda name: F.array_contains(origins, name)
    length = F.when(words.between(2, 6), 3.0).when(words == 1, 0.5).when(words > 6, -1.0).otherwise(0.0)
    origin = plus(found("title"), 2.0) + plus(found("quote"), 1.8) + plus(found("parenthetical"), 1.5) + plus(found("slash"), 1.2) + plus(found("clause_part") & (words > 4), -1.5)
    special = plus(F.exists(parts, lambda t: t.isin(SPECIFIC)), 0.8) + plus(normalize_title(term).isin(generic), -2.5) + plus(F.forall(parts, lambda t: t.isin(STOP_WORDS)), -4.0) + plus(term.rlike("[^\\x00-\\x7F]"), -0.2)
    return F.round(length + origin + special, 4)


def collapse_spaced_caps(x: Column) -> Column:
    """``D A T A`` becomes ``DATA``: four single capitals or more with blanks between them."""
    pattern = "\\b(?:[A-Z]\\s+){3,}[A-Z]\\b"
    joined = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit("")))
    return F.array_join(F.zip_with(F.split(x, pattern, -1), joined, lambda between, m: F.concat(F.coalesce(between, F.lit("")), F.coalesce(m, F.lit("")))), "")


def doc_type_guess(pages: Column, outline: Column, names: Column) -> Column:
    any_of = lambda *words: F.lower(names).rlike("|".join(words))
    return F.when(pages >= 120, "book_or_long_report").when(any_of("journal", "doi", "accepted manuscript", "abstract"), "scholarly_article").when((outline >= 15) | any_of("contents", "preface", "chapter"), "report_or_book").otherwise("paper_or_report")


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def composed(x: Column) -> Column:
    """Compatibility forms composed; plain ASCII never leaves the JVM's path."""
    marked = F.octet_length(x) > F.length(x)
    return F.when(marked, _composed(F.when(marked, x))).otherwise(x)


def normalize_query_text(x: Column) -> Column:
    """Compatibility forms composed, soft hyphens and invisible characters gone, every hyphen a plain one."""
    return F.translate(F.translate(composed(x), HYPHENS, "-" * len(HYPHENS)), "\u00ad" + INVISIBLE, "")


def citation_label(mode: Column, author: Column, year: Column, free: Column) -> Column:
    """Author and year, the free text, or nothing, by ``mode``; ``auto`` and unknown modes take the first there is."""
    line = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    number = F.when(F.trim(year).rlike("^[0-9]+$"), F.trim(year).cast("int"))
    named = F.when((line(author) != "") & number.isNotNull(), F.concat_ws(", ", line(author), number.cast("string"))).otherwise("")
    return F.when(mode == "none", "").when(mode == "authorYear", named).when(mode == "full", line(free)).otherwise(F.when(named != "", named).otherwise(line(free)))


def display_model(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit("."))


def stored_key(name: Column) -> Column:
    return F.replace(F.coalesce(name, F.lit("")), F.lit("."), F.lit("_"))


def stored_array(values: Column) -> tuple[Column, Column]:
    """An array of arrays as a store without nesting takes it: each inner one as JSON; and whether anything had to be changed."""
    return F.transform(values, lambda v: F.to_json(v)), F.coalesce(F.size(values) > 0, F.lit(False))


def clamped(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(low)), F.lit(low)), F.lit(high)).cast("int")


def known_facets(covered: Column, facets: list[str], most: int = 10) -> Column:
    return F.slice(F.array_distinct(F.filter(covered, lambda f: f.isin(facets))), 1, most)


def rubric_score(topical: Column, evidence: Column, utility: Column, lane_fit: Column, off_topic: Column, insufficient: Column, with_abstract: Column, authority: Column, covered: Column) -> Column:
    """0 to 100 from four grades of 0 to 4 (halves to even), capped for what is off topic, thin, weak in the authority lane, or covers nothing."""
    grade = lambda c: clamped(c, 0, 4)
    score = F.bround((35 * grade(topical) + 25 * grade(evidence) + 25 * grade(utility) + 15 * grade(lane_fit)) / 4.0).cast("int")
    caps = [F.when(off_topic, 25), F.when(insufficient, F.when(with_abstract, 45).otherwise(35)), F.when(authority & (grade(topical) <= 1), 35), F.when(F.size(covered) == 0, 30)]
    return F.greatest(F.lit(0), F.least(score, F.lit(100), *[F.coalesce(c, F.lit(100)) for c in caps]))


def pairwise_winner(winner: Column, a: Column, b: Column) -> Column:
    return F.when(winner == "A", a).when(winner == "B", b).when(winner.isin("tie") | (winner == a) | (winner == b), winner).otherwise("tie")


def evidence_adjustment(support: Column, generic: Column, none: float = 0.08, single: float = 0.03, thin_generic: float = 0.05) -> Column:
    return -(F.when(support <= 0, none).when(support == 1, single).otherwise(0.0) + F.when(generic & (support <= 1), thin_generic).otherwise(0.0))


def generic_bonus(generic: Column, support: Column, anchors: Column, least: float, bonus: float) -> Column:
    return F.when(generic & (support >= 1) & (anchors >= least), bonus).otherwise(0.0)


def calibration_mode(requested: Column, labels: Column, trainer: Column) -> tuple[Column, Column]:
    """The mode in effect and its reason; learned calibration takes labels and a trainer."""
    auto = F.coalesce(requested, F.lit("auto")) == "auto"
    mode = F.when(requested == "disabled", "disabled").when(auto & labels & trainer, "learned_calibration").otherwise("provisional_rules")
    reason = F.when(requested == "disabled", "calibration explicitly disabled").when(requested == "provisional_rules", "provisional rules requested").when(auto & labels & trainer, "labels and trainer available").when(auto & labels, "trainer unavailable").otherwise("labels unavailable")
    return mode, reason


def structure_verdict(truth: Column, matched: Column, missing: Column, extras: Column) -> Column:
    share = matched / F.greatest(truth, F.lit(1))
    return F.when(truth == 0, "needs_manual_review").when((share >= 0.88) & (missing <= 2) & (extras <= 3), "strong").when((share >= 0.72) & (missing <= 6) & (extras <= 8), "acceptable_with_noise").otherwise("needs_follow_up")


def doc_verdict(expected: Column, actual: Column) -> Column:
    return F.when(expected & actual, "true_positive").when(expected, "false_negative").when(actual, "false_positive").otherwise("true_negative")


def why_missed(matched: Column, retrieved: Column, reranked: Column, final: Column, reason: Column, depth: int = 10, last: int = 5) -> Column:
    """Where a judged section was lost, from its ranks after retrieval, reranking and the final choice (null: not there)."""
    within = lambda rank, n: F.coalesce(rank <= n, F.lit(False))
    lost = F.concat(F.lit("phase_g_final_miss::"), F.when(F.coalesce(reason, F.lit("")) == "", "not_in_top_sections").otherwise(reason))
    return F.when(~matched, "phase_c_structure_miss").when(~within(retrieved, depth), "phase_e_retrieval_miss").when(~within(reranked, depth), "phase_f_rerank_miss").when(~within(final, last), lost).otherwise("surfaced_to_phase_g")


def term_match(term: Column, source: Column, anchors: Column, least: float = 0.5) -> Column:
    """How well a term (normalised) is backed: 1 in the source text or equal to an anchor, .92 where one contains the other, else .6 + .3 of
    the share of its words in an anchor, for two words or more; 0 otherwise."""
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    words = F.array_distinct(F.split(term, " "))

    def against(anchor: Column) -> Column:
        shared = F.size(F.array_intersect(words, F.split(anchor, " ")))
        share = shared / F.greatest(F.size(words), F.lit(1))
        inside = F.contains(padded(anchor), padded(term)) | F.contains(padded(term), padded(anchor))
        return F.when(anchor == "", 0.0).when(anchor == term, 1.0).when(inside, 0.92).when((shared >= 2) & (share >= least), F.round(0.6 + 0.3 * share, 4)).otherwise(0.0)

    best = F.coalesce(F.array_max(F.transform(anchors, against)), F.lit(0.0))
    return F.when(term == "", 0.0).when(F.contains(padded(source), padded(term)), 1.0).otherwise(best)


def is_bridge_term(term: Column, generic: list[str], single: bool = False) -> Column:
    """2 to 5 words (or one, if allowed) that neither begin nor end with a stop word, with as many different content words, and no generic phrase."""
    key = normalize_title(term)
    words = F.filter(F.split(key, " "), lambda t: t != "")
    content = F.array_distinct(F.filter(words, lambda t: ~t.isin(STOP_WORDS)))
    least = 1 if single else 2
    return F.coalesce(F.size(words).between(least, 5) & ~key.isin(generic) & ~F.get(words, F.lit(0)).isin(STOP_WORDS) & ~F.element_at(words, -1).isin(STOP_WORDS) & (F.size(content) >= least), F.lit(False))


def precap_terms(*lists: Column, least: int = 4, most: int = 80) -> Column:
    """Terms of all lists in order, the first of those equal but for case, short ones left out."""
    every = F.filter(F.transform(F.flatten(F.array(*lists)), clean_text), lambda t: F.length(t) >= least)
    low = F.transform(every, F.lower)
    return F.slice(F.filter(every, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)


def chosen_points(support: Column, active: Column, most: int) -> Column:
    """Ids of supported sub-points (id, trusted, raw, normalised), the surest first; active ones only if there are any, all active ones if none is supported."""
    ranked = F.transform(F.reverse(F.array_sort(F.transform(support, lambda s: F.struct(s.trusted, s.raw, s.normalised, s.id)))), lambda s: s.id)
    wanted = F.filter(ranked, lambda i: F.array_contains(active, i))
    return F.slice(F.when(F.size(wanted) > 0, wanted).when(F.size(ranked) > 0, ranked).otherwise(active), 1, most)


def parser_rank(status: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in PARSER_STATUS.items():
        out = out.when(status == name, rank)
    return out.otherwise(0)


def segment_limit(pages: Column, seconds: Column, most_pages: int, most_seconds: float) -> Column:
    """Why a task hands over to a continuation; null where it may go on.  0 means no limit."""
    return F.when(F.lit(most_pages > 0) & (pages >= most_pages), "max_pages").when(F.lit(most_seconds > 0) & (seconds >= most_seconds), "max_runtime")


def merged_sources(sources: Column) -> Column:
    """Sources of all records in order, each (provider, query, index, rank, intent, language) once, the first of equals."""
    return F.array_distinct(sources)
