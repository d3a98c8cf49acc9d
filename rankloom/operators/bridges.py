"""What a corpus offers to link a source with it: titles and snippets of each document, and how well terms are supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.assessments import is_bridge_term, is_bridge_title
from .workspace import Workspace

SNIPPET_TYPES = ["abstract", "introduction", "discussion", "conclusion", "results", "body_other"]


def _first(rows: DataFrame, doc: str, value: Column, order: list[str], most: int, name: str) -> DataFrame:
    """(doc, name): the first ``most`` distinct values of each document, in order.

    Each value's first place is a partial aggregate, and ranks up to ``most`` are cut in every task before
    the shuffle, so a long document never meets in one task as a whole.
    """
    at = F.struct(*order)
    firsts = rows.select(doc, value.alias("_value"), at.alias("_at")).filter("_value is not null").groupBy(doc, "_value").agg(F.min("_at").alias("_at"))
    placed = firsts.withColumn("_place", F.row_number().over(Window.partitionBy(doc).orderBy("_at", "_value"))).filter(F.col("_place") <= most)
    listed = placed.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("_place", "_value"))).alias("_all"))
    return listed.select(doc, F.transform("_all", lambda x: x._value).alias(name))


def bridge_inventory(documents: DataFrame, sections: DataFrame, doc: str, order: list[str], titles: int = 8, snippets: int = 2, words: int = 28, chars: int = 180) -> DataFrame:
    """``documents`` with section_titles (titles that may link sources with the corpus) and section_snippets (beginnings of longer bodies).

    sections: doc, title, text, kind, eligible and the columns of ``order``. Only the first ``titles`` and ``snippets`` distinct ones of a
    document are listed. Documents without any have empty lists.
    """
    title = T.clean_text(F.col("title"))
    body = T.clean_text(F.col("text"))
    short = T.truncate(F.array_join(F.slice(F.split(body, "\\s+"), 1, words), " "), chars)
    fit = F.coalesce(F.col("eligible"), F.lit(True)) & F.coalesce("kind", F.lit("body_other")).isin(SNIPPET_TYPES) & (T.count_words(body) >= 18) & (short != "")
    found = _first(sections, doc, F.when(is_bridge_title(F.col("title")), title), order, titles, "section_titles")
    cut = _first(sections, doc, F.when(fit, short), order, snippets, "section_snippets")
    empty = F.array().cast("array<string>")
    joined = documents.join(found, doc, "left").join(cut, doc, "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("section_titles", "section_snippets")})


def inventory_titles(inventory: DataFrame) -> DataFrame:
    """(title, documents) of all section titles listed."""
    return inventory.select(F.explode("section_titles").alias("title")).groupBy("title").agg(F.count("*").alias("documents"))


def term_support(terms: DataFrame, sections: DataFrame, doc: str, section: str) -> DataFrame:
    """(term, section_hits, doc_hits, title_hits, text_hits, example_titles) of each term (key: its normalised form), as whole words.

    Each place of a section's words goes with as many words as the longest term has, not with the whole text; these windows meet the first words of
    the terms, a shuffle join on the word unless Spark finds the terms small. A section counts once a term, in its title and in its text.
    """
    ws = Workspace(terms.sparkSession, "terms")
    wanted = ws.save(terms.select("term", T.normalize_title(F.col("term")).alias("key")).filter("key <> ''").distinct().withColumn("word", F.substring_index("key", " ", 1)))
    longest = wanted.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    said = sections.select(doc, section, T.clean_text(F.col("title")).alias("shown"), F.explode(F.array(F.struct(F.lit(True).alias("in_title"), T.normalize_title(F.col("title")).alias("said")), F.struct(F.lit(False).alias("in_title"), T.normalize_title(F.col("text")).alias("said")))).alias("part"))
    windows = lambda w: F.array_distinct(F.transform(w, lambda _, i: F.array_join(F.slice(w, i + 1, longest), " ")))
    split = said.select(doc, section, "shown", "part.in_title", F.explode(T.let(F.split("part.said", " "), windows)).alias("window")).withColumn("word", F.substring_index("window", " ", 1))
    pad = lambda c: F.concat(F.col(c), F.lit(" "))
    met = split.join(wanted, "word").filter(F.startswith(pad("window"), pad("key")))
    # read twice below; saved, so that the texts are read once
    each = ws.save(met.groupBy("term", doc, section).agg(F.bool_or("in_title").alias("titled"), F.bool_or(~F.col("in_title")).alias("texted"), F.first("shown").alias("shown")))
    counted = each.groupBy("term").agg(F.count("*").alias("section_hits"), F.count_distinct(doc).alias("doc_hits"), F.count_if("titled").alias("title_hits"), F.count_if("texted").alias("text_hits"))
    examples = each.filter("shown <> ''").groupBy("term", "shown").agg(F.min(F.struct(doc, section)).alias("at"))
    ranked = examples.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("at", "shown"))).filter("place <= 3")
    titles = ranked.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "shown"))), lambda x: x.shown).alias("example_titles"))
    return counted.join(titles, "term", "left")


def heuristic_bridge_terms(candidates: DataFrame, existing: DataFrame, sections: DataFrame, doc: str, section: str, generic: list[str], limit: int = 12) -> DataFrame:
    """The ``limit`` best supported of the candidate terms that are valid and not among the existing ones (term), with rank_score and position.

    Order: documents, titles, texts that hold the term, then the shorter term, then the term itself.
    """
    known = existing.select(T.normalize_title(F.col("term")).alias("key")).distinct()
    fresh = candidates.select(T.clean_text(F.col("term")).alias("term")).distinct().filter(is_bridge_term(F.col("term"), generic, single=True))
    fresh = fresh.withColumn("key", T.normalize_title(F.col("term"))).join(known, "key", "left_anti").drop("key")
    found = term_support(fresh, sections, doc, section)
    words = T.count_words(F.col("term"))
    score = 4.0 * F.col("doc_hits") + 3.0 * F.col("title_hits") + 0.2 * F.least("text_hits", F.lit(20)) + F.when(words.between(2, 4), 1.0).otherwise(0.0)
    order = [F.desc("doc_hits"), F.desc("title_hits"), F.desc("text_hits"), F.length("term"), "term"]
    best = found.withColumn("rank_score", F.round(score, 6)).orderBy(*order).limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))
