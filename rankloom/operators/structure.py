"""Headings: what is noise, what wraps others, where a heading stands, and which judged section a produced one is."""

from __future__ import annotations

import heapq
from collections import defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.records import reasons
from .joins import title_similarity as jaccard
from .workspace import Workspace

#: Keys of titles that are furniture, and of those that only wrap others.  Fixed values.
KNOWN_NOISE = "(page|seite) [0-9]+|figure [0-9]+.*|table [0-9]+.*|abbildung [0-9]+.*|tabelle [0-9]+.*|copyright.*|all rights reserved.*|downloaded from.*"
WRAPPERS = "(part|chapter|kapitel|teil|section) ([0-9]+|[ivxlc]+)"
SUPPRESSED_TYPES = ["table_of_contents", "index", "references", "acknowledgements"]


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two texts, by their longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Of two normalised titles: 1 if equal, 0 if either is blank, else the larger of word Jaccard and character ratio."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(jaccard(a, b), sequence_ratio(a, b)))


def noise_reason(title: Column, outline: Column, repeated_pages: Column, most_pages: int = 3) -> Column:
    """Why a proposed heading is none, by the first rule that holds; null for a heading."""
    shown = T.clean_text(title)
    key = T.normalize_title(shown)
    numbered = shown.rlike("^([0-9]+(\\.[0-9]+)*\\.?|[IVXLC]+\\.|[A-Z]\\.)\\s")
    digits = F.regexp_count(shown, F.lit("[0-9]"))
    return (
        F.when(title.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), "control_characters")
        .when(key == "", "empty")
        .when(F.length(shown) < 3, "too_short")
        .when(F.length(shown) > 180, "too_long")
        .when(T.count_words(shown) > 24, "too_many_words")
        .when(shown.rlike("^\\p{Ll}") & ~numbered, "starts_lowercase")
        .when((T.alnum_ratio(shown) < 0.45) & ~numbered, "low_alnum_ratio")
        .when((repeated_pages >= most_pages) & ~outline, "repeated_page_header")
        .when(shown.rlike("(?i)(->|<-|=|<|>|@|\\bvol\\.|\\bno\\.|issn|isbn|doi:)"), "metadata_or_table_signal")
        .when(shown.rlike("^[0-9]+\\.\\s+([A-Z]\\.\\s*){1,4}[A-Z]"), "reference_entry_signal")
        .when(shown.rlike("[*]{2,}|%|±|[βγδ]"), "formula_or_numeric_signal")
        .when((digits >= F.greatest(F.lit(3), F.ceil(F.length(shown) * 0.18))) & ~numbered, "digit_heavy")
        .when(key.rlike(f"^({KNOWN_NOISE})$"), "known_noise_pattern")
    )


def wrapper_reasons(title: Column, kind: Column, words: Column, level: Column, children: Column, most_words: int = 40, most_title_words: int = 3) -> Column:
    """Why a section is not worth retrieving; an empty array where it is."""
    key = T.normalize_title(title)
    tiny = words < 40
    return reasons(
        near_empty_section=words <= 15,
        suppressed_type=kind.isin(SUPPRESSED_TYPES),
        part_or_chapter_wrapper=key.rlike(f"^{WRAPPERS}$") & ((children > 0) | tiny | (words <= 120)),
        tiny_parent_wrapper=(children > 0) & tiny & kind.isin("body_other", "front_matter"),
        micro_section=(level >= 2) & (T.count_words(title) <= most_title_words) & (words <= most_words) & (children == 0) & (kind == "body_other"),
    )


def anchor_headings(proposals: DataFrame, blocks: DataFrame, doc: str, least: float = 0.78) -> DataFrame:
    """(proposal, block, method, confidence): the block that a proposed heading (title, page) stands in.

    Its page's blocks are searched; if there are none, those of the pages beside it; if there are none either, all of the document.  Without a block
    of ``least`` similarity it is the first of its page, if the page has any.
    """
    said = blocks.select(doc, F.col("page").alias("near"), "block", T.normalize_title(F.col("said")).alias("said"))
    asked = proposals.select(doc, "proposal", "page", T.normalize_title(F.col("title")).alias("asked"))
    pages = said.select(doc, "near").distinct()

    def without(rows: DataFrame, page: str) -> DataFrame:
        """Proposals that have no block on any of the pages named."""
        hit = rows.join(pages, [rows[doc] == pages[doc], rows[page] == pages["near"]], "left_semi").select(doc, "proposal").distinct()
        return rows.join(hit, [doc, "proposal"], "left_anti")

    ws = Workspace(blocks.sparkSession, "anchors")
    own = asked.withColumn("near", F.col("page"))
    beside = without(own, "near").withColumn("near", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)))
    nowhere = without(beside, "near").drop("near").dropDuplicates([doc, "proposal"])
    by_page = ws.save(own.withColumn("tier", F.lit(0)).unionByName(beside.withColumn("tier", F.lit(1))).drop("page"))
    nowhere = ws.save(nowhere.drop("page"))

    # a text stands once on a page, with its first block, and is compared once with every title that is looked for there
    near = by_page.select(doc, "near", "asked").distinct().join(said.groupBy(doc, "near", "said").agg(F.min("block").alias("block")), [doc, "near"])
    far = nowhere.select(doc, "asked").distinct().join(said.groupBy(doc, "said").agg(F.min("block").alias("block")), doc)
    pairs = ws.save(near.unionByName(far, allowMissingColumns=True))
    texts = pairs.select("asked", "said").distinct().repartition(F.col("asked"), F.col("said")).withColumn("score", similarity(F.col("asked"), F.col("said")))
    most = F.max_by(F.struct("score", "block"), F.struct("score", (-F.col("block")).alias("b")))
    held = ws.save(pairs.join(texts, ["asked", "said"]).groupBy(doc, "near", "asked").agg(most.alias("most"), F.min("block").alias("first")))
    met = by_page.join(held, [doc, "near", "asked"]).select(doc, "proposal", "tier", "most", "first")
    met = met.unionByName(nowhere.join(held.filter("near is null"), [doc, "asked"]).select(doc, "proposal", F.lit(2).alias("tier"), "most", "first"))
    best = met.groupBy(doc, "proposal").agg(F.max_by("most", F.struct("most.score", (-F.col("most.block")).alias("b"))).alias("most"), F.min(F.when(F.col("tier") == 0, F.col("first"))).alias("first"))
    found = F.col("most.score") >= least
    return best.select(doc, "proposal", F.when(found, F.col("most.block")).otherwise(F.col("first")).alias("block"), F.when(found, "text_match").when(F.col("first").isNotNull(), "page_start").alias("method"), F.round("most.score", 3).alias("confidence"))


def strong_match(similar: Column, overlap: Column, words: Column) -> Column:
    """Whether a produced section is the judged one."""
    return (similar >= 0.92) | (overlap & (similar >= 0.58)) | (overlap & (similar >= 0.42) & (words >= 4))


def strong_pairs(truth: DataFrame, produced: DataFrame, group: str) -> DataFrame:
    """(group, truth, produced, score) of judged (title a, page) and produced sections (title b, at) of a group that match strongly.

    Titles are compared once for each distinct pair of them in a group, not once for each pair of sections.
    """
    titles = truth.select(group, "a").distinct().join(produced.select(group, "b").distinct(), group).select("a", "b").distinct()
    similar = titles.withColumn("similar", similarity(F.col("a"), F.col("b"))).filter("similar >= 0.42")
    overlap = F.abs(F.col("page") - F.col("at")) <= 5
    pairs = truth.join(similar, "a").join(produced, [group, "b"])
    strong = pairs.filter(strong_match(F.col("similar"), overlap, F.size(F.split("a", " "))))
    return strong.select(group, "truth", "produced", F.round(0.8 * F.col("similar") + 0.2 * overlap.cast("int"), 6).alias("score"))


def one_to_one(pairs: DataFrame, group: str) -> DataFrame:
    """Pairs (truth, produced, score) of which every truth and every produced section is in one at most, the best first."""
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (group, "truth", "produced", "score"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used_truth, used_produced, keep = set(), set(), []
        for row in pdf.sort_values(["score", "truth", "produced"], ascending=[False, True, True]).itertuples():
            if row.truth not in used_truth and row.produced not in used_produced:
                used_truth.add(row.truth)
                used_produced.add(row.produced)
                keep.append(row.Index)
        return pdf.loc[keep, [group, "truth", "produced", "score"]]

    return pairs.groupBy(group).applyInPandas(choose, schema)


def matched_sections(truth: DataFrame, produced: DataFrame, group: str) -> DataFrame:
    """``one_to_one`` of ``strong_pairs``, without the pairs, of which there are as many as a group's sections squared.

    Sections of a group with the same title and page have the same scores, so a group is its classes, each with its ids in order, and the
    scores of its titles. From the best score down, the next free judged section takes the first free produced one of any class that has this score with its own.
    """
    titles = ["a", "b"]
    similar = truth.select(group, "a").distinct().join(produced.select(group, "b").distinct(), group).select(titles).distinct()
    similar = similar.withColumn("similar", similarity(F.col("a"), F.col("b"))).filter("similar >= 0.42")
    score = lambda overlap: F.when(strong_match(F.col("similar"), F.lit(overlap), F.size(F.split("a", " "))), F.round(0.8 * F.col("similar") + 0.2 * F.lit(overlap).cast("int"), 6))
    held = truth.select(group, "a").distinct().join(similar, "a").join(produced.select(group, "b").distinct(), [group, "b"])
    scores = held.select(group, *titles, score(True).alias("near"), score(False).alias("apart")).filter("near is not null")
    ids = lambda rows, title, page, own: rows.groupBy(group, F.col(title).alias("title"), F.col(page).cast("double").alias("page")).agg(F.sort_array(F.collect_list(own)).alias("ids"))
    kinds = {c: rows.schema[c].dataType.simpleString() for rows, c in ((truth, group), (truth, "truth"), (produced, "produced"))}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double"
    sides = ids(truth, "a", "page", "truth").withColumnRenamed("ids", "truth").join(ids(produced, "b", "at", "produced").withColumnRenamed("ids", "produced"), [group, "title", "page"], "full")

    def choose(key: tuple, classes: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in _best_first(classes, scored)], columns=[*kinds, "score"])

    return sides.groupBy(group).cogroup(scores.groupBy(group)).applyInPandas(choose, schema)


def _best_first(classes: pd.DataFrame, scored: pd.DataFrame) -> list[tuple]:
    """(truth, produced, score) of one group, as ``matched_sections`` says; a page that is null overlaps none, and its scores are null and last."""
    judged, made = defaultdict(list), defaultdict(list)
    for c in classes.itertuples():
        page = None if pd.isna(c.page) else c.page
        if c.truth is not None:
            judged[c.title].append([page, c.truth.tolist(), 0])
        if c.produced is not None:
            made[c.title].append([page, c.produced.tolist(), 0])
    levels = defaultdict(lambda: defaultdict(list))
    for a, b, near, apart in zip(scored["a"], scored["b"], scored["near"], scored["apart"], strict=True):
        levels[near][a].append((b, 0))
        if not pd.isna(apart):
            levels[apart][a].append((b, 1))
            levels[None][a].append((b, 2))
    used_truth, used_produced, out = set(), set(), []

    def next_free(c: list, used: set):
        while c[2] < len(c[1]) and c[1][c[2]] in used:
            c[2] += 1
        return c[1][c[2]] if c[2] < len(c[1]) else None

    def fits(page: float | None, at: float | None) -> int:
        return 2 if page is None or at is None else int(abs(page - at) > 5)

    for level in sorted(levels, key=lambda s: -1 if s is None else s, reverse=True):
        waiting, partners = [], {}
        for a, others in levels[level].items():
            for i, c in enumerate(judged[a]):
                if (first := next_free(c, used_truth)) is not None:
                    partners[a, i] = [d for b, kind in others for d in made[b] if fits(c[0], d[0]) == kind and next_free(d, used_produced) is not None]
                    waiting.append((first, a, i))
        heapq.heapify(waiting)
        while waiting:
            first, *_ = waiting[0]
            best = None
            while waiting and waiting[0][0] == first:  # an id may stand in more than one class
                _, a, i = heapq.heappop(waiting)
                free = [x for d in partners[a, i] if (x := next_free(d, used_produced)) is not None]
                if not free:
                    continue  # nothing is left for the class at this score
                best = min(free) if best is None else min(best, *free)
                c = judged[a][i]
                c[2] += 1
                if (following := next_free(c, used_truth)) is not None:
                    heapq.heappush(waiting, (following, a, i))
            if best is not None:
                used_truth.add(first)
                used_produced.add(best)
                out.append((first, best, level))
    return out


def exclusion_terms(query: Column) -> Column:
    """Terms of the NOT clauses of a Boolean query: a word, a quoted phrase, or a group without inner groups."""
    clauses = F.regexp_extract_all(query, F.lit('\\bNOT\\s+(\\([^()]*\\)|"[^"]*"|[^\\s()"]+)'), F.lit(1))
    phrases = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))))
    bare = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(F.regexp_replace(c, '"[^"]*"', " "), F.lit("[\\p{L}\\p{N}_-]+"), F.lit(0))))
    return F.concat(phrases, F.filter(bare, lambda t: ~F.upper(t).isin("AND", "OR", "NOT")))


def expand_slashes(query: Column) -> Column:
    """Words joined by a slash become a group of alternatives; quoted phrases, addresses and identifiers stay."""
    word = "[\\p{L}\\p{N}_][\\p{L}\\p{N}_.-]*"

    def outside(segment: Column) -> Column:
        for n in (4, 3, 2):
            pattern = f"(?<![\\p{{L}}\\p{{N}}_./:-]){'/'.join([f'({word})'] * n)}(?![\\p{{L}}\\p{{N}}_/])"
            segment = F.regexp_replace(segment, pattern, "(" + " OR ".join(f"${i + 1}" for i in range(n)) + ")")
        return segment

    parts = F.split(query, '"')
    return F.array_join(F.transform(parts, lambda s, i: F.when((i % 2 == 0) & ~F.contains(s, F.lit("://")) & ~s.rlike("\\b10\\.[0-9]{4,9}/"), outside(s)).otherwise(s)), '"')

