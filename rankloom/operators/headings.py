"""Headings from several sources: proposed, put in place, repaired, merged by precedence, and verified against the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import title_similarity as jaccard
from .structure import sequence_ratio
from .workspace import Workspace

#: Sources of headings and which goes before which.
PRIORITIES = {"outline": 100, "summary": 90, "layout": 80, "numbered_gap_fill": 76, "structural_gap_fill": 74, "recovery": 70, "heuristic": 60}
STRUCTURAL = ["references", "appendix", "acknowledgements", "table_of_contents", "index", "abstract"]
CAPTION = "(?i)^(table|figure|fig\\.?)\\s*[a-z0-9]+([.:)]|\\b)"
NUMBERED = "^[0-9]+(\\.[0-9]+){0,4}[.)]?\\s+[\\p{L}]"
_LEAST_LINES = 6


def display(x: Column) -> Column:
    return F.trim(F.regexp_replace(T.or_empty(x), "\\s+", " "))


def full_key(x: Column) -> Column:
    """The title folded and lower-cased, with its numbering."""
    return F.trim(F.regexp_replace(F.lower(T.ascii_fold(T.or_empty(x))), "[^a-z0-9]+", " "))


def loose_key(x: Column) -> Column:
    """Without its numbering, unless nothing is left then."""
    return F.coalesce(F.nullif(T.heading_key(x), F.lit("")), full_key(x))


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, " "), lambda w: w != ""))


def _half_capital(x: Column) -> Column:
    capitals = F.size(F.filter(F.split(x, " "), lambda w: w.rlike("^\\p{Lu}")))
    return capitals >= F.greatest(F.lit(1), F.ceil(_words(x) / 2))


def _is_upper(x: Column) -> Column:
    return x.rlike("\\p{Lu}") & ~x.rlike("\\p{Ll}")


def _body(x: Column) -> Column:
    return T.section_type(x) == "body_other"


def looks_like_heading(x: Column, body: Column | None = None) -> Column:
    """Up to 18 words and 160 characters without a sentence's end, half of them capitalised, or numbered, in capitals or of a known kind."""

    def of(x: Column) -> Column:
        n = _words(x)
        shape = (n >= 1) & (n <= 18) & (F.length(x) <= 160) & ((T.alnum_ratio(x) >= 0.5) | x.rlike(NUMBERED)) & ~(F.endswith(x, F.lit(".")) & (n > 6))
        return shape & (_half_capital(x) | x.rlike(NUMBERED) | (_is_upper(x) & (n <= 8)) | ~(_body(x) if body is None else body))

    return T.let(display(x), of)


def variants(block: Column) -> Column:
    """What a heading in a block of text may be: all of it, its first lines, what stands before a full stop or a colon, without numbering too."""

    def of_stop(stop: Column) -> Column:
        n = _words(stop)
        return F.when((n >= 2) & (n <= 24) | (n == 1) & (_is_upper(stop) | ~_body(stop)), stop)

    def of_head(head: Column) -> Column:
        m = _words(head)
        return F.when((m >= 2) & (m <= 12) & ~F.endswith(head, F.lit(".")) & (head.rlike(NUMBERED) | _is_upper(head) | _half_capital(head)), head)

    def of_line(said: Column) -> Column:
        before_stop = display(F.regexp_extract(said, "^(.{4,180}?)\\.\\s+[A-Z]", 1))
        head = F.when(F.contains(said, F.lit(":")), display(F.substring_index(said, ":", 1)))
        bare = lambda v: F.array(v, F.when(v.isNotNull(), T.strip_numbering(v)))
        return F.concat(T.let(T.let(before_stop, of_stop), bare), T.let(T.let(head, of_head), bare))

    def of(raw: Column) -> Column:
        lines = F.filter(F.transform(F.split(raw, "\\n+"), display), lambda x: x != "")
        return F.concat(F.array(raw), F.slice(lines, 1, _LEAST_LINES), T.let(display(raw), of_line))

    return F.array_distinct(F.filter(T.let(F.trim(T.or_empty(block)), of), lambda v: v.isNotNull() & (v != "")))


def _with_similarity(pairs: DataFrame, a: str, b: str, out: str, least: float | Column) -> DataFrame:
    """``pairs`` with the similarity of two keys: 1 if equal, else the larger of word overlap and character ratio.

    The ratio is at most 2 * shorter / (both lengths), so only pairs that could reach ``least`` by it, and do
    not yet by their words, go to Python; equal pairs go once. The pairs are saved first, as both sides of a join need them.
    """
    shorter = F.least(F.length(a), F.length(b))
    bound = F.coalesce(F.try_divide(2 * shorter, F.length(a) + F.length(b)), F.lit(0.0))
    words = F.when((F.col(a) == "") | (F.col(b) == ""), 0.0).when(F.col(a) == F.col(b), 1.0).otherwise(jaccard(F.col(a), F.col(b)))
    known = Workspace(pairs.sparkSession, "similar").save(pairs.withColumn("_words", words))
    open_ = known.filter((bound >= least) & (F.col("_words") < 1) & (F.col("_words") < bound)).select(a, b).distinct()
    ratios = open_.withColumn("_ratio", sequence_ratio(F.col(a), F.col(b)))
    return known.join(ratios, [a, b], "left").withColumn(out, F.greatest("_words", F.coalesce("_ratio", F.lit(0.0)))).drop("_words", "_ratio")


def anchor_scores(pairs: DataFrame, title: str = "title", said: str = "said", out: str = "score", least: float = 0.78, penalty: Column | None = None) -> DataFrame:
    """``pairs`` with how well a block holds a title: 1 for the same key, .99 without numbering, .93 if one begins with the other, else their similarity;
    the best of the block's variants, less .18 for captions (unless the title is one) and .2 where ``penalty`` holds.

    Similarities that can't reach ``least`` are left at the words' overlap. A blank title scores 0.
    """
    texts = pairs.select(title, said).distinct()
    keyed = texts.select(title, said, full_key(F.col(title)).alias("_a"), loose_key(F.col(title)).alias("_la"))
    each = keyed.select(title, said, "_a", "_la", F.explode_outer(variants(F.col(said))).alias("_v"))
    each = each.withColumns({"_b": full_key(F.col("_v")), "_lb": loose_key(F.col("_v"))})
    starts = F.startswith("_b", "_a") | F.startswith("_a", "_b") | F.startswith("_lb", "_la") | F.startswith("_la", "_lb")
    exact = F.when((F.col("_a") == "") | (F.coalesce("_b", F.lit("")) == ""), 0.0).when(F.col("_a") == F.col("_b"), 1.0).when(F.col("_la") == F.col("_lb"), 0.99).when(starts, 0.93)
    each = Workspace(pairs.sparkSession, "variants").save(each).withColumn("_exact", exact)
    best = _with_similarity(each.filter("_exact is null"), "_la", "_lb", "_exact2", least).select(title, said, F.col("_exact2").alias("_s"))
    scored = each.filter("_exact is not null").select(title, said, F.col("_exact").alias("_s")).union(best).groupBy(title, said).agg(F.max("_s").alias("_s"))
    first_line = F.get(F.filter(F.transform(F.split(F.col(said), "\\n+"), display), lambda x: x != ""), F.lit(0))
    less = F.when(first_line.rlike(CAPTION) & ~display(F.col(title)).rlike(CAPTION), 0.18).otherwise(0.0)
    if penalty is not None:
        less = less + F.when(penalty, 0.2).otherwise(0.0)
    scored = scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") - less))).drop("_s")
    return pairs.join(scored, [pairs[title].eqNullSafe(scored[title]), pairs[said].eqNullSafe(scored[said])], "left").drop(scored[title]).drop(scored[said])


def repaired_titles(proposals: DataFrame, key: str, title: str = "title", said: str = "said", source: str = "source", least: float = 0.86) -> DataFrame:
    """``proposals`` (one row a key) with the title as its block has it, original_title and repair_score where it was changed.

    A variant of the block that looks like a heading and is no caption replaces the title if it is ``least`` similar, or if it
    begins with the title and has more words (.12 more); a new colon is worth .03. Variants that only cut the title
    short are out, and outlines keep theirs. Ties go to the variant that comes first.
    """
    ws = Workspace(proposals.sparkSession, "titles")
    proposals = ws.save(proposals)
    titles = proposals.select(key, display(F.col(title)).alias("_t"), said, F.col(source).alias("_source")).withColumns({"_a": full_key(F.col("_t")), "_la": loose_key(F.col("_t"))})
    rows = titles.select(key, "_t", "_a", "_la", "_source", F.posexplode(variants(F.col(said))).alias("_at", "_v"))
    rows = rows.withColumn("_v", display(F.col("_v"))).withColumns({"_b": full_key(F.col("_v")), "_lb": loose_key(F.col("_v"))})
    rows = ws.save(rows)  # else every key is computed anew wherever it is named
    upgrade = F.startswith("_b", "_a") & (_words(F.col("_v")) > _words(F.col("_t"))) & (F.length("_v") > F.length("_t"))
    shorter = (_words(F.col("_v")) < _words(F.col("_t"))) & (F.startswith("_a", "_b") | F.startswith("_la", "_lb"))
    fit = (F.col("_t") != "") & ~F.startswith("_source", F.lit("outline")) & (F.col("_v") != F.col("_t")) & (F.col("_b") != "") & ~shorter & looks_like_heading(F.col("_v")) & ~F.col("_v").rlike(CAPTION)
    # a ratio counts where the variant may replace the title by it, or adds to it as an upgrade's score
    near = _with_similarity(rows.filter(fit).withColumn("_upgrade", upgrade), "_a", "_b", "_s", F.when(F.col("_upgrade"), 0.0).otherwise(least))
    kept = near.filter(F.col("_upgrade") | (F.col("_s") >= least))
    colon = F.contains("_v", F.lit(":")) & ~F.contains("_t", F.lit(":"))
    scored = kept.withColumn("_score", F.col("_s") + F.when(F.col("_upgrade"), 0.12).otherwise(0.0) + F.when(colon, 0.03).otherwise(0.0))
    best = scored.groupBy(key).agg(F.max_by(F.struct("_v", "_score", "_t"), F.struct("_score", -F.col("_at"))).alias("_best"))
    joined = proposals.join(best, key, "left")
    changed = F.col("_best").isNotNull()
    return ws.save(joined.withColumns({"original_title": F.when(changed, F.col("_best._t")), "repair_score": F.round("_best._score", 3), title: F.when(changed, F.col("_best._v")).otherwise(display(F.col(title)))}).drop("_best"))


def heuristic_proposals(blocks: DataFrame, doc: str, block: str, said: str) -> DataFrame:
    """(doc, block, source, title) of blocks that look like headings, and of those that fill gaps: numbered ones, and structural ones like references."""
    title = display(F.col(said))
    base = blocks.select(doc, block, title.alias("title")).withColumn("_kind", T.section_type(F.col("title")))
    body, bare = F.col("_kind") == "body_other", T.strip_numbering(F.col("title"))
    numbered = F.col("title").rlike(NUMBERED) & (_words(bare) <= 10) & ~F.col("title").rlike(CAPTION) & ~(F.endswith(bare, F.lit(".")) & (_words(bare) >= 4)) & (~body | _half_capital(bare))
    structural = F.col("_kind").isin(STRUCTURAL)
    found = F.array_compact(F.array(F.when(numbered, F.lit("numbered_gap_fill")), F.when(structural, F.lit("structural_gap_fill")), F.when(looks_like_heading(F.col("title"), body), F.lit("heuristic"))))
    return base.select(doc, block, F.explode(found).alias("source"), "title")


def merged_proposals(proposals: DataFrame, doc: str, block: str = "block", gap: int = 12) -> DataFrame:
    """(doc, block, title, source, level, sources) of the headings that stand, from proposals (doc, block, source, title, fallback).

    In a block, of titles with the same key without numbering the source of the highest priority stands, and
    all that proposed it are named; a proposal that only fell back to its page's first block gives way to any other there, and the
    other way round, by priority. Heuristic proposals only fill gaps: runs of ``gap`` blocks or more
    between two kept headings, or to the document's begin, in which nothing of another source stands.
    """
    order = F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])
    given = proposals.withColumns({"title": display(F.col("title")), "priority": F.coalesce(order[F.col("source")], F.lit(0)), "_key": loose_key(F.col("title"))}).filter("_key <> ''")
    best = [F.desc("priority"), "source", "title"]
    same = Window.partitionBy(doc, block, "_key")
    first = given.withColumns({"_n": F.row_number().over(same.orderBy(*best)), "sources": F.array_sort(F.collect_set("source").over(same))}).filter("_n = 1")
    here = Window.partitionBy(doc, block).orderBy(*best)
    kept = first.withColumn("_out", (F.row_number().over(here) > 1) & (F.col("fallback") | F.first("fallback").over(here))).filter("not _out")

    # gaps between what other sources gave, as islands of heuristic proposals
    solid = F.col("source") != "heuristic"
    along = Window.partitionBy(doc).orderBy(block, F.desc("priority"))
    before = F.coalesce(F.last(F.when(solid, F.col(block)), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    after = F.first(F.when(solid, F.col(block)), ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    placed = kept.withColumns({"_before": before, "_after": after})
    fills = F.col("_after").isNull() | (F.col("_after") - F.col("_before") > gap)
    inside = (F.col(block) != F.col("_before")) & (F.col("_after").isNull() | (F.col(block) != F.col("_after")))
    number = F.regexp_extract("title", "^([0-9]+(\\.[0-9]+){0,4})\\b", 1)
    level = F.when(number != "", F.size(F.split(number, "\\."))).otherwise(1)
    return placed.filter(solid | (fills & inside)).select(doc, block, "title", "source", level.alias("level"), F.array_join("sources", ",").alias("sources"))


def number_prefix(x: Column) -> Column:
    return F.nullif(F.regexp_extract(display(x), "^([0-9]+(\\.[0-9]+){0,4})\\b", 1), F.lit(""))


def _contains_key(a: str, b: str) -> Column:
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return F.contains(pad(a), pad(b))


def verified_outline(outline: DataFrame, pages: DataFrame, visuals: DataFrame, doc: str, least: float = 0.84) -> DataFrame:
    """(doc, entry, title, page, score, evidence) of the outline entries that a page near theirs holds.

    outline: doc, entry, title, page; pages: doc, page, text; visuals: doc, page, title. The page before, the page itself and the one after
    are looked at: a page whose text holds the title's key counts .88 or what a visual heading there or before scored; the last such page
    stands unless a visual heading after it scores more. Else the best visual heading of ``least`` or more does: 1 for equal keys, .985 for the same number and one
    title within the other, .96 for one within the other, else their similarity.
    """
    entries = outline.filter("page > 0").withColumn("_key", loose_key(F.col("title"))).filter("_key <> ''")
    near = entries.withColumn("at", F.explode(F.filter(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1), lambda p: p >= 1))).drop("page")
    texts = pages.select(doc, F.col("page").alias("at"), loose_key(F.col("text")).alias("_text"))
    found = near.join(texts, [doc, "at"]).filter(_contains_key("_text", "_key")).select(doc, "entry", "at")
    seen = visuals.select(doc, F.col("page").alias("at"), F.col("title").alias("_visual"), loose_key(F.col("title")).alias("_vkey")).filter("_vkey <> ''")
    pairs = near.join(seen, [doc, "at"])
    number, other = number_prefix(F.col("title")), number_prefix(F.col("_visual"))
    inside = _contains_key("_vkey", "_key") | _contains_key("_key", "_vkey")
    exact = F.when((number == other) & inside, 0.985).when(F.col("_key") == F.col("_vkey"), 1.0).when(inside, 0.96)
    pairs = pairs.withColumn("_exact", exact)
    scored = _with_similarity(pairs.filter("_exact is null"), "_key", "_vkey", "_s", least).withColumn("_exact", F.round("_s", 4)).drop("_s")
    best = pairs.filter("_exact is not null").unionByName(scored.select(pairs.columns))
    visual = best.groupBy(doc, "entry", "at").agg(F.max("_exact").alias("visual"))
    both = near.join(visual, [doc, "entry", "at"], "left").join(found.withColumn("held", F.lit(True)), [doc, "entry", "at"], "left")
    in_order = Window.partitionBy(doc, "entry").orderBy("at")
    so_far = both.withColumn("_best", F.max("visual").over(in_order))
    text_row = F.max_by(F.struct("at", F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.88)).alias("score")), F.when(F.col("held"), F.col("at")))
    visual_row = F.max_by(F.struct("at", F.col("visual").alias("score")), F.struct("visual", -F.col("at")))
    rows = so_far.groupBy(doc, "entry", "title").agg(F.max("held").alias("held"), text_row.alias("t"), visual_row.alias("v"), F.max("visual").alias("most"))
    beaten = F.coalesce((F.col("v.at") > F.col("t.at")) & (F.col("most") > F.col("t.score")), F.lit(False))
    by_text = F.coalesce(F.col("held"), F.lit(False)) & ~beaten
    picked = F.when(by_text, F.col("t")).when(F.col("most") >= least, F.col("v"))
    out = rows.withColumns({"_p": picked, "evidence": F.when(by_text, "page_text").otherwise("visual_heading")}).filter("_p is not null")
    return out.select(doc, "entry", "title", F.col("_p.at").alias("page"), F.round("_p.score", 4).alias("score"), "evidence")
