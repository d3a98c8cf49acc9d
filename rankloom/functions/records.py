"""Functions on records, plans and settings: arrays of terms, maps, nested fields, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalised titles that name no work; a blank one does not either.  Fixed values.
JUNK_TITLES = [
    "index", "references", "table of contents", "contents", "editorial", "book review", "book reviews", "bibliography", "preface", "foreword",
    "acknowledgements", "acknowledgments", "conclusion", "conclusions", "introduction",
]


def is_junk_title(normalized: Column) -> Column:
    return normalized.isin("", *JUNK_TITLES)


def is_atomic_exclusion(term: Column) -> Column:
    """At most 40 characters and three words, without punctuation but hyphens."""
    t = F.trim(F.coalesce(term, F.lit("")))
    return (t != "") & (F.length(t) <= 40) & (F.size(F.split(t, "\\s+")) <= 3) & ~t.rlike("[^\\p{L}\\p{N}_\\s-]")


def reasons(**when: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in when.items()]))


def distinct_terms(*lists: Column, most: int | None = None) -> Column:
    """Trimmed terms of all lists without blanks, each once, in order of appearance."""
    flat = F.transform(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), lambda t: F.trim(t))
    out = F.array_distinct(F.filter(flat, lambda t: t != ""))
    return F.slice(out, 1, most) if most else out


def merge_maps(a: Column, b: Column) -> Column:
    """Of both maps' values the longer, the first of equals."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(F.coalesce(F.length(y), F.lit(-1)) > F.coalesce(F.length(x), F.lit(-1)), y).otherwise(x))


def nested_or_dotted(json: Column, path: str) -> Column:
    """The field at a path, or under the path as one literal key."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.get_json_object(json, f"$['{path}']"))


def padded(values: Column, n: int, fill: Column) -> Column:
    """The first n values, filled up where there are fewer."""
    return F.slice(F.concat(values, F.array_repeat(fill, n)), 1, n)


def canonical_filters(filters: Column, allowed: list[str], required: list[str]) -> Column:
    """Comma-separated filters: the required ones first, then those with an allowed name, each once."""
    kept = F.filter(F.transform(F.split(F.coalesce(filters, F.lit("")), ","), lambda t: F.trim(t)), lambda f: F.substring_index(f, ":", 1).isin(allowed))
    return F.array_join(F.array_distinct(F.concat(F.array(*map(F.lit, required)), kept)), ",")


def judge_is_inconsistent(total: Column, notes: Column, markers: list[str]) -> Column:
    """A total of 1 or less although the notes praise."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    return (F.coalesce(total, F.lit(0)) <= 1) & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def citation_parts(x: Column) -> Column:
    """struct(author, year, locator, issues) of a citation such as "Name 2010, p. 5"."""
    pick = lambda pattern, group: F.nullif(F.trim(F.regexp_extract(x, pattern, group)), F.lit(""))
    author, year, locator = pick("^\\s*([\\p{L}' -]+?)[ ,(]+[0-9]{4}", 1), pick("([12][0-9]{3})", 1), pick("(?:p\\.|pp\\.|S\\.)\\s*([0-9]+(?:-[0-9]+)?)", 1)
    return F.struct(author.alias("author"), year.alias("year"), locator.alias("locator"), reasons(no_author=author.isNull(), no_year=year.isNull(), no_locator=locator.isNull()).alias("issues"))


def citation_groups(x: Column) -> Column:
    """Bracketed groups that hold a year, split at semicolons."""
    groups = F.regexp_extract_all(x, F.lit("\\(([^()]*[12][0-9]{3}[^()]*)\\)"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ";"), lambda t: F.trim(t))))


def output_tokens(operation: Column, input_tokens: Column) -> Column:
    """An estimate of the answer's size: a share of the input by operation, from 64 to 4096."""
    share = F.when(operation == "summarize", 0.25).when(operation == "rewrite", 1.1).when(operation == "extract", 0.15).otherwise(0.5)
    return F.least(F.greatest(F.ceil(input_tokens * share), F.lit(64)), F.lit(4096)).cast("long")


def metered_cost(base: float, per_item: float, per_second: float, items: Column, seconds: Column) -> Column:
    nonneg = lambda c: F.greatest(c, F.lit(0))
    return F.round(F.lit(max(base, 0.0)) + max(per_item, 0.0) * nonneg(items) + max(per_second, 0.0) * nonneg(seconds), 8)


def trusted_support(explicit: Column, phrases: Column, title: Column, body: Column, lexical_lanes: Column, view_score: Column) -> Column:
    """struct(trusted, reason): anchors settle it; single words count only beside a lexical lane and a score."""
    lexical = lexical_lanes >= 1
    reason = (
        F.when(explicit > 0, "explicit_anchor")
        .when(phrases > 0, "phrase_anchor")
        .when((title + body >= 2) & lexical & (view_score >= 6), "multi_unigram_plus_lexical")
        .when((title >= 1) & lexical & (view_score >= 10), "title_anchor_plus_lexical")
        .when((body >= 2) & lexical & (view_score >= 6), "body_anchor_plus_lexical")
    )
    return F.struct(reason.isNotNull().alias("trusted"), reason.alias("reason"))
