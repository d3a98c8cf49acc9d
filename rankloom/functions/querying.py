"""Search queries: Boolean strings as token trees, anchors found in them, put into them, and what is wrong with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import is_atomic_exclusion, reasons
from .text import let

TOKEN = '[+-]?"[^"]*"?|[+-]?\\(|\\)|[^\\s()"]+'
TREE = "array<struct<text:string,kind:string,depth:int>>"
NO_TERMS = "array<string>"

#: Limits of the query syntaxes.
MOST_REQUIRED, MOST_NEGATIVE, MOST_NOTE_WORDS = 3, 2, 18


def tree(query: Column) -> Column:
    """The query's tokens with their kind (open, close, quoted, op, word) and depth, a running sum of the brackets that never falls below 0.
    A bracket has the depth outside it; a sign stays with the bracket or the quote after it."""
    tokens = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(TOKEN), F.lit(0))

    def add(state: Column, token: Column) -> Column:
        opens, closes = F.endswith(token, F.lit("(")), token == ")"
        depth = F.when(closes, F.greatest(state.depth - 1, F.lit(0))).otherwise(state.depth)
        kind = F.when(opens, "open").when(closes, "close").when(F.contains(token, F.lit('"')), "quoted").when(F.lower(token).isin("and", "or", "not"), "op").otherwise("word")
        node = F.struct(token.alias("text"), kind.alias("kind"), depth.alias("depth"))
        return F.struct((depth + F.when(opens, 1).otherwise(0)).alias("depth"), F.concat(state.out, F.array(node)).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast(TREE).alias("out"))
    return F.aggregate(tokens, start, add, lambda s: s.out)


def printed(nodes: Column) -> Column:
    """A tree as a query: tokens with blanks between, none inside a bracket."""
    glued = lambda t, i: (t.kind == "open") | (F.get(nodes, i + 1).kind == "close") | (i == F.size(nodes) - 1)
    return F.array_join(F.transform(nodes, lambda t, i: F.concat(t.text, F.when(glued(t, i), "").otherwise(" "))), "")


def outside_quotes(query: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to what is not between double quotes."""
    return F.array_join(F.transform(F.split(query, '"', -1), lambda s, i: F.when(i % 2 == 0, change(s)).otherwise(s)), '"')


def uppercase_operators(query: Column) -> Column:
    def change(s: Column) -> Column:
        for op in ("AND", "OR", "NOT"):
            s = F.regexp_replace(s, f"(?i)\\b{op}\\b", op)
        return s

    return outside_quotes(query, change)


def expanded_slashes(query: Column, sign: str) -> Column:
    """``a/b`` as a group of alternatives joined by ``sign``, outside quotes; addresses stay."""

    def change(s: Column) -> Column:
        group = lambda w: F.concat(F.lit("("), F.replace(w, F.lit("/"), F.lit(f" {sign} ")), F.lit(")"))
        return F.array_join(F.transform(F.split(s, " ", -1), lambda w: F.when(w.rlike("^[\\p{L}\\p{N}_]+(/[\\p{L}\\p{N}_]+)+$"), group(w)).otherwise(w)), " ")

    return outside_quotes(query, change)


def excluded_terms(nodes: Column) -> Column:
    """The terms after each NOT: the next one, or all of the group that it opens."""

    def leaf(t: Column) -> Column:
        return F.trim(F.regexp_replace(t.text, '^[+-]?"|"$', ""))

    def of(nodes: Column, t: Column, i: Column) -> Column:
        def group(after: Column) -> Column:
            rest = F.slice(nodes, i + 3, F.greatest(F.size(nodes) - i - 2, F.lit(0)))
            end = lambda r: F.array_position(F.transform(r, lambda x: (x.kind == "close") & (x.depth == after.depth)), True).cast("int")
            inside = let(rest, lambda r: let(end(r), lambda e: F.slice(r, 1, F.when(e > 0, e - 1).otherwise(F.size(r)))))
            return F.transform(F.filter(inside, lambda r: r.kind.isin("word", "quoted")), leaf)

        def named(after: Column) -> Column:
            return F.when(after.kind == "open", group(after)).when(after.kind.isin("word", "quoted"), F.array(leaf(after))).otherwise(F.array().cast(NO_TERMS))

        return F.when((t.kind == "op") & (t.text == "NOT"), let(F.get(nodes, i + 1), named)).otherwise(F.array().cast(NO_TERMS))

    # else the tree would be made anew for each of its nodes
    return let(nodes, lambda n: F.flatten(F.transform(n, lambda t, i: of(n, t, i))))


def match_text(x: Column) -> Column:
    """How anchors are compared: hyphens, slashes, quotes, brackets and signs are blanks, all in lower case."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\\\\([\"'])", "$1"), "[-_/\"“”‘’()|,+]+", " ")
    return F.lower(F.trim(F.regexp_replace(plain, "\\s+", " ")))


def singular(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when(n <= 3, word)
        .when(word.rlike("ies$") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(sses|xes|zes|ches|shes)$") & (n > 4), cut(2))
        .when(word.rlike("s$") & ~word.rlike("(ss|us|is)$"), cut(1))
        .otherwise(word)
    )


def plural(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when((n <= 2) | word.rlike("s$"), word)
        .when(word.rlike("[^aeiou]y$"), F.concat(F.substr(word, F.lit(1), n - 1), F.lit("ies")))
        .when(word.rlike("(x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def found_terms(query: Column, terms: Column, language: Column) -> Column:
    """The terms that the query holds as whole words, in English also in the other number; the longest first, each once in any case."""
    hay = F.concat(F.lit(" "), match_text(query), F.lit(" "))
    padded = lambda v: F.concat(F.lit(" "), v, F.lit(" "))
    every = lambda v, f: F.array_join(F.transform(F.split(v, " "), f), " ")

    def held(term: Column) -> Column:
        plain = match_text(term)
        other = F.contains(hay, padded(every(plain, singular))) | F.contains(hay, padded(every(plain, plural)))
        return (plain != "") & (F.contains(hay, padded(plain)) | ((F.lower(language) == "en") & other))

    hits = F.filter(F.transform(F.coalesce(terms, F.array().cast(NO_TERMS)), lambda t: F.trim(t)), held)
    ordered = F.transform(F.array_sort(F.transform(hits, lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("at"), t.alias("term")))), lambda s: s.term)
    return F.filter(ordered, lambda t, i: F.array_position(F.transform(ordered, F.lower), F.lower(t)) == i + 1)


def clean_terms(terms: Column) -> Column:
    return F.filter(F.transform(F.coalesce(terms, F.array().cast(NO_TERMS)), lambda t: F.trim(t)), lambda t: t != "")


def inject_anchor(query: Column, anchors: Column, language: Column, intent: Column) -> tuple[Column, Column]:
    """The Boolean query and whether it changed: without any anchor in it, the first one (two for matches) is required before it."""
    anchors = clean_terms(anchors)
    base = F.trim(F.coalesce(query, F.lit("")))
    needed = (F.size(anchors) > 0) & (F.size(found_terms(base, anchors, language)) == 0)
    chosen = F.slice(anchors, 1, F.when(intent == "match", 2).otherwise(1))
    clause = F.concat(F.lit("("), F.array_join(F.transform(chosen, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("'")), F.lit('"'))), " OR "), F.lit(")"))
    return F.when(needed, F.when(base != "", F.concat(clause, F.lit(" AND ("), base, F.lit(")"))).otherwise(clause)).otherwise(query), needed


def required_parts(query: Column) -> Column:
    return F.regexp_count(F.coalesce(query, F.lit("")), F.lit('(?:^|\\s)\\+[("\\p{L}\\p{N}_]'))


def inject_required(query: Column, anchors: Column, language: Column, intent: Column) -> tuple[Column, Column]:
    """The same for a syntax with required parts: a match needs two of them, any other query one, and one
    in quotes or brackets; what is missing is filled with anchors that the query holds, then with the others."""
    anchors = clean_terms(anchors)
    base = F.trim(F.coalesce(query, F.lit("")))
    hits = found_terms(base, anchors, language)
    match = intent == "match"
    quoted = base.rlike('\\+\\s*[("]')
    plus, least = F.regexp_count(base, F.lit("(?:^|\\s)\\+")), F.when(match, 2).otherwise(1)
    missing = F.size(hits) == 0
    asked = (F.size(anchors) > 0) & (missing | (plus < least) | ~quoted)
    needed = F.greatest(least - plus, F.when(quoted, 0).otherwise(1), F.when(missing & match, F.least(F.size(anchors), F.lit(2))).otherwise(0))
    preferred = F.when(missing, F.slice(anchors, 1, 2)).otherwise(F.slice(hits, 1, 2))
    chosen = F.slice(F.array_distinct(F.concat(preferred, anchors)), 1, needed)
    plain = F.filter(F.transform(chosen, lambda t: F.trim(F.translate(t, '",;', "'  "))), lambda t: t != "")
    changed = asked & (F.size(plain) > 0)
    prefix = F.array_join(F.transform(plain, lambda t: F.concat(F.lit('+("'), t, F.lit('")'))), " ")
    return F.when(changed, F.when(base != "", F.concat(prefix, F.lit(" AND ("), base, F.lit(")"))).otherwise(prefix)).otherwise(query), changed


def missing_anchors(query: Column, language: Column, intent: Column, primary: Column, core: Column, objects: Column) -> Column:
    """What a query lacks of a plan: any anchor at all, a primary one, and for matches a core object."""
    cores = F.array_distinct(F.concat(clean_terms(core), clean_terms(objects)))
    any_of = F.concat(cores, clean_terms(primary))
    lacks = lambda terms: (F.size(terms) > 0) & (F.size(found_terms(query, terms, language)) == 0)
    return reasons(missing_required_anchor=lacks(any_of), missing_primary_anchor=lacks(clean_terms(primary)), missing_core_object=(intent == "match") & lacks(cores))


def _plain(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), "\\\\([\"'])", "$1"))


def normalized_boolean(query: Column) -> Column:
    """Slashes as alternatives, operators in capitals, single blanks."""
    return F.trim(F.regexp_replace(uppercase_operators(expanded_slashes(_plain(query), "OR")), "\\s+", " "))


def boolean_faults(normalized: Column, search_field: Column) -> Column:
    """Why a Boolean query can't be sent: a question mark, wildcards outside the full search, exclusions that are not single terms."""
    excluded = excluded_terms(tree(normalized))
    return reasons(unsupported_character=F.contains(normalized, F.lit("?")), advanced_syntax=(search_field != "search") & normalized.rlike("[*~]"), exclusion_not_atomic=F.exists(excluded, lambda t: ~is_atomic_exclusion(t)))


def normalized_required(query: Column) -> Column:
    return F.trim(F.regexp_replace(expanded_slashes(_plain(query), "|"), "\\s+", " "))


def required_faults(normalized: Column, intent: Column) -> Column:
    """Why a query with required parts can't be sent, in the order in which it is read."""
    plus = required_parts(normalized)
    negative = F.regexp_count(normalized, F.lit('(?:^|[\\s(])-\\s*(?:"[^"]+"|[^\\s()|"]+)'))
    bars = F.exists(tree(normalized), lambda t: (t.kind == "word") & F.contains(t.text, F.lit("|")) & (t.depth == 0))
    return reasons(
        unsupported_character=F.contains(normalized, F.lit("?")),
        no_anchor=~normalized.rlike('\\+\\s*[("]'),
        too_many_negative=negative > MOST_NEGATIVE,
        too_many_required=plus > MOST_REQUIRED,
        too_few_required=(intent == "match") & (plus < 2),
        bar_outside_brackets=bars,
    )


def search_settings(search_field: Column, sort: Column, intent: Column) -> tuple[Column, Column]:
    """The field searched and the order asked for: authorities by citations over everything, matches by relevance."""
    field = F.coalesce(search_field, F.when(intent == "authority", "search").otherwise("title_and_abstract.search"))
    order = F.when(intent == "authority", "cited_by_count:desc").when((intent == "match") & sort.isNotNull(), "relevance_score:desc").otherwise(sort)
    return F.when(field == "default.search", "search").otherwise(field), order


def limit_words(x: Column, most: int = MOST_NOTE_WORDS) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "\\s+", " ")), " "), 1, most), " ")
