"""Search queries made of the turns of conversations, and quotes checked against documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import querying as Q
from ..functions.records import canonical_filters
from .base import query, table

#: Plans: the long words of a benchmark item are primary anchors, those of six and five letters core and object terms.
_KINDS = {"anchors": (7, 99), "core": (6, 6), "objects": (5, 5)}


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    long = lambda a, b: F.filter(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0)), lambda x: F.length(x).between(a, b))
    plans = items.select(F.col("item_id").alias("plan_id"), *[F.array_distinct(long(*size)).alias(k) for k, size in _KINDS.items()])
    n = items.agg(F.count("*").alias("n"))
    base = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " "))
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("de").alias("language"),
        F.when(F.col("turn") % 2 == 0, "match").otherwise("authority").alias("intent"),
        base.alias("base"),
        F.split(base, " ").alias("w"),
    )
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("x"))
    kind = F.col("conv_id") % 5
    text = F.replace(F.replace(F.replace("base", F.lit(". "), F.lit(" and ")), F.lit(", "), F.lit(" or ")), F.lit("."), F.lit(""))
    tail = F.when(kind == 1, F.concat(F.lit(" NOT ("), w(0), F.lit(' or "'), w(1), F.lit(" "), w(2), F.lit('")'))).when(kind == 2, F.concat(F.lit(' not "'), F.concat_ws(" ", w(0), w(1), w(2), w(3)), F.lit('"'))).when(kind == 3, F.concat(F.lit(" "), w(0), F.lit("/"), w(1))).when(kind == 4, F.concat(F.lit(" exper* "), F.coalesce(F.get("objects", F.lit(0)), F.lit("")))).otherwise(F.concat(F.lit(" "), F.coalesce(F.get("anchors", F.lit(0)), F.lit("")), F.lit("s")))
    required = F.when(kind == 0, F.concat(F.lit('+("'), w(0), F.lit('") +('), F.replace("base", F.lit(". "), F.lit(" | ")), F.lit(")"))).when(kind == 1, F.concat(F.lit("+"), w(0), F.lit(' +"'), w(1), F.lit('" -'), w(2), F.lit(' -"x y" -z '), F.col("base"))).when(kind == 2, F.concat(w(0), F.lit(" | "), F.col("base"))).otherwise(F.concat(F.lit("+a "), F.col("base"), F.when(kind == 3, "?").otherwise("")))
    planned = turns.crossJoin(n).join(plans, F.expr("conv_id % n = plan_id"))  # one row of n
    return planned.withColumn("boolean", F.concat(text, tail)).withColumn("required", required).drop("base", "w", "n", "plan_id")


def _match(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({x}, '[-_/\"“”‘’()|,+]+', ' ', 'g'), '\\s+', ' ', 'g')))"


def _found(text: str, terms: str) -> str:
    """Terms are single words here, so their other number is one CASE each."""
    singular = "case when length(t) <= 3 then t when t like '%ies' and length(t) > 4 then t[:-4] || 'y' when regexp_matches(t, '(sses|xes|zes|ches|shes)$') then t[:-3] when regexp_matches(t, 's$') and not regexp_matches(t, '(ss|us|is)$') then t[:-2] else t end"
    plural = "case when t like '%s' then t when regexp_matches(t, '[^aeiou]y$') then t[:-2] || 'ies' when regexp_matches(t, '(x|z|ch|sh)$') then t || 'es' else t || 's' end"
    hay = f"' ' || {_match(text)} || ' '"
    hits = f"list_filter({terms}, lambda t: contains({hay}, ' ' || t || ' ') or (language = 'en' and (contains({hay}, ' ' || {singular} || ' ') or contains({hay}, ' ' || {plural} || ' '))))"
    return f"list_transform(list_sort(list_transform({hits}, lambda t, i: {{'size': -length(t), 'i': i, 't': t}})), lambda s: s.t)"


_SPLIT = {k: f"list_filter(regexp_extract_all(lower(text), '\\pL+'), lambda x: length(x) between {a} and {b})" for k, (a, b) in _KINDS.items()}
_Q = f"""plans as (select item_id as plan_id, {", ".join(f"list_filter({s}, lambda x, i: list_position({s}, x) = i) as {k}" for k, s in _SPLIT.items())} from benchmark),
    turns as (select conv_id, turn, case when conv_id % 2 = 0 then 'en' else 'de' end as language, case when turn % 2 = 0 then 'match' else 'authority' end as intent, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as base from conversations),
    split as (select *, list_concat(string_split(base, ' '), ['x', 'x', 'x', 'x']) as w from turns),
    q as (select conv_id, turn, language, intent, anchors, core, objects,
        replace(replace(replace(base, '. ', ' and '), ', ', ' or '), '.', '') || case conv_id % 5 when 1 then ' NOT (' || w[1] || ' or "' || w[2] || ' ' || w[3] || '")' when 2 then ' not "' || w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4] || '"' when 3 then ' ' || w[1] || '/' || w[2] when 4 then ' exper* ' || coalesce(objects[1], '') else ' ' || coalesce(anchors[1], '') || 's' end as boolean,
        case conv_id % 5 when 0 then '+("' || w[1] || '") +(' || replace(base, '. ', ' | ') || ')' when 1 then '+' || w[1] || ' +"' || w[2] || '" -' || w[3] || ' -"x y" -z ' || base when 2 then w[1] || ' | ' || base else '+a ' || base || case when conv_id % 5 = 3 then '?' else '' end end as required
        from split join plans on plan_id = conv_id % (select count(*) from benchmark))"""


@query(f"""
    with {_Q}, h as (select *, {_found('boolean', 'anchors')} as hits, {_found('required', 'anchors')} as held, len(regexp_extract_all(required, '(?:^|\\s)\\+')) as plus, regexp_matches(required, '\\+\\s*[("]') as quoted, case when intent = 'match' then 2 else 1 end as least from q),
    n as (select *, len(anchors) > 0 and len(hits) = 0 as added, len(anchors) > 0 and (len(held) = 0 or plus < least or not quoted) as filled,
        greatest(least - plus, case when quoted then 0 else 1 end, case when len(held) = 0 and intent = 'match' then least(len(anchors), 2) else 0 end) as needed, list_concat(case when len(held) = 0 then anchors[1:2] else held[1:2] end, anchors) as offered from h),
    c as (select *, (list_filter(offered, lambda x, i: list_position(offered, x) = i))[1:needed] as chosen from n)
    select conv_id, turn, array_to_string(hits, ',') as hits, added, case when added then '(' || array_to_string(list_transform(anchors[1:least], lambda t: '"' || t || '"'), ' OR ') || ') AND (' || trim(boolean) || ')' else boolean end as boolean_query,
        filled and len(chosen) > 0 as filled, case when filled and len(chosen) > 0 then array_to_string(list_transform(chosen, lambda t: '+("' || t || '")'), ' ') || ' AND (' || required || ')' else required end as required_query from c
""")
def anchor_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries(spark, sf_dir)
    args = (F.col("anchors"), F.col("language"), F.col("intent"))
    boolean, added = Q.inject_anchor(F.col("boolean"), *args)
    required, filled = Q.inject_required(F.col("required"), *args)
    hits = F.array_join(Q.found_terms(F.col("boolean"), F.col("anchors"), F.col("language")), ",")
    return q.select("conv_id", "turn", hits.alias("hits"), added.alias("added"), boolean.alias("boolean_query"), filled.alias("filled"), required.alias("required_query"))


@query(f"""
    with {_Q}, h as (select *, len({_found('boolean', 'anchors')}) as primary_hits, len({_found('boolean', 'core')}) + len({_found('boolean', 'objects')}) as core_hits, len(core) + len(objects) as cores from q)
    select conv_id, turn, array_to_string(list_filter([case when len(anchors) + cores > 0 and primary_hits + core_hits = 0 then 'missing_required_anchor' end, case when len(anchors) > 0 and primary_hits = 0 then 'missing_primary_anchor' end, case when intent = 'match' and cores > 0 and core_hits = 0 then 'missing_core_object' end], lambda x: x is not null), ',') as missing from h
""")
def anchor_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = Q.missing_anchors(F.col("boolean"), F.col("language"), F.col("intent"), F.col("anchors"), F.col("core"), F.col("objects"))
    return _queries(spark, sf_dir).select("conv_id", "turn", F.array_join(missing, ",").alias("missing"))


def _slashes(x: str, sign: str) -> str:
    group = f"'(' || replace(w, '/', ' {sign} ') || ')'"
    words = f"array_to_string(list_transform(string_split(s, ' '), lambda w: case when regexp_full_match(w, '[\\pL\\pN_]+(/[\\pL\\pN_]+)+') then {group} else w end), ' ')"
    return f"array_to_string(list_transform(string_split({x}, '\"'), lambda s, i: case when i % 2 = 1 then {words} else s end), '\"')"


def _upper(x: str) -> str:
    s = "s"
    for op in ("AND", "OR", "NOT"):
        s = f"regexp_replace({s}, '\\b{op}\\b', '{op}', 'gi')"
    return f"array_to_string(list_transform(string_split({x}, '\"'), lambda s, i: case when i % 2 = 1 then {s} else s end), '\"')"


_ATOMIC = "length(t) <= 40 and len(string_split(t, ' ')) <= 3 and not regexp_matches(t, '[^\\pL\\pN_\\s-]') and t <> ''"


@query(f"""
    with {_Q}, n as (select *, trim(regexp_replace({_upper(_slashes('boolean', 'OR'))}, '\\s+', ' ', 'g')) as b, trim(regexp_replace({_slashes('required', '|')}, '\\s+', ' ', 'g')) as r from q),
    k as (select conv_id, turn, unnest(regexp_extract_all(r, '{Q.TOKEN}')) as t, unnest(range(len(regexp_extract_all(r, '{Q.TOKEN}')))) as i from n),
    s as (select *, sum(case when t like '%(' then 1 when t = ')' then -1 else 0 end) over (partition by conv_id, turn order by i) as sum from k),
    d as (select *, sum - least(0, min(sum) over (partition by conv_id, turn order by i)) as depth from s),
    bars as (select conv_id, turn, bool_or(contains(t, '|') and not contains(t, '"') and depth = 0 and t not like '%(' and t <> ')') as bar from d group by all),
    x as (select n.*, coalesce(bar, false) as bar, regexp_extract_all(b, '\\bNOT (\\([^()]*\\)|"[^"]*")', 1) as excluded, len(regexp_extract_all(r, '(?:^|\\s)\\+[("\\pL\\pN_]')) as plus, len(regexp_extract_all(r, '(?:^|[\\s(])-\\s*(?:"[^"]+"|[^\\s()|"]+)')) as negative from n left join bars using (conv_id, turn)),
    e as (select *, list_transform(flatten(list_transform(excluded, lambda c: list_filter(regexp_extract_all(c, '[+-]?"[^"]*"?|[^\\s()"]+'), lambda t: lower(t) not in ('and', 'or', 'not')))), lambda t: trim(regexp_replace(t, '^[+-]?"|"$', '', 'g'))) as terms from x)
    select conv_id, turn, b as boolean_query, array_to_string(list_filter([case when contains(b, '?') then 'unsupported_character' end, case when intent <> 'authority' and regexp_matches(b, '[*~]') then 'advanced_syntax' end, case when len(list_filter(terms, lambda t: not ({_ATOMIC}))) > 0 then 'exclusion_not_atomic' end], lambda z: z is not null), ',') as boolean_faults,
        r as required_query, array_to_string(list_filter([case when contains(r, '?') then 'unsupported_character' end, case when not regexp_matches(r, '\\+\\s*[("]') then 'no_anchor' end, case when negative > 2 then 'too_many_negative' end, case when plus > 3 then 'too_many_required' end, case when intent = 'match' and plus < 2 then 'too_few_required' end, case when bar then 'bar_outside_brackets' end], lambda z: z is not null), ',') as required_faults,
        case when intent = 'authority' then 'search' else 'title_and_abstract.search' end as search_field, case when intent = 'authority' then 'cited_by_count:desc' when turn % 4 = 0 then 'relevance_score:desc' end as sort,
        'is_paratext:false,is_retracted:false,language:' || language || case when conv_id % 3 = 0 then ',type:article' else '' end as filters from e
""")
def query_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    field, sort = Q.search_settings(F.lit(None).cast("string"), F.when(F.col("turn") % 4 == 0, "publication_date"), F.col("intent"))
    q = _queries(spark, sf_dir).withColumns({"boolean_query": Q.normalized_boolean(F.col("boolean")), "required_query": Q.normalized_required(F.col("required")), "search_field": field, "sort": sort})
    given = F.concat(F.when(F.col("conv_id") % 3 == 0, "type:article,").otherwise(""), F.lit("is_retracted:false"))
    filters = F.concat_ws(",", F.lit("is_paratext:false,is_retracted:false"), F.concat(F.lit("language:"), "language"), F.nullif(canonical_filters(given, ["type"], []), F.lit("")))
    return q.select(
        "conv_id",
        "turn",
        "boolean_query",
        F.array_join(Q.boolean_faults(F.col("boolean_query"), F.col("search_field")), ",").alias("boolean_faults"),
        "required_query",
        F.array_join(Q.required_faults(F.col("required_query"), F.col("intent")), ",").alias("required_faults"),
        "search_field",
        "sort",
        filters.alias("filters"),
    )


_WORDS = "string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ')"
_FORM = "replace(regexp_replace(regexp_replace(lower(w), '^[\"''()\\[\\]{}<>.,;:!?“”]+|[\"''()\\[\\]{}<>.,;:!?“”]+$', '', 'g'), '^[^\\pL\\pN_]+|[^\\pL\\pN_]+$', '', 'g'), '-', '')"


@query(f"""
    with t as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
    a as (select t.*, regexp_split_to_array(t.text, '\\s') as pieces, trim(case t.doc_id % 5 when 0 then '“' || lower(array_to_string(t.w[4:11], ' ')) || '”' when 1 then array_to_string(t.w[4:11], ' ') || '…' when 2 then array_to_string(t.w[1:3], ' ') when 3 then coalesce(array_to_string(o.w[2:9], ' '), '') else '(' || replace(array_to_string(t.w[5:16], ' '), ' ', '  ') || ');' end) as anchor
        from t left join t as o on o.doc_id = t.doc_id + 1),
    v as (select *, string_split(regexp_replace(anchor, '\\s+', ' ', 'g'), ' ') as needle, trim(regexp_replace(anchor, '\\s+', ' ', 'g')) as given from a),
    f as (select *, chr(1) || array_to_string(list_transform(w, lambda w: {_FORM}), chr(1)) || chr(1) as hay, chr(1) || array_to_string(list_transform(needle, lambda w: {_FORM}), chr(1)) || chr(1) as mark from v),
    p as (select *, case when strpos(hay, mark) > 0 and w <> [''] then length(regexp_replace(hay[1:strpos(hay, mark) - 1], '[^\\x01]+', '', 'g')) end as found, replace(replace(lower(given), '“', '"'), '”', '"') as plain from f),
    r as (select *, case when given = '' then 'empty' when contains(given, '…') or contains(given, '...') then 'ellipsis' when len(needle) < 6 or len(needle) > 14 then 'word_count' when found is not null then 'snapped' when contains(lower(array_to_string(w, ' ')), plain) then 'normalized_substring' else 'not_found_in_evidence' end as reason from p),
    s as (select *, case when reason = 'snapped' then found end as start, case when reason = 'snapped' then len(needle) end as n from r),
    g as (select *, least(len(w), greatest(least(len(w), start + n), start + 8)) as rgt from s),
    x as (select *, least(start, greatest(0, rgt - 8)) as lft from g),
    y as (select *, case when start is not null and least(rgt - lft, 20) >= 8 then lft end as span_start, case when start is not null and least(rgt - lft, 20) >= 8 then least(rgt - lft, 20) end as span_words, list_filter(range(1, len(pieces) + 1), lambda i: pieces[i] <> '') as full_at from x)
    select doc_id, reason, reason in ('snapped', 'normalized_substring') as ok, case when start is not null then array_to_string(w[start + 1:start + n], ' ') else given end as text, span_start::int as span_start, span_words::int as span_words,
        (coalesce(list_sum(list_transform(pieces[1:full_at[span_start + 1] - 1], lambda q: length(q) + 1)), 0) + case when span_start is null then null else 0 end)::int as char_start,
        (coalesce(list_sum(list_transform(pieces[1:full_at[span_start + span_words]], lambda q: length(q) + 1)), 0) - 1 + case when span_start is null then null else 0 end)::int as char_end,
        case when start is not null then array_to_string(w[start + 1:start + greatest(6, least(10, n, 14))], ' ') end as alternative from y
""")
def anchor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said, words = A.single_blanks(F.col("text")), F.col("words")
    part = lambda w, first, n: F.array_join(F.slice(w, first, n), " ")
    others = docs.select((F.col("doc_id") - 1).alias("doc_id"), part(F.split(said, " "), 2, 8).alias("other"))
    kind = F.col("doc_id") % 5
    anchor = (
        F.when(kind == 0, F.concat(F.lit("“"), F.lower(part(words, 4, 8)), F.lit("”")))
        .when(kind == 1, F.concat(part(words, 4, 8), F.lit("…")))
        .when(kind == 2, part(words, 1, 3))
        .when(kind == 3, F.coalesce("other", F.lit("")))
        .otherwise(F.concat(F.lit("("), F.replace(part(words, 5, 12), F.lit(" "), F.lit("  ")), F.lit(");")))
    )
    # columns of their own, so that a text is normalised and split once
    found = docs.join(others, "doc_id", "left").withColumn("said", said).withColumn("words", F.split("said", " ")).withColumn("anchor", F.trim(anchor)).withColumn("total", F.size("words")).drop("words")
    found = found.withColumn("v", A.validate_anchor(F.col("anchor"), F.col("said"), 6, 14))
    left, size = A.expanded(F.col("v.start"), F.col("v.n"), F.col("total"))
    found = found.withColumns({"span_start": left, "span_words": size})
    place = A.place_of_words(F.col("text"), F.col("span_start"), F.col("span_words"))
    found = found.withColumn("place", place).withColumn("alternative", A.shorter_anchor(F.col("said"), F.col("v.start"), F.col("v.n")))
    return found.select("doc_id", "v.reason", "v.ok", "v.text", "span_start", "span_words", F.col("place.start").alias("char_start"), F.col("place.end").alias("char_end"), "alternative")
