"""Judging titles, terms, calls, headings and runs; parts, lines and suppliers stand for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assessments as A
from ..functions import text as T
from ..operators import assessment as O
from .base import query, table

_TITLES = ["Introduction", "2. Results", "Trust in online shops", "Page proofs of it", "D A T A and methods", "Index", "A", "Bridging theory and practice", "Über das Vertrauen der Käufer", "  ", "of the", "Chapter four: design"]


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name", F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES) + 1).cast("int")).alias("title"))


_T = f"t as (select p_partkey, p_size, p_brand, p_type, p_name, ({_TITLES!r})[1 + p_partkey % {len(_TITLES)}] as title from part)"
_STOP = ", ".join(repr(w) for w in T.STOP_WORDS)


@query(f"""
    with {_T} select p_partkey, trim(title) <> '' and len(regexp_extract_all(title, '[\\pL\\pN_]+')) between 2 and 14 and lower(trim(title)) not in ('introduction', 'index') and not regexp_matches(lower(trim(title)), '^[0-9]+\\.?\\s+(introduction|discussion|conclusion|results|methods?)$') as bridge,
        contains(lower(title), 'proof') or len(list_filter(regexp_extract_all(lower(replace(replace(title, 'Ü', 'U'), 'ä', 'a')), '[a-z0-9]{{2,}}'), lambda w: w not in ({_STOP}))) < 2 as low_signal,
        replace(title, 'D A T A', 'DATA') as collapsed from t
""")
def title_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return _titled(spark, sf_dir).select("p_partkey", A.is_bridge_title(title).alias("bridge"), A.is_low_signal_title(title).alias("low_signal"), A.collapse_spaced_caps(title).alias("collapsed"))


@query(f"""
    with {_T} select p_partkey, case when p_size >= 48 then 'book_or_long_report' when p_partkey % 4 = 1 then 'scholarly_article' when p_partkey % 4 = 2 or p_size % 20 >= 15 then 'report_or_book' else 'paper_or_report' end as kind from t
""")
def doc_type_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(F.lit("a.pdf"), F.lit("Journal of it.pdf"), F.lit("b Contents.pdf"), F.lit("c.pdf")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _titled(spark, sf_dir).select("p_partkey", A.doc_type_guess(F.col("p_size") * 2.5, F.col("p_size") % 20, names).alias("kind"))


@query("""
    select l_orderkey, l_linenumber, l_partkey, round((case when l_returnflag = 'R' then 1.08 when l_returnflag = 'A' then 0.25 else 1.0 end) * (case when l_quantity <= 5 then 0.65 else 1.0 end) * (case when l_linestatus = 'F' then 0.85 else 1.0 end), 8) as prior from lineitem
""")
def section_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("l_quantity") <= 5, "tiny_section"), F.when(F.col("l_linestatus") == "F", "synthetic")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(A.section_prior(F.col("l_returnflag"), flags, ["R"], ["A"]), 8).alias("prior"))


@query("""
    select p_partkey, round(case when len(string_split(p_type, ' ')) between 2 and 6 then 3.0 when len(string_split(p_type, ' ')) = 1 then 0.5 else -1.0 end + case p_partkey % 3 when 0 then 2.0 when 1 then 1.8 else 1.5 end + case when p_partkey % 2 = 0 then 1.2 else 0 end - case when lower(trim(regexp_replace(p_type, '[^\\pL\\pN]+', ' ', 'g'))) in (select lower(min(p_type)) from part) then 2.5 else 0 end, 4) as score from part
""")
def anchor_term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    generic = parts.agg(F.lower(F.min("p_type"))).first()[0]
    where = F.element_at(F.array(F.lit("title"), F.lit("quote"), F.lit("parenthetical")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return parts.select("p_partkey", A.anchor_term_score(F.col("p_type"), F.array_compact(F.array(where, F.when(F.col("p_partkey") % 2 == 0, "slash"))), [generic]).alias("score"))


@query("""
    select s_suppkey, case s_suppkey % 5 when 0 then '' when 1 then case when s_nationkey % 2 = 0 then s_name || ', ' || (1990 + s_nationkey) else '' end when 2 then 'free ' || s_suppkey else case when s_nationkey % 2 = 0 then s_name || ', ' || (1990 + s_nationkey) else 'free ' || s_suppkey end end as label,
        replace('gpt_4' || s_suppkey || '_1', '_', '.') as shown, 'v1_' || s_suppkey || '_2' as stored from supplier
""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ["none", "authorYear", "full", "auto", "other"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    year = F.when(F.col("s_nationkey") % 2 == 0, (1990 + F.col("s_nationkey")).cast("string")).otherwise("n.d.")
    label = A.citation_label(mode, F.col("s_name"), year, F.concat(F.lit(" free  "), F.col("s_suppkey").cast("string")))
    key = lambda a, b: F.concat(F.lit(a), F.col("s_suppkey").cast("string"), F.lit(b))
    return table(spark, sf_dir, "supplier").select("s_suppkey", label.alias("label"), A.display_model(key("gpt_4", "_1")).alias("shown"), A.stored_key(key("v1.", ".2")).alias("stored"))


@query("""
    with r as (select l_orderkey, l_linenumber, l_partkey, l_linenumber as topical, (l_quantity / 10)::int as evidence, (l_tax * 50)::int as utility, l_linenumber % 5 as fit, l_returnflag = 'R' as off_topic, l_linestatus = 'F' as thin, l_partkey % 2 = 0 as pool, l_suppkey % 2 = 0 as lane,
            list_distinct(list_filter(['f' || (l_partkey % 4), 'f' || (l_suppkey % 4), 'x'], lambda f: f in ('f0', 'f1', 'f2'))) as covered from lineitem),
    s as (select *, round_even((35 * least(topical, 4) + 25 * least(evidence, 4) + 25 * least(utility, 4) + 15 * least(fit, 4)) / 4.0, 0)::int as base from r)
    select l_orderkey, l_linenumber, l_partkey, least(base, case when off_topic then 25 else 100 end, case when thin then case when pool then 45 else 35 end else 100 end, case when lane and least(topical, 4) <= 1 then 35 else 100 end, case when len(covered) = 0 then 30 else 100 end) as score, len(covered)::int as n_covered from s
""")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    facet = lambda c: F.concat(F.lit("f"), (F.col(c) % 4).cast("string"))
    rows = lines.withColumn("covered", A.known_facets(F.array(facet("l_partkey"), facet("l_suppkey"), F.lit("x")), ["f0", "f1", "f2"]))
    utility = F.bround(F.col("l_tax") * 50).cast("int")
    evidence = F.bround(F.col("l_quantity") / 10).cast("int")
    score = A.rubric_score(F.col("l_linenumber"), evidence, utility, F.col("l_linenumber") % 5, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 2 == 0, F.col("covered"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"), F.size("covered").alias("n_covered"))


@query("""
    select event_id, case event_id % 5 when 0 then 'u' || user_id when 1 then 'e' || event_id when 2 then 'tie' when 3 then 'u' || user_id else 'tie' end as winner, least(greatest(event_id % 7 - 1, 0), 3)::int as confidence from events
""")
def pairwise_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("e"), F.col("event_id").cast("string"))
    said = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie"), a, F.lit("nobody")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", A.pairwise_winner(said, a, b).alias("winner"), A.clamped(F.col("event_id") % 7 - 1, 0, 3).alias("confidence"))


@query("""
    with s as (select l_orderkey, count(*) as n, max(l_quantity) > 45 as generic, sum(l_discount) as anchors from lineitem group by 1)
    select l_orderkey, round(-(case when n = 1 then 0.03 else 0 end + case when generic and n <= 1 then 0.05 else 0 end), 6) as adjustment, case when generic and n >= 1 and round(anchors, 6) >= 0.2 then 0.04 else 0 end as bonus from s
""")
def evidence_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.max("l_quantity") > 45).alias("generic"), F.round(F.sum("l_discount"), 6).alias("anchors"))
    return s.select("l_orderkey", F.round(A.evidence_adjustment(F.col("n"), F.col("generic")), 6).alias("adjustment"), A.generic_bonus(F.col("generic"), F.col("n"), F.col("anchors"), 0.2, 0.04).alias("bonus"))


@query("""
    with p as (select p_partkey, case p_partkey % 4 when 0 then 'disabled' when 1 then 'provisional_rules' when 2 then 'auto' end as mode, p_size % 2 = 0 as labels, p_size % 3 = 0 as trainer from part)
    select p_partkey, case when mode = 'disabled' then 'disabled' when coalesce(mode, 'auto') = 'auto' and labels and trainer then 'learned_calibration' else 'provisional_rules' end as effective,
        case when mode = 'disabled' then 'calibration explicitly disabled' when mode = 'provisional_rules' then 'provisional rules requested' when labels and trainer then 'labels and trainer available' when labels then 'trainer unavailable' else 'labels unavailable' end as reason from p
""")
def calibration_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = F.element_at(F.array(F.lit("disabled"), F.lit("provisional_rules"), F.lit("auto"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    mode, reason = A.calibration_mode(requested, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", mode.alias("effective"), reason.alias("reason"))


@query("""
    with s as (select l_orderkey, count(*) as truth, count_if(l_quantity > 10) as matched, count_if(l_quantity <= 10) as missing, count_if(l_returnflag = 'R') as extras from lineitem group by 1)
    select l_orderkey, case when matched / greatest(truth, 1) >= 0.88 and missing <= 2 and extras <= 3 then 'strong' when matched / greatest(truth, 1) >= 0.72 and missing <= 6 and extras <= 8 then 'acceptable_with_noise' else 'needs_follow_up' end as verdict from s
""")
def structure_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("truth"), F.count_if(F.col("l_quantity") > 10).alias("matched"), F.count_if(F.col("l_quantity") <= 10).alias("missing"), F.count_if(F.col("l_returnflag") == "R").alias("extras"))
    return s.select("l_orderkey", A.structure_verdict(F.col("truth"), F.col("matched"), F.col("missing"), F.col("extras")).alias("verdict"))


_KEY = "section, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"
_RANKS = f"""s as (select l_orderkey as doc, l_linenumber as section, l_partkey, l_suppkey, l_quantity, l_discount, l_tax from lineitem),
    i as (select *, case when l_quantity > 10 then row_number() over (partition by doc, l_quantity > 10 order by l_quantity desc, {_KEY}) end as e_rank,
        case when l_discount > 0.02 then row_number() over (partition by doc, l_discount > 0.02 order by l_discount desc, {_KEY}) end as f_rank,
        case when l_tax > 0.01 then row_number() over (partition by doc, l_tax > 0.01 order by l_tax desc, {_KEY}) end as g_rank from s)"""


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    steps = {"e_rank": ("l_quantity", 10), "f_rank": ("l_discount", 0.02), "g_rank": ("l_tax", 0.01)}
    return O.inspection(lines, "doc", _KEY.split(", "), {name: (F.col(c) > least, F.desc(c)) for name, (c, least) in steps.items()})


@query(f"""
    with {_RANKS} select doc, section, l_partkey, l_suppkey, e_rank, f_rank, g_rank, case when section = 7 then 'phase_c_structure_miss' when coalesce(e_rank, 99) > 3 then 'phase_e_retrieval_miss' when coalesce(f_rank, 99) > 3 then 'phase_f_rerank_miss'
        when coalesce(g_rank, 99) > 2 then 'phase_g_final_miss::' || case when doc % 2 = 0 then 'low_probability' else 'not_in_top_sections' end else 'surfaced_to_phase_g' end as status from i
""")
def section_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of every section after each step, and where the judged ones were lost."""
    reason = F.when(F.col("doc") % 2 == 0, "low_probability").otherwise("")
    status = A.why_missed(F.col("section") != 7, F.col("e_rank"), F.col("f_rank"), F.col("g_rank"), reason, 3, 2)
    return _inspected(spark, sf_dir).select("doc", "section", "l_partkey", "l_suppkey", "e_rank", "f_rank", "g_rank", status.alias("status"))


@query(f"""
    with {_RANKS} select doc, case when bool_or(l_partkey % 10 = 0) then case when bool_or(g_rank <= 2) then 'true_positive' else 'false_negative' end when bool_or(g_rank <= 2) then 'false_positive' else 'true_negative' end as verdict,
        count(*) filter (l_partkey % 10 = 0) as expected, count(*) filter (l_partkey % 10 = 0 and e_rank <= 3) as e_hits, count(*) filter (l_partkey % 10 = 0 and f_rank <= 3) as f_hits, count(*) filter (l_partkey % 10 = 0 and g_rank <= 2) as g_hits, max(case when l_partkey % 10 = 0 then case when l_suppkey % 10 >= 8 then 3 else 2 end end)::int as label from i group by doc
""")
def judgement_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every document and its judged sections found after each step; parts divisible by ten stand for judged sections."""
    rows = _inspected(spark, sf_dir).withColumn("expected", F.col("l_partkey") % 10 == 0).withColumn("usefulness", F.col("l_suppkey") % 10)
    return O.judged_documents(rows, "doc", "expected", "usefulness", {"e": ("e_rank", 3), "f": ("f_rank", 3), "g": ("g_rank", 2)})


@query(f"""
    with {_T}, a as (select p_brand, list_sort(list(distinct lower(p_type))) as anchors from part group by 1), w as (select t.p_partkey, string_split(lower(title), ' ')[1] || ' ' || lower(p_type) as term, anchors from t join a using (p_brand)),
    x as (select p_partkey, term, list_max(list_transform(anchors, lambda k: case when k = term then 1.0 when contains(' ' || k || ' ', ' ' || term || ' ') or contains(' ' || term || ' ', ' ' || k || ' ') then 0.92
        when len(list_intersect(list_distinct(string_split(term, ' ')), string_split(k, ' '))) >= 2 and len(list_intersect(list_distinct(string_split(term, ' ')), string_split(k, ' '))) / len(list_distinct(string_split(term, ' '))) >= 0.5 then round(0.6 + 0.3 * len(list_intersect(list_distinct(string_split(term, ' ')), string_split(k, ' '))) / len(list_distinct(string_split(term, ' '))), 4) else 0.0 end)) as score from w)
    select p_partkey, score::double as score from x
""")
def term_source_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _titled(spark, sf_dir).withColumn("anchor", F.lower("p_type"))
    anchors = parts.groupBy("p_brand").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    term = F.concat_ws(" ", F.element_at(F.split(F.lower("title"), " "), 1), F.col("anchor"))
    return parts.join(anchors, "p_brand").select("p_partkey", A.term_match(term, F.lit(""), F.col("anchors")).alias("score"))


@query(f"""
    with {_T}, w as (select p_partkey, list_filter(string_split(trim(regexp_replace(lower(title), '[^\\pL\\pN]+', ' ', 'g')), ' '), lambda t: t <> '') as w from t)
    select p_partkey, coalesce(len(w) between 2 and 5 and w[1] not in ({_STOP}) and w[-1] not in ({_STOP}) and len(list_distinct(list_filter(w, lambda t: t not in ({_STOP})))) >= 2 and array_to_string(w, ' ') <> 'trust in online shops', false) as valid from w
""")
def bridge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("p_partkey", A.is_bridge_term(F.col("title"), ["trust in online shops"]).alias("valid"))


@query("""
    with q as (select p_partkey, lower(p_type) as said from part), a as (select distinct string_split(lower(p_type), ' ')[1] as anchor from part), n as (select count(*) as n from part)
    select anchor, count(*) as queries, count(*) > 0 and count(*) < max(n) and count(*) / max(n) < 0.9 as variable from a, n, q where contains(said, anchor) group by anchor
""")
def variable_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that some queries hold but nowhere near all."""
    queries = table(spark, sf_dir, "part").select(F.lower("p_type").alias("said"))
    return O.anchor_shares(queries, "said", queries.select(F.element_at(F.split("said", " "), 1).alias("anchor")).distinct())


@query("""
    select p_partkey, array_to_string(list_filter(case when p_partkey % 2 = 0 then [p_type, p_name] else [p_name, p_type] end, lambda t: length(t) >= 4), '|') as terms from part
""")
def precap_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    both = F.when(even, F.array("p_type", "p_name")).otherwise(F.array("p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.precap_terms(both, F.array(F.upper("p_type"), F.lit("abc"))), "|").alias("terms"))


@query("""
    with s as (select l_orderkey, list({'t': l_quantity > 25, 'r': l_extendedprice, 'n': l_discount, 'i': l_suppkey} order by l_quantity > 25 desc, l_extendedprice desc, l_discount desc, l_suppkey desc) as s from lineitem group by 1),
    w as (select l_orderkey, list_transform(s, lambda x: x.i) as ranked, list_filter(list_transform(s, lambda x: x.i), lambda i: i % 3 = l_orderkey % 3) as wanted from s)
    select l_orderkey, array_to_string(case when len(wanted) > 0 then wanted else ranked end[1:3], ',') as points from w
""")
def chosen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    support = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") > 25).alias("trusted"), F.col("l_extendedprice").alias("raw"), F.col("l_discount").alias("normalised"), F.col("l_suppkey").alias("id"))).alias("support"))
    active = F.transform(F.filter("support", lambda s: s.id % 3 == F.col("l_orderkey") % 3), lambda s: s.id)
    return support.select("l_orderkey", F.array_join(F.transform(A.chosen_points(F.col("support"), active, 3), lambda i: i.cast("string")), ",").alias("points"))


@query("""
    with c as (select l_orderkey as doc, l_linenumber as section, l_partkey, l_suppkey, 3.5 * l_discount + 2.0 * (l_quantity > 40)::int + 0.65 * (l_tax > 0.04)::int + case when l_discount > 0 then 0.65 + 0.08 * (l_suppkey % 4) else 0 end + case when l_linestatus = 'F' then 0.5 else 0 end + case when l_returnflag <> 'N' then 0.15 else 0 end + case when l_linenumber <= 3 then 0.15 else 0 end
            - case when l_partkey % 5 = 0 and l_quantity <= 40 and l_tax <= 0.04 and l_discount <= 0 then 0.25 else 0 end as score, l_discount, l_partkey % 5 = 0 as generic, l_linestatus = 'F' as preferred from lineitem where l_returnflag <> 'A'),
    r as (select *, max(round(score, 8)) over (partition by doc) > 0 as any_good from c)
    select doc, section, l_partkey, l_suppkey, round(score, 8) as score, row_number() over (partition by doc order by case when any_good then round(score, 8) else preferred::int end desc, case when any_good then l_discount else -section end desc, case when any_good then not generic end desc, section, l_partkey, l_suppkey) as position from r qualify position <= 2
""")
def rescue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sections of a rescued document; without any score, preferred kinds in page order."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'")
    rows = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), "l_partkey", "l_suppkey", F.col("l_discount").alias("prelim"), (F.col("l_quantity") > 40).cast("int").alias("title_hits"), (F.col("l_tax") > 0.04).cast("int").alias("body_hits"),
        F.when(F.col("l_discount") > 0, F.col("l_suppkey") % 4).alias("lanes"), (F.col("l_linestatus") == "F").alias("preferred"), (F.col("l_returnflag") != "N").alias("substantial"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 5 == 0).alias("generic"))
    return O.rescue_sections(rows, "doc", ["section", "l_partkey", "l_suppkey"], 2)


@query("""
    with a as (select p_brand as doc, p_partkey as attempt, case p_partkey % 5 when 0 then 'success' when 1 then 'partial_success' when 2 then 'failure' when 3 then 'error' else 'disabled' end as status, p_size as headers, p_partkey % 90 as pages from part)
    select doc, arg_max(attempt, (case status when 'success' then 4 when 'partial_success' then 3 when 'failure' then 2 when 'error' then 1 else 0 end, headers, pages, -attempt)) as attempt from a group by doc
""")
def parser_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["success", "partial_success", "failure", "error", "disabled"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    rank = F.struct(A.parser_rank(status).alias("status"), F.col("p_size").alias("headers"), (F.col("p_partkey") % 90).alias("pages"), (-F.col("p_partkey")).alias("first"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc")).agg(F.max_by("p_partkey", rank).alias("attempt"))


@query("""
    select p_brand, count(*) as processed, count_if(p_size < 25) as low_coverage, array_to_string(list(p_partkey order by p_partkey) filter (p_size < 3), ',') as worst, count_if(p_partkey % 4 = 0) as cached, count_if(p_partkey % 5 < 2) as success_like, count_if(p_partkey % 5 < 2 and p_partkey % 3 = 0) as headerless, round(count_if(p_size >= 45) / greatest(count(*), 1), 6) as noise from part group by 1
""")
def parser_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of parsing, by brand: counts under conditions, the worst ids, the share of noise."""
    good = F.col("p_partkey") % 5 < 2
    worst = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p_size") < 3, F.col("p_partkey")))), lambda i: i.cast("string")), ",")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("processed"), F.count_if(F.col("p_size") < 25).alias("low_coverage"), F.nullif(worst, F.lit("")).alias("worst"), F.count_if(F.col("p_partkey") % 4 == 0).alias("cached"), F.count_if(good).alias("success_like"),
        F.count_if(good & (F.col("p_partkey") % 3 == 0)).alias("headerless"), F.round(F.count_if(F.col("p_size") >= 45) / F.count("*"), 6).alias("noise"))


@query("""
    with s as (select user_id, count(*) as pages, date_diff('second', min(ts), max(ts)) as seconds from events group by 1)
    select user_id, case when pages >= 60 then 'max_pages' when seconds >= 2500000 then 'max_runtime' end as reason from s
""")
def segment_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("pages"), seconds.alias("seconds"))
    return runs.select("user_id", A.segment_limit(F.col("pages"), F.col("seconds"), 60, 2_500_000.0).alias("reason"))
