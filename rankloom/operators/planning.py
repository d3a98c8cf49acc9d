"""Search plans: facets and the blueprints that cover them, repaired as nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let as _let
from ..functions.text import or_empty

FACETS = "array<struct<facet_id:string,facet_label_en:string,facet_group:string,query_family_preference:string,authority_role:string,language_strategy:string,importance_weight:int>>"
BLUEPRINT = "struct<authority_kind:string,label_en:string,label_de:string,target_facet_ids:array<string>,language_strategy:string,search_breadth:string,notes_en:string>"
IDS = "array<string>"
#: Facets as targets of a kind: what they are sorted by, and what a blueprint takes from them.
TARGETS = "array<struct<rank:int,weight:int,id:string,label:string,strategy:string>>"
CHOICES = f"array<struct<b:{BLUEPRINT},kind:string,raw:{IDS},targets:{TARGETS},gone:boolean>>"

#: Which query families a group of facets may ask for, the first one by default.
FAMILIES = {
    "object": ["object_core", "object_plus_context"],
    "construct": ["object_plus_construct"],
    "data_proxy": ["object_plus_data_proxy", "object_plus_method"],
    "method": ["object_plus_method"],
    "context": ["object_plus_context", "object_core"],
    "limitation": ["object_plus_limitation", "object_plus_context"],
}
#: Groups in the order in which blueprints of a kind take them.
GROUPS = {"core": ["object", "construct", "data_proxy", "context", "limitation", "method"], "booster": ["context", "limitation", "data_proxy", "method", "construct", "object"]}
#: Language strategies in the order in which blueprints of a kind prefer them, and the one without any.
STRATEGIES = {
    "core": ["en_de_parallel", "en_plus_bilingual_fallback", "en_plus_selective_de", "en_core_only"],
    "booster": ["en_plus_selective_de", "en_plus_bilingual_fallback", "en_core_only", "en_de_parallel"],
}
NO_STRATEGY = {"core": "en_plus_bilingual_fallback", "booster": "en_plus_selective_de"}
BREADTHS = ["tight", "broad_ok"]
WORDING = {"core": ("Core", "Kern", "core authority", "Tight authority coverage for the chapter object."), "booster": ("Booster", "Booster", "booster authority", "Broader authority coverage that remains chapter-anchored.")}
MOST_BLUEPRINTS = MOST_TARGETS = 4


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _rank(group: Column, kind: str) -> Column:
    place = F.array_position(_words(GROUPS[kind]), or_empty(group))
    return F.when(place > 0, place - 1).otherwise(9).cast("int")


def short_text(x: Column, fallback: Column, most_words: int, most_chars: int) -> Column:
    """One line of so many words and characters at most; the fallback where there is none."""
    line = lambda c: F.trim(F.regexp_replace(or_empty(c), "\\s+", " "))
    text = _let(line(x), lambda own: F.when(own == "", line(fallback)).otherwise(own))
    return F.rtrim(F.substring(F.substring_index(text, " ", most_words), 1, most_chars))


def _facet(facets: Column, facet_id: Column) -> Column:
    """The facet of an id; the last of equal ids."""
    return F.try_element_at(F.filter(facets, lambda f: F.trim(f.facet_id) == facet_id), F.lit(-1))


def _in_order(ids: Column, kind: str, facets: Column) -> Column:
    """TARGETS by rank of their group, then weight, then id."""
    target = lambda f, i: F.struct(
        _rank(f.facet_group, kind).alias("rank"), (-F.coalesce(f.importance_weight, F.lit(0))).alias("weight"), i.alias("id"), f.facet_label_en.alias("label"), f.language_strategy.alias("strategy")
    )
    return F.sort_array(F.transform(ids, lambda i: _let(_facet(facets, i), lambda f: target(f, i))))


def _own(kind: str, targets: Column) -> dict[str, Column]:
    """Fields of a blueprint for TARGETS: named after the first, with the strategy that its kind prefers of theirs."""
    core, german, unnamed, notes = WORDING[kind]
    label = F.trim(or_empty(F.get(targets, F.lit(0)).label))
    seed = F.when(label == "", unnamed).otherwise(label)
    return {
        "authority_kind": F.lit(kind),
        "label_en": short_text(F.concat(F.lit(f"{core} "), seed), F.lit(""), 8, 80),
        "label_de": short_text(F.concat(F.lit(f"{german} "), seed), F.lit(""), 8, 80),
        "target_facet_ids": targets.id,
        "language_strategy": F.coalesce(*[F.when(F.array_contains(targets.strategy, s), s) for s in STRATEGIES[kind]], F.lit(NO_STRATEGY[kind])),
        "search_breadth": F.lit("tight" if kind == "core" else "broad_ok"),
        "notes_en": F.lit(notes),
    }


def _blueprint(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()]).cast(BLUEPRINT)


def _listed(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))


def _family(facet: Column) -> Column:
    """The family that the facet's group allows: its own, or the group's default; groups without families keep theirs."""
    out = facet.query_family_preference
    for group, allowed in FAMILIES.items():
        out = F.when((facet.facet_group == group) & ~or_empty(facet.query_family_preference).isin(*allowed), allowed[0]).otherwise(out)
    return out


def _with(facet: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        facet = facet.withField(name, value)
    return facet


def _choices(blueprints: Column, ranked: dict[str, Column], roles: dict[str, Column]) -> Column:
    """CHOICES for the given blueprints one after another: the kind, the targets as given and the valid ones in order;
    a blueprint is gone whose targets all go, where its kind has facets.  Only this goes through the blueprints in turn."""

    def add(state: Column, b: Column) -> Column:
        targets = F.array_distinct(F.filter(F.transform(F.coalesce(b.target_facet_ids, F.array().cast(IDS)), lambda t: F.trim(or_empty(t))), lambda t: t != ""))
        is_core = F.when(_has_kind(b), b.authority_kind == "core").otherwise(state.cores == 0)

        def of(kind: str, raw: Column) -> Column:
            valid = F.slice(F.filter(ranked[kind], lambda t: F.array_contains(raw, t.id)), 1, MOST_TARGETS)
            return _let(valid, lambda v: F.struct(b.alias("b"), F.lit(kind).alias("kind"), raw.alias("raw"), v.alias("targets"), ((F.size(v) == 0) & (F.size(roles[kind]) > 0)).alias("gone")))

        chosen = _let(targets, lambda raw: F.when(is_core, of("core", raw)).otherwise(of("booster", raw)))
        return _let(chosen, lambda c: F.struct((state.cores + F.when((c.kind == "core") & ~c.gone, 1).otherwise(0)).alias("cores"), F.concat(state.out, F.array(c)).alias("out")))

    start = F.struct(F.lit(0).alias("cores"), F.array().cast(CHOICES).alias("out"))
    return F.aggregate(F.coalesce(blueprints, F.array().cast(f"array<{BLUEPRINT}>")), start, add, lambda state: state.out)


def _has_kind(b: Column) -> Column:
    return F.coalesce(b.authority_kind.isin("core", "booster"), F.lit(False))


def _made(choices: Column) -> Column:
    """Blueprints of the choices that are not gone, with texts and settings filled."""

    def made(kind: str, c: Column) -> Column:
        own, b = _own(kind, c.targets), c.b
        breadth = own["search_breadth"] if kind == "core" else F.when(b.search_breadth.isin(*BREADTHS), b.search_breadth).otherwise(own["search_breadth"])
        return _blueprint(own | {
            "label_en": short_text(b.label_en, own["label_en"], 8, 80),
            "label_de": short_text(b.label_de, own["label_de"], 8, 80),
            "language_strategy": F.when(b.language_strategy.isin(*STRATEGIES["core"]), b.language_strategy).otherwise(own["language_strategy"]),
            "search_breadth": breadth,
            "notes_en": short_text(b.notes_en, own["notes_en"], 18, 120),
        })

    return F.transform(F.filter(choices, lambda c: ~c.gone), lambda c: F.when(c.kind == "core", made("core", c)).otherwise(made("booster", c)))


def _chosen_notes(choices: Column) -> Column:
    def notes(c: Column) -> Column:
        name = F.concat(F.lit("blueprint "), or_empty(c.b.label_en))
        return F.array_compact(F.array(F.when(~_has_kind(c.b), F.concat(name, F.lit(": kind is "), c.kind)), F.when(c.raw != c.targets.id, F.concat(name, F.lit(": targets are "), _listed(c.targets.id)))))

    return F.flatten(F.transform(choices, notes))


def _extended(blueprints: Column, kind: str, ids: Column) -> Column:
    """(rest, out, notes): facets of the kind that no blueprint of it targets go where there is room, in order."""
    mine = F.flatten(F.transform(F.filter(blueprints, lambda b: b.authority_kind == kind), lambda b: b.target_facet_ids))

    def add(state: Column, b: Column) -> Column:
        room = F.when(b.authority_kind == kind, F.greatest(MOST_TARGETS - F.size(b.target_facet_ids), F.lit(0))).otherwise(0)
        more = F.slice(state.rest, 1, room)
        changed = F.size(more) > 0
        note = F.concat(F.lit("blueprint "), b.label_en, F.lit(": also targets "), _listed(more))
        return F.struct(
            F.slice(state.rest, F.size(more) + 1, F.size(state.rest)).alias("rest"),
            F.concat(state.out, F.array(b.withField("target_facet_ids", F.concat(b.target_facet_ids, more)))).cast(f"array<{BLUEPRINT}>").alias("out"),
            F.when(changed, F.concat(state.notes, F.array(note))).otherwise(state.notes).alias("notes"),
        )

    none = F.array().cast(IDS).alias("notes")
    start = lambda rest: F.struct(rest.alias("rest"), F.array().cast(f"array<{BLUEPRINT}>").alias("out"), none)
    rest = _let(mine, lambda m: F.filter(ids, lambda i: ~F.array_contains(m, i)))
    return _let(rest, lambda r: F.when(F.size(r) == 0, F.struct(r.alias("rest"), blueprints.alias("out"), none)).otherwise(F.aggregate(blueprints, start(r), add)))


def repair_plans(plans: DataFrame, facets: str = "facets", blueprints: str = "authority_blueprints", notes: str = "repair_notes") -> DataFrame:
    """``plans`` with valid facets and blueprints that cover them, and ``notes`` of what was changed.

    A facet's query family is one that its group allows; one facet at least has the role core. Blueprints have a known
    kind, and up to four targets that exist and have the kind's role. Facets of a role that no blueprint
    of the kind targets fill the room that is left, then further blueprints, four in all;
    boosters that find no place have no role then. A second run only sorts targets that were filled up, a third changes nothing.

    Null arrays are empty, other columns stay. Rows are repaired on their own; nothing is shuffled.
    """
    none = F.array().cast(IDS)
    given = F.coalesce(F.col(facets), F.array().cast(FACETS)).cast(FACETS)
    df = plans.withColumn("_given", given).withColumn("_f", F.transform("_given", lambda f: _with(f, query_family_preference=_family(f))))
    changed = F.filter(F.zip_with("_given", "_f", lambda a, b: F.when(~a.query_family_preference.eqNullSafe(b.query_family_preference), F.concat(F.lit("facet "), b.facet_id, F.lit(": family is "), b.query_family_preference))), lambda n: n.isNotNull())
    ranked = F.array_min(F.transform("_f", lambda f: F.struct(_rank(f.facet_group, "core").alias("rank"), (-F.coalesce(f.importance_weight, F.lit(0))).alias("weight"), or_empty(f.facet_id).alias("id"))))
    chosen = F.when(~F.exists("_f", lambda f: f.authority_role.eqNullSafe("core")), ranked.id)
    df = df.withColumns({"_notes": changed, "_chosen": chosen})
    promoted = F.transform("_f", lambda f: F.when(or_empty(f.facet_id) == F.col("_chosen"), _with(f, authority_role=F.lit("core"))).otherwise(f))
    df = df.withColumn("_f2", F.when(F.col("_chosen").isNull(), F.col("_f")).otherwise(promoted).cast(FACETS))
    of_role = lambda role: F.transform(F.filter("_f2", lambda f: (f.authority_role == role) & (F.trim(f.facet_id) != "")), lambda f: f.facet_id)
    df = df.withColumns({"_core": of_role("core"), "_booster": of_role("booster")})
    roles = {"core": F.col("_core"), "booster": F.col("_booster")}
    # what every blueprint looks up in the facets is made once a plan
    df = df.withColumn("_known", F.transform("_f2", lambda f: F.trim(f.facet_id)))
    named = lambda ids: F.filter(F.array_distinct(ids), lambda i: F.array_contains("_known", i))
    df = df.withColumns({f"_{kind}_ranked": _in_order(named(ids), kind, F.col("_f2")) for kind, ids in roles.items()})
    ranked = {kind: F.col(f"_{kind}_ranked") for kind in roles}
    df = df.withColumn("_choices", _choices(F.col(blueprints).cast(f"array<{BLUEPRINT}>"), ranked, roles))
    lacks = (F.size("_core") > 0) & ~F.exists("_choices", lambda c: (c.kind == "core") & ~c.gone)
    first = _let(F.slice(_in_order(F.col("_core"), "core", F.col("_f2")), 1, MOST_TARGETS), lambda t: _blueprint(_own("core", t)))
    df = df.withColumn("_out", F.concat(_made(F.col("_choices")), F.when(lacks, F.array(first)).otherwise(F.array().cast(f"array<{BLUEPRINT}>"))))
    promotion = F.when(F.col("_chosen").isNotNull(), F.array(F.concat(F.lit("facet "), "_chosen", F.lit(": role is core")))).otherwise(none)
    added = F.when(lacks, F.array(F.lit("new core blueprint"))).otherwise(none)
    df = df.withColumn("_notes", F.concat("_notes", promotion, _chosen_notes(F.col("_choices")), added))
    for kind in ("core", "booster"):
        df = df.withColumn("_more", _extended(F.col("_out"), kind, roles[kind]))
        n = F.least(F.greatest(MOST_BLUEPRINTS - F.size("_more.out"), F.lit(0)), F.ceil(F.size("_more.rest") / MOST_TARGETS).cast("int"))
        groups = F.transform(F.slice(F.sequence(F.lit(0), F.lit(MOST_BLUEPRINTS)), F.lit(1), n), lambda i: _in_order(F.slice(F.col("_more.rest"), i * MOST_TARGETS + 1, MOST_TARGETS), kind, F.col("_f2")))
        df = df.withColumns({"_n": n, "_groups": groups})
        df = df.withColumn("_out", F.concat("_more.out", F.transform("_groups", lambda g: _blueprint(_own(kind, g)))))
        df = df.withColumn("_notes", F.concat("_notes", "_more.notes", F.transform("_groups", lambda g: F.concat(F.lit(f"new {kind} blueprint for "), _listed(g.id)))))
    out = F.slice(F.col("_more.rest"), F.col("_n") * MOST_TARGETS + 1, F.size("_more.rest"))
    df = df.withColumn("_rest", out)
    demoted = F.transform("_f2", lambda f: F.when(F.array_contains("_rest", f.facet_id), _with(f, authority_role=F.lit("none"))).otherwise(f))
    note = F.when(F.size("_rest") > 0, F.array(F.concat(F.lit("no room: role is none for "), _listed(F.array_sort("_rest"))))).otherwise(none)
    made = df.withColumns({facets: F.when(F.size("_rest") > 0, demoted).otherwise(F.col("_f2")).cast(FACETS), blueprints: F.col("_out"), notes: F.concat("_notes", note)})
    return made.select([c for c in plans.columns if c not in (notes,)] + [notes])
