"""Search plans: an order is a plan, its line items are the facets, their return flags and states the blueprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import planning as P
from .base import query, table

_GROUPS = ["object", "construct", "data_proxy", "context", "limitation", "method", "other"]
_FAMILIES = ["object_core", "object_plus_context", "object_plus_construct", "object_plus_method", "object_plus_data_proxy", "object_plus_limitation"]
_ROLES = ["core", "booster", "none", "booster", "booster"]
_STRATEGIES = [*P.STRATEGIES["core"], "odd"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _allowed() -> str:
    return "map {" + ", ".join(f"'{g}': {_list(f)}" for g, f in P.FAMILIES.items()) + "}"


def _rank(group: str, kind: str) -> str:
    """kind: an SQL expression of the kind, core or booster."""
    place = lambda k: f"coalesce(nullif(list_position({_list(P.GROUPS[k])}, {group}), 0) - 1, 9)"
    return f"case when {kind} = 'core' then {place('core')} else {place('booster')} end"


def _preferred(kind: str, theirs: str) -> str:
    pick = lambda k: "coalesce(" + ", ".join(f"case when list_contains({theirs}, '{s}') then '{s}' end" for s in P.STRATEGIES[k]) + f", '{P.NO_STRATEGY[k]}')"
    return f"case when {kind} = 'core' then {pick('core')} else {pick('booster')} end"


@query(f"""
    with f0 as (
        select l_orderkey as plan_id, n, 'F' || n as id, 'due ' || l_shipdate::date as label, {_list(_GROUPS)}[1 + l_suppkey % 7] as grp, {_list(_FAMILIES)}[1 + l_partkey % 6] as fam,
            {_list(_ROLES)}[1 + (l_partkey // 6) % (case when l_orderkey % 3 = 0 then 2 else 5 end)] as role, {_list(_STRATEGIES)}[1 + l_quantity::int % 5] as strategy, l_quantity::int % 4 as weight, l_returnflag || l_linestatus as instruct, l_partkey as k
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) as n from lineitem)
    ), f1 as (
        select * replace (case when map_contains({_allowed()}, grp) and not list_contains({_allowed()}[grp], fam) then ({_allowed()}[grp])[1] else fam end as fam), min(struct_pack(r := {_rank('grp', "'core'")}, w := -weight, i := id)) over (partition by plan_id) as best, bool_or(role = 'core') over (partition by plan_id) as has_core from f0
    ), f as (
        select * replace (case when not has_core and best.i = id then 'core' else role end as role) from f1
    ), b0 as (
        select plan_id, instruct, case when instruct = 'NO' then 'core' when instruct = 'RF' then 'booster' else 'x' end as kind, list_concat(list(id order by k, n), ['F1', 'F2', 'F9', ' ']) as given, row_number() over (partition by plan_id order by instruct) as pos from f group by plan_id, instruct
    ), t as (
        select b0.plan_id, pos, f.role, list(f.id order by {_rank('f.grp', 'f.role')}, -f.weight, f.id) as ids from b0 join f on f.plan_id = b0.plan_id and list_contains(given, f.id) where f.role in ('core', 'booster') group by all
    ), has as (
        select plan_id, bool_or(role = 'core') as cores, bool_or(role = 'booster') as boosters from f group by plan_id
    ), b1 as (
        select b0.*, coalesce(c.ids, [])[1:4] as core_ids, coalesce(o.ids, [])[1:4] as booster_ids, cores, boosters from b0 join has using (plan_id)
        left join t as c on c.plan_id = b0.plan_id and c.pos = b0.pos and c.role = 'core' left join t as o on o.plan_id = b0.plan_id and o.pos = b0.pos and o.role = 'booster'
    ), b2 as (
        select *, coalesce(bool_or(kind <> 'booster' and (len(core_ids) > 0 or not cores)) over (partition by plan_id order by pos rows between unbounded preceding and 1 preceding), false) as core_before from b1
    ), b3 as (
        select plan_id, pos, instruct, case when kind <> 'x' then kind when core_before then 'booster' else 'core' end as kind from b2
    ), b4 as (
        select b3.*, case when b3.kind = 'core' then core_ids else booster_ids end as ids, case when b3.kind = 'core' then cores else boosters end as any_of from b3 join b1 using (plan_id, pos)
    ), b5 as (
        select plan_id, pos, kind, case when instruct = 'NO' then '' else instruct end as given_label, ids, true as given from b4 where len(ids) > 0 or not any_of
        union all
        select plan_id, 90, 'core', '', (list(id order by {_rank('grp', "'core'")}, -weight, id))[1:4], false from f where role = 'core' and plan_id not in (select plan_id from b4 where kind = 'core' and len(ids) > 0) group by plan_id
    ), left_over as (
        select f.plan_id, f.role as kind, f.id, row_number() over (partition by f.plan_id, f.role order by n) as u from f where role in ('core', 'booster') and not exists (from b5 where b5.plan_id = f.plan_id and b5.kind = f.role and list_contains(b5.ids, f.id))
    ), room as (
        select *, coalesce(sum(4 - len(ids)) over (partition by plan_id, kind order by pos rows between unbounded preceding and 1 preceding), 0) as before from b5
    ), filled as (
        select room.plan_id, pos, any_value(room.kind) as kind, any_value(given_label) as given_label, any_value(given) as given, any_value(ids) as first_ids, list(x.id order by u) filter (x.id is not null) as more
        from room left join left_over as x on x.plan_id = room.plan_id and x.kind = room.kind and u > before and u <= before + 4 - len(ids) group by room.plan_id, pos
    ), sizes as (
        select plan_id, count(*) as n, sum(4 - len(ids)) filter (kind = 'core') as core_room, sum(4 - len(ids)) filter (kind = 'booster') as booster_room from b5 group by plan_id
    ), needs as (
        select has.plan_id, coalesce(n, 0) as n, greatest(0, coalesce(c.left_cores, 0) - coalesce(core_room, 0)) as cores, coalesce(core_room, 0) as core_room, coalesce(booster_room, 0) as booster_room from has left join sizes using (plan_id) left join (select plan_id, count(*) as left_cores from left_over where kind = 'core' group by plan_id) as c using (plan_id)
    ), slots as (
        select *, least(greatest(4 - n, 0), ceil(cores / 4.0)) as new_cores from needs
    ), fresh as (
        select x.plan_id, x.kind, (u - 1 - (case when x.kind = 'core' then core_room else booster_room end)) // 4 as g, x.id, u, case when x.kind = 'core' then greatest(4 - n, 0) else greatest(4 - n - new_cores, 0) end as free
        from left_over as x join slots using (plan_id) where u > (case when x.kind = 'core' then core_room else booster_room end)
    ), placed as (
        select fresh.plan_id, 100 + g + case when fresh.kind = 'booster' then 10 else 0 end as pos, fresh.kind, '' as given_label, false as given, list(f.id order by {_rank('grp', 'fresh.kind')}, -weight, f.id) as first_ids, null::varchar[] as more
        from fresh join f on f.plan_id = fresh.plan_id and f.id = fresh.id where g < free group by fresh.plan_id, fresh.kind, g
    ), demoted as (
        select plan_id, id from fresh where g >= free and kind = 'booster'
    ), every as (
        select *, list_concat(first_ids, coalesce(more, [])) as ids from (from filled union all by name from placed)
    ), named as (
        select e.plan_id, e.pos, e.kind, e.given_label, e.given, e.ids, any_value(f.label) filter (f.id = e.first_ids[1]) as label, list(f.strategy) filter (list_contains(e.first_ids, f.id)) as theirs from every as e left join f on f.plan_id = e.plan_id and list_contains(e.first_ids, f.id) group by all
    ), lines as (
        select plan_id, pos, kind || '|' || case when given_label <> '' then given_label else case when kind = 'core' then 'Core ' else 'Booster ' end || coalesce(label, kind || ' authority') end || '|' || array_to_string(ids, ' ') || '|' || {_preferred('kind', 'coalesce(theirs, [])')} || '|' || case when kind = 'core' then 'tight' else 'broad_ok' end as line from named
    )
    select plan_id, string_agg(distinct_f, ',' order by n) as facets, any_value(blueprints) as blueprints
    from (select f.plan_id, n, f.id || ':' || fam || ':' || case when demoted.id is not null then 'none' else role end as distinct_f from f left join demoted on demoted.plan_id = f.plan_id and demoted.id = f.id)
    join (select plan_id, string_agg(line, ';' order by pos) as blueprints from lines group by plan_id) using (plan_id) group by plan_id
""")
def plan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    part, many = F.col("l_partkey"), F.col("l_quantity").cast("int")
    role = F.floor(part / 6) % F.when(F.col("l_orderkey") % 3 == 0, 2).otherwise(5)
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
    row = F.struct(
        F.concat("l_returnflag", "l_linestatus").alias("instruct"),
        part.alias("k"),
        F.concat(F.lit("due "), F.col("l_shipdate").cast("date").cast("string")).alias("facet_label_en"),
        pick(_GROUPS, F.col("l_suppkey") % 7).alias("facet_group"),
        pick(_FAMILIES, part % 6).alias("query_family_preference"),
        pick(_ROLES, role).alias("authority_role"),
        pick(_STRATEGIES, many % 5).alias("language_strategy"),
        (many % 4).alias("importance_weight"),
    )
    # an order's rows are sorted once and listed in that order, so nothing is grouped or sorted again
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.row_number().over(in_order).alias("n"), F.collect_list(row).over(whole).alias("rows")).filter("n = 1")
    facet_id = lambda n: F.concat(F.lit("F"), (n + 1).cast("string"))
    facet = lambda r, n: F.struct(facet_id(n).alias("facet_id"), *[r[c] for c in ("facet_label_en", "facet_group", "query_family_preference", "authority_role", "language_strategy", "importance_weight")])
    targets = F.sort_array(F.transform("rows", lambda r, n: F.struct(r.instruct.alias("instruct"), r.k.alias("k"), n.alias("n"))))
    listed = listed.select("plan_id", F.transform("rows", facet).alias("facets"), F.array_distinct("rows.instruct").alias("instructs"), targets.alias("targets"))
    text = F.lit(None).cast("string")
    blueprint = lambda instruct: F.struct(
        F.when(instruct == "NO", "core").when(instruct == "RF", "booster").otherwise("x").alias("authority_kind"),
        F.when(instruct != "NO", instruct).alias("label_en"),
        text.alias("label_de"),
        F.concat(F.transform(F.filter("targets", lambda t: t.instruct.eqNullSafe(instruct)), lambda t: facet_id(t.n)), F.array(*map(F.lit, ["F1", "F2", "F9", " "]))).alias("target_facet_ids"),
        text.alias("language_strategy"),
        text.alias("search_breadth"),
        text.alias("notes_en"),
    ).cast(P.BLUEPRINT)
    plans = listed.select("plan_id", "facets", F.transform(F.sort_array("instructs"), blueprint).alias("authority_blueprints"))
    done = P.repair_plans(plans)
    line = lambda b: F.concat_ws("|", b.authority_kind, b.label_en, F.array_join(b.target_facet_ids, " "), b.language_strategy, b.search_breadth)
    return done.select("plan_id", F.array_join(F.transform("facets", lambda f: F.concat_ws(":", f.facet_id, f.query_family_preference, f.authority_role)), ",").alias("facets"), F.array_join(F.transform("authority_blueprints", line), ";").alias("blueprints"))
