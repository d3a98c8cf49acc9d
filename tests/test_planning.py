"""Search plans against a plain version of the rules."""

import random

from rankloom.operators import planning as P

GROUPS = ["object", "construct", "data_proxy", "context", "limitation", "method", "other", None]
FAMILIES = ["object_core", "object_plus_context", "object_plus_construct", "object_plus_method", "object_plus_data_proxy", "object_plus_limitation", "?", None]


def plain_repair(facets, blueprints):
    """facets: (id, label, group, family, role, strategy, weight); blueprints: (kind, label_en, label_de, targets, strategy, breadth, notes)."""
    facets = [list(f) for f in facets]
    for f in facets:
        allowed = P.FAMILIES.get(f[2])
        if allowed and f[3] not in allowed:
            f[3] = allowed[0]
    rank = lambda g, kind: P.GROUPS[kind].index(g) if g in P.GROUPS[kind] else 9
    if facets and not any(f[4] == "core" for f in facets):
        best = min(facets, key=lambda f: (rank(f[2], "core"), -f[6], f[0]))[0]
        for f in facets:
            if f[0] == best:
                f[4] = "core"
    by_id = {f[0]: f for f in facets}
    roles = {k: [f[0] for f in facets if f[4] == k] for k in ("core", "booster")}
    ordered = lambda ids, kind: sorted(ids, key=lambda i: (rank(by_id[i][2], kind), -by_id[i][6], i))
    clean = lambda x, fallback, words, chars: " ".join(((x or "").strip() or fallback).split()[:words])[:chars].rstrip()

    def make(kind, ids):
        en, de, unnamed, notes = P.WORDING[kind]
        seed = ((by_id[ids[0]][1] or "").strip() if ids else "") or unnamed
        theirs = [by_id[i][5] for i in ids]
        strategy = next((s for s in P.STRATEGIES[kind] if s in theirs), P.NO_STRATEGY[kind])
        return [kind, clean(f"{en} {seed}", "", 8, 80), clean(f"{de} {seed}", "", 8, 80), ids, strategy, "tight" if kind == "core" else "broad_ok", notes]

    out = []
    for kind, en, de, targets, strategy, breadth, notes in blueprints:
        if kind not in ("core", "booster"):
            kind = "booster" if any(b[0] == "core" for b in out) else "core"
        raw = list(dict.fromkeys(t.strip() for t in targets or [] if t and t.strip()))
        ids = ordered([t for t in raw if t in roles[kind]], kind)[:4]
        if not ids and roles[kind]:
            continue
        own = make(kind, ids)
        out.append([kind, clean(en, own[1], 8, 80), clean(de, own[2], 8, 80), ids, strategy if strategy in P.STRATEGIES["core"] else own[4], "tight" if kind == "core" else breadth if breadth in P.BREADTHS else own[5], clean(notes, own[6], 18, 120)])
    if roles["core"] and not any(b[0] == "core" for b in out):
        out.append(make("core", ordered(roles["core"], "core")[:4]))
    for kind in ("core", "booster"):
        left = [i for i in roles[kind] if not any(i in b[3] for b in out if b[0] == kind)]
        for b in out:
            if b[0] == kind:
                room = max(0, 4 - len(b[3]))
                b[3], left = b[3] + left[:room], left[room:]
        while left and len(out) < 4:
            out.append(make(kind, ordered(left[:4], kind)))
            left = left[4:]
        if kind == "booster":
            for i in left:
                by_id[i][4] = "none"
    return [tuple(f) for f in facets], [tuple(b) for b in out]


def random_plans(n):
    rng = random.Random(11)
    plans = []
    for i in range(n):
        roles = rng.choice([["core", "booster", "none"], ["booster"], ["none", None], ["core"], ["booster", "booster", "core"]])
        size = rng.choice([0, 1, 3, 8, 25])
        facets = [(f"F{j:02d}", rng.choice([f"label  {j}", " ", None]), rng.choice(GROUPS), rng.choice(FAMILIES), rng.choice(roles), rng.choice([*P.STRATEGIES["core"], "odd", None]), rng.randrange(5)) for j in range(size)]
        rng.shuffle(facets)
        target = lambda: rng.sample([f"F{j:02d}" for j in range(size + 2)] + [" ", None, "F01 "], rng.randrange(4))  # noqa: E731, B023
        blueprints = [(rng.choice(["core", "booster", "x", None]), rng.choice(["A  name", "", None, "w " * 12]), rng.choice(["Ein Name", None]), rng.choice([None, target()]), rng.choice(["en_core_only", "x", None]), rng.choice(["tight", "broad_ok", None]), rng.choice(["a note", None])) for _ in range(rng.randrange(6))]
        plans.append((i, facets, blueprints))
    return plans


def test_repair_equals_the_rules(spark):
    plans = random_plans(250)
    schema = f"plan long, facets {P.FACETS}, authority_blueprints array<{P.BLUEPRINT}>"
    repaired = P.repair_plans(spark.createDataFrame(plans, schema))
    got = {r.plan: r for r in repaired.collect()}
    for i, facets, blueprints in plans:
        want_facets, want = plain_repair(facets, blueprints)
        assert [tuple(f) for f in got[i].facets] == want_facets
        assert [tuple(b) for b in got[i].authority_blueprints] == want
        if not got[i].repair_notes:  # settings and texts are filled without a note
            assert want_facets == facets and [(b[0], b[3]) for b in want] == [(b[0], list(filter(str.strip, (t or "" for t in b[3] or [])))) for b in blueprints]


def test_repair_settles(spark):
    schema = f"plan long, facets {P.FACETS}, authority_blueprints array<{P.BLUEPRINT}>"
    again = lambda rows: [(r.plan, [tuple(f) for f in r.facets], [tuple(b) for b in r.authority_blueprints]) for r in P.repair_plans(spark.createDataFrame(rows, schema)).orderBy("plan").collect()]
    first = again(random_plans(120))
    second = again(first)
    for (_, f1, b1), (_, f2, b2) in zip(first, second):
        assert f1 == f2 and [(*b[:3], sorted(b[3]), *b[4:]) for b in b1] == [(*b[:3], sorted(b[3]), *b[4:]) for b in b2]
    assert again(second) == second


def test_repair_of_nothing(spark):
    schema = f"plan long, facets {P.FACETS}, authority_blueprints array<{P.BLUEPRINT}>, repair_notes string, other string"
    row = P.repair_plans(spark.createDataFrame([(1, None, None, "x", "kept")], schema)).first()
    assert (row.facets, row.authority_blueprints, row.repair_notes, row.other) == ([], [], [], "kept")


def test_plans_are_listed_and_repaired_behind_one_shuffle(spark):
    """Rows of an order are sorted once and listed in that order; nothing is grouped after that."""
    from rankloom.plans import planning

    plan = planning.plan_repair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    steps = [line.strip(" :+-*0123456789()") for line in plan.splitlines()]
    assert sum(s.startswith("Exchange") for s in steps) == 1 and sum(s.startswith("Sort ") for s in steps) == 1
    assert not any("Aggregate" in s.split("(")[0] for s in steps)
