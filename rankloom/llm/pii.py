"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds; DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.workspace import Workspace

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Generator:
    """Proposes spans of a kind.  ``cue`` must occur in a text that has one; ``valid`` is SQL over ``value`` (null: never a base span)."""

    kind: str
    pattern: str
    cue: str
    valid: str | None


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(value, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> int(c) * (1 + i % 2) - if(i % 2 = 1 and int(c) > 4, 9, 0)), 0, (a, x) -> a + x) % 10 = 0"
)
#: Each base pattern is written so that it can't try again from inside what it has just read, with the same matches:
#: possessive runs, and no start inside a run of characters that a match could begin with.
GENERATORS = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true"),
    Generator("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{1,63}){1,4}", "at", None),
    Generator("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", rf"value rlike '^{_OCTET}([.]{_OCTET}){{3}}$'"),
    Generator("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", ":", None),
    Generator("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "", f"length({_DIGITS}) between 16 and 19 and {_LUHN}"),
    Generator("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", f"length({_DIGITS}) between 8 and 15"),
    Generator("phone", r"(?<![0-9+(])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", "", None),
)

CONTEXT = 24
#: What trees see: format and context, but not what the base rules check.
FEATURES = {
    "kind": "double(array_position(array('email', 'ip', 'card', 'phone'), kind))",
    "length": "double(char_length(value))",
    "digits": f"double(length({_DIGITS}))",
    "letters": "double(length(regexp_replace(value, '[^A-Za-z]', '')))",
    "groups": "double(regexp_count(value, '[0-9A-Za-z]+'))",
    "dots": "double(regexp_count(value, '[.]'))",
    "spaces": "double(regexp_count(value, ' '))",
    "dashes": "double(regexp_count(value, '-'))",
    "brackets": "double(regexp_count(value, '[(){}\\\\[\\\\]]'))",
    "top_domain": "double(length(regexp_extract(value, '[.]([A-Za-z]+)$', 1)))",
    "plus": "double(value like '+%')",
    "at": "double(contains(value, '@'))",
    "first_digit": "coalesce(try_cast(substring(value, 1, 1) as double), -1D)",
    "touches": "double(before rlike '[0-9A-Za-z_#/-]$')",
    "touched": "double(after rlike '^[0-9A-Za-z_/-]')",
    "says_kind": "double(before rlike '(?i)(mail|contact|ip|addr|host|server|card|visa|pay|account|tel|phone|call|fax|mobile)')",
    "says_other": "double(before rlike '(?i)(isbn|order|version|ref|invoice|serial|no[.]|nr[.]|page|date|time|id)')",
}
_CANDIDATE = "array<struct<kind:string,start:int,end:int,base:boolean,features:array<double>>>"

#: Labelled examples for forms that no base rule settles: kind, before, value, after, label.  Fixed values; of each kind and
#: label every second one is left out of fitting, for the thresholds.
SEEDS = [
    ("email", "write to ", "ann.lee (at) example.org", " today", 1), ("email", "mail: ", "bob[at]example[dot]com", "", 1), ("email", "contact ", "c.diaz {at} uni {dot} edu", ".", 1), ("email", "mail me: ", "jo [at] firm.net", " ok", 1), ("email", "or ", "kim.s(at)lab(dot)ac(dot)uk", ",", 1), ("email", "e-mail ", "office (at) town.gov", "", 1),
    ("email", "see you ", "later (at) noon.", " ok", 0), ("email", "price ", "5 (at) 3.20", " each", 0), ("email", "we meet ", "there (at) 8.30", "", 0), ("email", "sold ", "12 (at) 1.5", " now", 0),
    ("ip", "host ", "2001:db8:0:0:8a2e:370:7334:1", " up", 1), ("ip", "addr ", "fe80:0:0:0:1:2:3:4", "", 1), ("ip", "server ", "2a00:1450:4001:81b:0:0:0:200e", " is", 1), ("ip", "from ", "2001:470:1f0b:9:0:0:0:2", ".", 1), ("ip", "ip ", "fd12:3456:789a:1:0:0:0:1", "", 1),
    ("ip", "time ", "12:30:45:10", " frame", 0), ("ip", "ratio ", "1:2:3:4", "", 0), ("ip", "date ", "20:11:05:22", " log", 0), ("ip", "odds ", "3:1:2:5", " on", 0), ("ip", "at ", "08:15:00:00", " start", 0), ("ip", "verse ", "2:14:3:16", "", 0),
    ("phone", "call ", "(613) 555-8758", " now", 1), ("phone", "tel ", "613-555-8758", "", 1), ("phone", "fax: ", "030.5550.1234", ".", 1), ("phone", "mobile ", "555 014 2233", "", 1), ("phone", "phone ", "(020) 7946-0018", ",", 1), ("phone", "call me ", "212 555 0147", " please", 1), ("phone", "tel. ", "415.555.0199", "", 1), ("phone", "reach us ", "(089) 555-0133", "", 1),
    ("phone", "order ", "2024-0101-2233", " sent", 0), ("phone", "isbn ", "978 3161 4841", "-0", 0), ("phone", "ref ", "12-345-6789", "/A", 0), ("phone", "version ", "10.123.4567", "", 0), ("phone", "serial ", "2023-111-2222", "-X", 0), ("phone", "invoice ", "77-1234-5678", "", 0), ("phone", "page ", "12.345.678", "/9", 0), ("phone", "no. ", "1999.1231.0001", "_b", 0),
    ("card", "card ", "4111 1111 1111 1112", " exp", 1), ("card", "visa ", "4012888888881882", "", 1), ("card", "pay ", "378282246310006", " ok", 1), ("card", "card no ", "5105 1051 0510 5101", "", 1),
    ("card", "isbn ", "9783161484100", " cover", 0), ("card", "serial ", "20240101123456", "", 0), ("card", "order ", "1000000000000", " left", 0), ("card", "ref ", "7700000000001234", "/2", 0),
]

#: Forms that no base rule settles, by what base rules never match: no at sign, no dots between numbers, no plus.
OPEN = "((kind = 'email' and features[11] = 0) or (kind = 'ip' and features[5] = 0) or (kind = 'phone' and features[10] = 0))"
STEP = 64


def _scanned(out: DataFrame, values: str, name: str, combine: str, zero: str) -> DataFrame:
    """``out`` with the int array ``name``: for each element of ``values`` what those before it make by ``combine`` (of {a} and {x}).

    Blocks of STEP elements are taken together first, in a column of their own; it is named twice
    where it is used, so that the optimizer does not put it into the lambda, to be made anew for every element.
    """
    step = f"(a, x) -> {_combined(combine, 'a', 'x')}"
    blocks = f"transform(sequence(0, greatest(size({values}) - 1, 0) div {STEP}), b -> aggregate(slice({values}, b * {STEP} + 1, {STEP}), {zero}, {step}))"
    above = f"aggregate({blocks}, array({zero}), (s, v) -> concat(s, array({_combined(combine, 'element_at(s, -1)', 'v')})))"
    out = out.withColumn("_above", F.expr(above))
    own = f"aggregate(slice({values}, int(i div {STEP} * {STEP} + 1), int(i % {STEP})), {zero}, {step})"
    found = _combined(combine, f"if(size(_above) > i div {STEP}, _above[i div {STEP}], {zero})", own)
    return out.withColumn(name, F.expr(f"transform({values}, (_, i) -> {found})")).drop("_above")


def _combined(combine: str, a: str, x: str) -> str:
    return combine.replace("{a}", a).replace("{x}", x)


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with every generator's spans, their features and whether the base rule accepts them."""
    body, kept = F.coalesce(F.col(text).cast("string"), F.lit("")), docs.columns
    out = docs.withColumn("_text", body)
    for i, g in enumerate(GENERATORS):
        found = F.regexp_extract_all("_text", F.lit(g.pattern), F.lit(0))
        out = out.withColumn(f"_found{i}", F.when(F.contains("_text", F.lit(g.cue)), found).otherwise(F.array().cast("array<string>")))
    for i, g in enumerate(GENERATORS):
        # what stands between the matches gives their places, and with the matches beside it their context
        out = out.withColumn(f"_between{i}", F.when(F.size(f"_found{i}") > 0, F.split("_text", g.pattern, -1)).otherwise(F.array().cast("array<string>")))
    for i in range(len(GENERATORS)):
        out = out.withColumn(f"_steps{i}", F.expr(f"transform(_found{i}, (value, i) -> char_length(_between{i}[i]) + char_length(value))"))
    for i in range(len(GENERATORS)):
        out = _scanned(out, f"_steps{i}", f"_sums{i}", "{a} + {x}", "0")
    parts = []
    for i, g in enumerate(GENERATORS):
        place = f"(_sums{i}[i] + char_length(_between{i}[i]))"
        before = f"right(concat(if(i > 0, right(_found{i}[greatest(i - 1, 0)], {CONTEXT}), ''), right(_between{i}[i], {CONTEXT})), {CONTEXT})"
        after = f"left(concat(left(_between{i}[i + 1], 2), left(coalesce(get(_found{i}, i + 1), ''), 2)), 2)"
        around = f"transform(_found{i}, (value, i) -> struct('{g.kind}' as kind, value, {place} as start, {place} + char_length(value) as end, {before} as before, {after} as after))"
        parts.append(F.when(F.size(f"_found{i}") > 0, F.expr(f"transform({around}, s -> {_described('s', g.valid)})")).otherwise(F.array().cast(_CANDIDATE)))
    return out.select(*kept, F.concat(*parts).alias("candidates"))


def _described(s: str, valid: str | None) -> str:
    def inside(sql: str) -> str:
        for name in ("kind", "value", "before", "after"):
            sql = _word(sql, name, f"{s}.{name}")
        return sql

    return f"struct({s}.kind as kind, {s}.start as start, {s}.end as end, coalesce({inside(valid or 'false')}, false) as base, array({', '.join(map(inside, FEATURES.values()))}) as features)"


def _word(sql: str, name: str, by: str) -> str:
    """Replace a column's name outside string literals."""
    return re.sub(rf"('(?:[^'\\]|\\.)*')|\b{name}\b", lambda m: m[1] or by, sql)


def _seed_rows(spark: SparkSession) -> DataFrame:
    met: dict[tuple, int] = {}
    rows = []
    for kind, before, value, after, label in SEEDS:
        n = met[kind, label] = met.get((kind, label), -1) + 1
        rows.append(f"('{kind}', '{before}', '{value}', '{after}', {label}D, {n % 2}L)")
    given = spark.sql(f"select * from values {', '.join(rows)} as t(kind, before, value, after, label, half)")
    return given.select("kind", F.array(*[F.expr(x) for x in FEATURES.values()]).alias("features"), "label", "half")


def _trees(model) -> list[tuple[float, object]]:
    return [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def _tree_sql(node, features: str, cuts: list[tuple[int, float]]) -> str:
    if node.subtreeDepth() == 0:
        return f"{node.prediction()!r}D"
    place, cut = cuts[node.split().featureIndex()]
    above, other = node.rightChild(), node.leftChild()
    if 1.0 in node.split().leftCategories():
        above, other = other, above
    return f"if({features}[{place}] <= {cut!r}D, {_tree_sql(other, features, cuts)}, {_tree_sql(above, features, cuts)})"


@dataclass(frozen=True)
class Scorer:
    """Boosted trees as one SQL expression, and the least score of each kind that is redacted.

    A kind's name with a star has the threshold of its forms that no base rule settles; without one the kind's own holds for them.
    """

    expression: str
    thresholds: dict[str, float]

    def score(self, features: str) -> str:
        return f"1D / (1D + exp(-2D * ({self.expression.replace('FEATURES', features)})))"

    def limit(self, c: str) -> str:
        of = lambda star: f"case {c}.kind " + " ".join(f"when '{k}' then {self.thresholds.get(k + star, self.thresholds[k])!r}D" for k in KINDS) + " end"
        return f"if({_word(_word(OPEN, 'kind', f'{c}.kind'), 'features', f'{c}.features')}, {of('*')}, {of('')})"


def _training_rows(candidates: DataFrame, seed_weight: int) -> DataFrame:
    """All candidates that a base rule settles, equal ones as one row with their number ``n``, and the seeds.

    A seed weighs as much as every ``seed_weight``-th part of the candidates, one at least, so that seeds count the same at any size.
    """
    flat = candidates.select(F.explode("candidates").alias("c"))
    flat = flat.select("c.kind", "c.features", F.col("c.base").cast("double").alias("label"), F.pmod(F.shiftright(F.xxhash64("c"), 32), F.lit(2)).alias("half"))
    given = flat.filter(f"not {OPEN}").groupBy("kind", "features", "label", "half").agg(F.count("*").cast("double").alias("n"))
    total = candidates.select(F.sum(F.size("candidates"))).first()[0] or 0
    return given.unionByName(_seed_rows(candidates.sparkSession).withColumn("n", F.lit(max(1.0, total / seed_weight))))


def _cuts(rows: DataFrame, bins: int = 32) -> list[tuple[int, float]]:
    """(place of a feature, value) of every split the trees may make: each value but the last, or the bounds of ``bins`` shares of all rows where there are more values."""
    values = rows.select("n", F.posexplode("features").alias("place", "value")).groupBy("place", "value").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("place")
    upto = F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumns({"share": F.ceil(bins * upto / F.sum("n").over(own)), "values": F.count("*").over(own)})
    after = F.lead("share").over(own.orderBy("value"))
    chosen = values.withColumn("after", after).filter(F.col("after").isNotNull() & ((F.col("values") <= bins) | (F.col("after") != F.col("share"))))
    return sorted((r.place, r.value) for r in chosen.select("place", "value").collect())  # some hundreds at most


def train_scorer(candidates: DataFrame, precision: float = 0.9, rounds: int = 12, depth: int = 3, seed_weight: int = 20_000) -> Scorer:
    """Fit trees and thresholds on all candidates (column of arrays as from the generators) and the seeds.

    A candidate's label is whether its base rule accepts it, which the features
    don't show; forms that no base rule settles are labelled by the seeds alone.  Half of
    both fits the trees; on the other half each kind, and apart from it its open
    forms, gets the least threshold, in hundredths, above which ``precision`` of the candidates have
    the label (0.5 where no half tells, 1.01 - none - where no
    threshold reaches it).  Halves are by a hash of a candidate's features and place.  Candidates of equal features
    are one row with their number as weight, so no candidate is left out; splits are
    features of their own, below or above a cut, since the library draws a sample to choose them itself.
    """
    spark = candidates.sparkSession
    ws = Workspace(spark, "pii-train")
    rows = ws.save(_training_rows(candidates, seed_weight))
    fitted = rows.filter("half = 0")
    cuts = _cuts(fitted)
    above = F.array(*[F.expr(f"double(features[{place}] > {cut!r}D)") for place, cut in cuts])
    given = fitted.groupBy(above.alias("above"), "label").agg(F.sum("n").alias("n")).repartition(4, "above").sortWithinPartitions("above", "label")
    binary = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": f"above{i}"} for i in range(len(cuts))]}, "num_attrs": len(cuts)}}
    vectors = ws.save(given).select(array_to_vector("above").alias("vector", metadata=binary), "label", "n")
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="n", maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(vectors)
    scorer = Scorer(" + ".join(f"{w!r}D * {_tree_sql(root, 'FEATURES', cuts)}" for w, root in _trees(model)), {})
    scored = rows.filter("half = 1").select(F.expr(f"if({OPEN}, kind || '*', kind)").alias("kind"), "label", "n", F.expr(f"int(floor(100 * {scorer.score('features')}))").alias("bin"))
    bins = scored.groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")).collect()
    thresholds = {}
    for kind in [k + star for k in KINDS for star in ("", "*")]:
        own = [r for r in bins if r["kind"] == kind]
        good = [b for b in range(50, 100) if (n := sum(r["n"] for r in own if r["bin"] >= b)) and sum(r["hits"] for r in own if r["bin"] >= b) >= precision * n]
        thresholds[kind] = good[0] / 100 if good else 1.01 if own else 0.5
    ws.close()
    return Scorer(scorer.expression, thresholds)


def find_pii(docs: DataFrame, scorer: Scorer | None = None, text_col: str = "text", out: str = "pii", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, base, score) in code points, by kind and start.

    ``carry`` names the columns of ``docs`` to return beside it, all by default; without
    the text, what is saved between training and scoring is small.

    Generators of high recall propose spans, which may overlap.  A span is kept if
    its kind's base rule accepts it, or if the trees' score reaches the kind's
    threshold and no base span of the kind overlaps it.  Without ``scorer`` one is
    trained on ``docs``.  All work stays in the row: nothing is shuffled but the
    numbers of equal candidates for training.

    Null and empty texts have no spans.  A column of ``docs`` already named ``out`` is replaced.
    """
    ws = Workspace(docs.sparkSession, "pii")
    docs = docs.drop(out)
    carried = [c for c in carry or docs.columns if c != out]
    if "candidates" in docs.columns:
        docs, carried = docs.withColumnRenamed("candidates", "_own"), ["_own" if c == "candidates" else c for c in carried]
    found = _candidates(docs, text_col).select(*carried, "candidates")
    if scorer is None:
        found = ws.save(found)
        scorer = train_scorer(found)
    place = f"array_position(array({', '.join(map(repr, KINDS))}), c.kind)"
    found = found.withColumn("_all", F.expr(f"array_sort(transform(candidates, c -> struct({place} as place, c.start as start, c.kind as kind, c.end as end, c.base as base, if(c.base, 1D, {scorer.score('c.features')}) as score, if(c.base, 0D, {scorer.limit('c')}) as least)))"))
    # base spans of a kind don't overlap each other: the last one before a span and the first one after it decide.  Kinds lie apart by more than any text has.
    shift = "c.place * 4294967296L"
    found = found.withColumn("_ends", F.expr(f"transform(_all, c -> if(c.base, {shift} + c.end, -1L))"))
    found = found.withColumn("_starts", F.expr(f"reverse(transform(_all, c -> if(c.base, {shift} + c.start, {1 << 62}L)))"))
    found = _scanned(found, "_ends", "_last", "greatest({a}, {x})", "-1L")
    found = _scanned(found, "_starts", "_next", "least({a}, {x})", f"{1 << 62}L")
    free = f"_last[i] <= {shift} + c.start and _next[size(_next) - 1 - i] >= {shift} + c.end"
    # repeated spans stand side by side
    chosen = f"(c.base or (c.score >= c.least and {free})) and (i = 0 or _all[greatest(i - 1, 0)] <> c)"
    ordered = F.expr(f"transform(filter(_all, (c, i) -> {chosen}), c -> struct(c.kind as kind, c.start as start, c.end as end, c.base as base, c.score as score))")
    found = found.withColumn(out, ordered).drop("candidates", "_all", "_ends", "_starts", "_last", "_next")
    return found.withColumnRenamed("_own", "candidates") if "_own" in found.columns else found


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``found`` with every span of ``text_col`` replaced by its kind in brackets; of overlapping spans the first covers the rest."""
    text = f"coalesce({text_col}, '')"
    spans = f"array_sort(transform({spans_col}, s -> struct(s.start as start, s.end as end, s.kind as kind)))"
    step = "(a, s) -> if(s.start < a.at, struct(greatest(a.at, s.end) as at, a.out as out), struct(s.end as at, concat(a.out, array(substring({0}, a.at + 1, s.start - a.at), concat('[', upper(s.kind), ']'))) as out))".format(text)
    return found.withColumn(text_col, F.expr(f"aggregate({spans}, struct(0 as at, array('') as out), {step}, a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
