"""Queries as trees, anchors in them, and quotes in their evidence, on small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import anchors as A
from rankloom.functions import querying as Q


def one(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select("*", *[c.alias(k) for k, c in columns.items()]).collect()


def test_trees_print_again(spark):
    queries = ['("a b" OR c) AND (d AND (e OR "f (g")) NOT h', 'x', '', '+("a") AND (b)', '(a', 'a) b', None]
    got = one(spark, [(q,) for q in queries], "q string", tree=Q.tree(F.col("q")), again=Q.printed(Q.tree(F.col("q"))))
    assert [r.again for r in got] == [q or "" for q in queries]
    assert [(t.text, t.depth) for t in got[0].tree if t.kind in ("open", "close")] == [("(", 0), (")", 0), ("(", 0), ("(", 1), (")", 1), (")", 0)]
    assert [t.depth for t in got[5].tree] == [0, 0, 0]


def test_exclusions_and_operators(spark):
    q = 'a not (b OR "c d" or (e)) and NOT "and not" NOT f'
    row = one(spark, [(q,)], "q string", upper=Q.uppercase_operators(F.col("q")), out=Q.excluded_terms(Q.tree(Q.uppercase_operators(F.col("q")))))[0]
    assert row.upper == 'a NOT (b OR "c d" OR (e)) AND NOT "and not" NOT f'
    assert row.out == ["b", "OR", "c d", "OR", "e", "and not", "f"] or row.out == ["b", "c d", "e", "and not", "f"]


def test_found_terms_in_either_number(spark):
    rows = [("policies/market-share of Boxes", ["policy", "box", "market share", "shares", "MARKET SHARE", " ", None], "en"), ("policies of boxes", ["policy", "box"], "de"), (None, ["a"], "en"), ("a b", None, "en")]
    got = one(spark, rows, "q string, terms array<string>, language string", hits=Q.found_terms(F.col("q"), F.col("terms"), F.col("language")))
    assert [r.hits for r in got] == [["market share", "policy", "shares", "box"], [], [], []]


def test_injection(spark):
    rows = [("solar cells", ['wind "power"', "tide", "wave"], "match"), ("solar", ["wind", "tide"], "authority"), ("wind", ["wind"], "match"), ("", ["wind"], "match"), ("x", [], "match")]
    b, added = Q.inject_anchor(F.col("q"), F.col("terms"), F.lit("en"), F.col("intent"))
    r, filled = Q.inject_required(F.col("q"), F.col("terms"), F.lit("en"), F.col("intent"))
    got = one(spark, rows, "q string, terms array<string>, intent string", b=b, added=added, r=r, filled=filled)
    assert [x.b for x in got] == ['("wind \'power\'" OR "tide") AND (solar cells)', '("wind") AND (solar)', "wind", '("wind")', "x"]
    assert [x.r for x in got] == ['+("wind \'power\'") +("tide") AND (solar cells)', '+("wind") AND (solar)', '+("wind") AND (wind)', '+("wind")', "x"]
    assert [x.added for x in got] == [True, True, False, True, False] and [x.filled for x in got] == [True, True, True, True, False]
    again, changed = Q.inject_anchor(F.col("b"), F.col("terms"), F.lit("en"), F.col("intent"))
    done = one(spark, [(x.b, x.terms, x.intent) for x in got if x.q != "solar cells"], "b string, terms array<string>, intent string", again=again, changed=changed)
    assert not any(x.changed for x in done) and all(x.again == x.b for x in done)


def test_faults(spark):
    rows = [("+(a | b) +\"c\" -d -e -f", "match"), ("a | b +(c)", "authority"), ("what?", "match"), ('+("a") +("b")', "match"), ("+(a) +(b) +(c) +(d)", "authority")]
    got = one(spark, rows, "q string, intent string", faults=Q.required_faults(F.col("q"), F.col("intent")))
    assert [r.faults for r in got] == [["too_many_negative"], ["bar_outside_brackets"], ["unsupported_character", "no_anchor", "too_few_required"], [], ["too_many_required"]]
    b = one(spark, [("a* b", "title"), ('a NOT "b, c"', "search"), ("a* NOT (b OR c)", "search")], "q string, field string", faults=Q.boolean_faults(F.col("q"), F.col("field")))
    assert [r.faults for r in b] == [["advanced_syntax"], ["exclusion_not_atomic"], []]


# quotes


def plain_form(w):
    table = {**A.QUOTES_AND_DASHES, "­": ""}
    w = "".join(table.get(c, c) for c in w).lower().strip().strip("\"'()[]{}<>.,;:!?")
    return re.sub(r"^[^\w]+|[^\w]+$", "", w).replace("-", "")


def plain_span(start, n, total, least=8, most=20):
    left, right = max(0, start), min(total, start + n)
    while right - left < least and (right < total or left > 0):
        if right < total:
            right += 1
        else:
            left -= 1
    right = min(right, left + most)
    return (left, right - left) if right - left >= least else (None, None)


def test_anchor_places(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        words = [rng.choice(["the", "co-operation", "“Ünder", "it’s", "end.", "(a)", "–", "of"]) for _ in range(rng.randrange(1, 25))]
        text = "".join(w + rng.choice([" ", "  ", "\n", " \t"]) for w in words)
        i = rng.randrange(len(words))
        needle = words[i : i + rng.randrange(1, 9)]
        rows.append((text, " ".join(w.replace("’", "'").replace("“", '"').replace("co-op", "coop") for w in needle)))
    rows += [("", "a b c"), (None, "a"), ("a b", None), ("x y z", "a…")]
    v = A.validate_anchor(F.col("anchor"), F.col("text"), 1, 8)
    df = spark.createDataFrame(rows, "text string, anchor string").withColumn("v", v)
    left, n = A.expanded(F.col("v.start"), F.col("v.n"), F.size(F.split(A.single_blanks(F.col("text")), " ")))
    df = df.withColumns({"left": left, "size": n}).withColumn("place", A.place_of_words(F.col("text"), F.col("left"), F.col("size")))
    for r in df.collect():
        words, needle = (r.text or "").split(), (r.anchor or "").split()
        forms, wanted = [plain_form(w) for w in words], [plain_form(w) for w in needle]
        found = next((i for i in range(len(words) - len(needle) + 1) if forms[i : i + len(needle)] == wanted), None) if needle else None
        if r.v.reason == "snapped":
            assert (r.v.start, r.v.n, r.v.text) == (found, len(needle), " ".join(words[found : found + len(needle)]))
            assert (r.left, r.size) == plain_span(found, len(needle), len(words))
            if r.left is not None:
                assert r.text[r.place.start : r.place.end].split() == words[r.left : r.left + r.size]
        else:
            assert found is None or "…" in r.anchor
            assert r.place is None


@pytest.mark.parametrize(("anchor", "reason"), [("ﬁne words here", "snapped"), ("ne wor", "normalized_substring"), ("  ", "empty"), ("a...", "ellipsis"), ("one two three four five", "word_count"), ("other words", "not_found_in_evidence")])
def test_reasons_of_anchors(spark, anchor, reason):
    row = one(spark, [(anchor, "Some fine words, here.")], "a string, e string", v=A.validate_anchor(F.col("a"), F.col("e"), 1, 4))[0]
    assert row.v.reason == reason
