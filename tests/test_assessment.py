"""Assessments, candidate building and run sources on small fixtures."""

import json

from pyspark.sql import functions as F

from rankloom.functions import assessments as A
from rankloom.operators import assembly, entities, structure
from rankloom.sources import artifacts


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


def test_query_text_has_plain_forms(spark):
    assert one(spark, A.normalize_query_text(F.col("t")), t="ﬁne­ly a‑b​ — x y ½") == "finely a-b - x y 1⁄2"
    assert one(spark, A.normalize_query_text(F.col("t")), t="plain - text") == "plain - text"


def test_nested_arrays_become_json(spark):
    values, changed = A.stored_array(F.col("v"))
    row = spark.createDataFrame([([[1, 2], [3]],), ([],), (None,)], "v array<array<int>>").select(values.alias("v"), changed.alias("c")).collect()
    assert [(r.v, r.c) for r in row] == [(["[1,2]", "[3]"], True), ([], False), (None, False)]


def test_token_phrases_and_spaced_capitals(spark):
    assert one(spark, A.contains_tokens(F.col("h"), F.col("n")), h=["a", "bc", "d"], n=["bc", "d"]) is True
    assert one(spark, A.contains_tokens(F.col("h"), F.col("n")), h=["a", "bcd"], n=["bc"]) is False
    assert one(spark, A.collapse_spaced_caps(F.col("t")), t="A B C stays, D A T A goes, I N D E X") == "A B C stays, DATA goes, INDEX"


def test_sources_and_ids_of_merged_candidates(spark):
    rows = [
        (1, "10.1234/a", None, None, "Long title", 2001, ["A. B"], 3, True, "one", "q", 1, 1), (2, "10.1234/A", None, None, "Longer title", 1999, ["A. B"], 5, None, "two", "q", 1, 2), (3, None, None, None, "Longer title", 1999, ["A. B"], 1, False, "one", "q", 2, 1),
        (4, None, None, "77", "", None, None, 0, None, "two", "q", 3, 1), (5, None, None, None, "", None, None, 0, None, "two", "q", 3, 2),
    ]
    records = spark.createDataFrame(rows, "rid long, doi string, arxiv string, pmid string, title string, year int, authors array<string>, citations long, is_core boolean, provider string, query_hash string, query int, rank int")
    found = entities.build_candidates(records, "rid")
    got = {r.first: r for r in found.collect()}
    assert set(got) == {1, 4, 5} and got[1].n == 3 and got[1].title == "Longer title" and got[1].year == 1999 and got[1].candidate == "10.1234/a"
    assert got[1].provider_ids == {"one": ["1", "3"], "two": ["2"]} and [s.query for s in got[1].sources] == [1, 1, 2] and got[4].candidate == "pmid:77"
    assert entities.merge_metrics(records, found).first().asDict() == {"records": 5, "candidates": 3, "merged": 1, "colliding": 0, "core": 1}


def test_headings_are_anchored_page_by_page(spark):
    blocks = spark.createDataFrame([("d", 1, 1, "x y"), ("d", 2, 3, "The method"), ("d", 3, 9, "Far away results")], "doc string, block int, page int, said string")
    proposals = spark.createDataFrame([("d", 10, 1, "nothing like it"), ("d", 11, 4, "The method"), ("d", 12, 20, "far away results"), ("e", 13, 1, "none")], "doc string, proposal int, page int, title string")
    got = {r.proposal: (r.block, r.method) for r in structure.anchor_headings(proposals, blocks, "doc").collect()}
    assert got == {10: (1, "page_start"), 11: (2, "text_match"), 12: (3, "text_match")}


def test_strong_pairs_compare_titles_once(spark):
    truth = spark.createDataFrame([("g", 1, "data and methods", 5), ("g", 2, "results", 50), ("h", 3, "results", 1)], "g string, truth int, a string, page int")
    made = spark.createDataFrame([("g", 7, "data and methods", 90), ("g", 8, "result", 52), ("h", 9, "appendix", 1)], "g string, produced int, b string, at int")
    assert sorted((r.truth, r.produced) for r in structure.strong_pairs(truth, made, "g").collect()) == [(1, 7), (2, 8)]


def test_snapshot_paths(spark):
    assert one(spark, assembly.normalised_path(F.col("p")), p=".\\Data\\A.PDF") == "data/a.pdf"


def test_themes_suites_and_xml(spark, tmp_path):
    (tmp_path / "theme.md").write_text("\n  The theme  \n\nFirst part\nof it\n\n\nSecond part\n")
    (tmp_path / "short.md").write_text("Only a title\n")
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.description) for r in artifacts.read_themes(spark, str(tmp_path / "*.md")).collect()}
    assert got == {"theme.md": ("The theme", "First part\nof it\n\nSecond part"), "short.md": ("Only a title", "Only a title")}
    (tmp_path / "c.json").write_text(json.dumps({"chapter_id": "c1", "title": "t"}))
    (tmp_path / "j.json").write_text(json.dumps({"chapter_id": "c1", "doc_id": "d1"}))
    (tmp_path / "suite.json").write_text(json.dumps({"suite_id": "s", "chapter_specs": ["c.json"], "judgments": ["j.json"], "documents": []}))
    suite = artifacts.read_suite(spark, str(tmp_path), "suite.json")
    assert set(suite) == {"chapters", "judgments"} and suite["chapters"].join(suite["judgments"], "chapter_id").first().doc_id == "d1"
    xml = "<TEI><title>On it</title><abstract>a</abstract><head>One</head><div><head> Two </head></div></TEI>"
    assert one(spark, artifacts.xml_summary(F.col("t")), t=xml).asDict() == {"status": "ok", "title": "On it", "heads": 2, "preview": ["One", "Two"], "has_abstract": True, "has_bibliography": False}
    assert one(spark, artifacts.xml_summary(F.col("t")), t="").status == "empty"
    out = str(tmp_path / "out")
    for n in (1, 2):
        artifacts.write_json_lines(spark.range(n), out, append=n > 1)
    assert spark.read.json(out).count() == 3
