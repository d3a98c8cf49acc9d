"""Logs that are killed and go on, observed expectations, JSON lines by ranges, nested records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import migration as M
from rankloom.operators import quality as Q
from rankloom.operators import telemetry
from rankloom.sources import lines
from rankloom.streaming import calls, rollups

CALL = "stage string, input_tokens long, cached_input_tokens long, output_tokens long, cost_usd double"


def some_calls(spark, path, name, n):
    rows = [(f"s{i % 3}", i, None, 2, 0.25) for i in range(n)]
    spark.createDataFrame(rows, CALL).coalesce(1).write.mode("append").parquet(str(path / name))
    return rows


def test_call_log_counts_each_call_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    rows = some_calls(spark, tmp_path / "in", "a", 30)
    stream = lambda: rollups.read_events(spark, f"{tmp_path}/in/*", "*.parquet", 1)
    # a batch that was killed after some of its calls, before its sums
    spark.createDataFrame(rows[:7], CALL).write.parquet(f"{log}/calls/batch=0")
    calls.append_calls(stream(), log, checkpoint, ["stage"])
    total = lambda: calls.running_summary(spark, log).first()
    assert (total().call_count, total().input_tokens, total().total_tokens) == (30, sum(range(30)), sum(range(30)) + 60)
    # killed after its sums, before the checkpoint: the batch is run again
    more = some_calls(spark, tmp_path / "in", "b", 5)
    spark.createDataFrame(more, CALL).write.parquet(f"{log}/calls/batch=1")
    spark.createDataFrame(more, CALL).groupBy("stage").agg(F.count("*").alias("call_count"), *[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in calls.MEASURES]).write.parquet(f"{log}/sums/batch=1")
    calls.append_calls(stream(), log, checkpoint, ["stage"])
    calls.append_calls(stream(), log, checkpoint, ["stage"])  # nothing new
    assert total().call_count == 35 and calls.logged_calls(spark, log).count() == 35
    by_stage = {r.stage: r.call_count for r in calls.running_summary(spark, log, ["stage"]).collect()}
    assert by_stage == {"s0": 12, "s1": 12, "s2": 11}
    # a batch without sums is not finished
    spark.createDataFrame(more, CALL).write.parquet(f"{log}/calls/batch=9")
    assert calls.logged_calls(spark, log).count() == 35


@pytest.mark.parametrize("most", [25, 1000])
def test_backfill_goes_on(spark, tmp_path, most):
    rng = random.Random(1)
    rows = [(i // 3, i, rng.choice("ab"), rng.randrange(-2, 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts long, id long, kind string, tokens long")
    state = str(tmp_path / f"state{most}")
    scan = lambda stop, df=df: calls.backfill(df, state, ["ts", "id"], F.col("kind"), F.col("tokens"), most, 10, stop)
    assert not scan(1)
    (tmp_path / f"state{most}" / "pages" / "page=2" / "_temporary").mkdir(parents=True)  # killed while it wrote
    later = df.union(spark.createDataFrame([(99, 99, "new", 7)], df.schema))  # newer than the cursor: not seen any more
    assert not scan(1, later)
    assert scan(None, later) and scan(None, later)
    newest = sorted(rows, reverse=True)[:most]
    want = {k: (sum(r[2] == k for r in newest), sum(max(0, r[3]) for r in newest if r[2] == k)) for k in "ab"}
    assert {r.label: (r.n, r.amount) for r in calls.backfilled(spark, state).collect()} == want


def test_backfill_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "ts long, id long, kind string, tokens long")
    assert calls.backfill(df, str(tmp_path / "s"), ["ts", "id"], F.col("kind"), F.col("tokens"))
    assert calls.backfilled(spark, str(tmp_path / "s")).count() == 0


def test_expectations_ride_along(spark, tmp_path):
    checks = [Q.Expectation("positive", F.col("x") > 0, "FAIL", "> 0"), Q.Expectation("small", F.col("x") < 10, "WARN", "< 10")]
    for values, verdict in (([1, 2], "success"), ([1, 20], "success_with_warnings"), ([0, None], "failed"), ([], "failed")):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x int")
        out, seen = Q.observed(df, checks)
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
        assert Q.verdict_of(seen.get, checks) == verdict and seen.get["rows"] == len(values)
        rows = {r.check: (r.status, r.broken, r.examples) for r in Q.expectation_rows(df, "id", checks).collect()}
        assert rows["positive"][1] == sum(not v or v <= 0 for v in values) and (rows["positive"][0] == "OK") == (rows["positive"][1] == 0)
    assert rows["small"] == ("OK", 0, "none")


def test_orphans_and_documents_without_anything(spark):
    summary = spark.createDataFrame([(d, 80.0, 3, 12, 0, 0, True) for d in "abc"], "doc_id string, coverage double, section_count int, page_count int, tiny_count int, fallback_count int, has_references boolean")
    sections = spark.createDataFrame([("a", "a1"), ("b", "b1")], "doc_id string, section_id string")
    passages = spark.createDataFrame([("a", "a1"), ("a", "zz"), ("b", None)], "doc_id string, section_id string")
    docs = Q.structured_documents(summary, sections, passages)
    assert {r.doc_id: (r.sections, r.passages, r.orphans) for r in docs.collect()} == {"a": (1, 2, 1), "b": (1, 1, 1), "c": (0, 0, 0)}
    checks = Q.expectation_rows(docs, "doc_id", Q.document_expectations())
    assert {r.check: r.examples for r in checks.filter("status = 'FAIL'").collect()} == {"sections_produced": "c", "passages_produced": "c", "orphan_passages": "a, b"}
    assert Q.assessment(checks, docs).first().status == "failed"


def test_telemetry_of_nothing(spark):
    row = telemetry.telemetry(spark.createDataFrame([], "provider string, query_id int, intent string, language string, year int, failed boolean, hits int")).first()
    assert row.totals.n == 0 and row.providers == [] and [b.n for b in row.hits_histogram] == [0] * 10


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_lines_by_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    records = [{"id": i, "text": "é\U0001f600 " * rng.randrange(4) + "x\ny", "tags": [str(i)] * (i % 3)} for i in range(20 if size < 5 else 60)]
    text = "".join(rng.choice(["", "\n", "not json\n", "[1]\n", "  \n"]) + json.dumps(r, ensure_ascii=False) + "\n" for r in records)
    (tmp_path / "a.jsonl").write_text(text.rstrip("\n"))  # the last line has no end
    (tmp_path / "b.jsonl").write_text("")
    got = lines.read_line_documents(spark, str(tmp_path), "id long, text string, tags array<string>, other string", size)
    assert sorted((r.id, r.text, r.tags, r.other) for r in got.collect()) == [(r["id"], r["text"], r["tags"], None) for r in records]


def test_written_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 1000, 1, 4).withColumn("text", F.concat(F.lit("é\n"), F.col("id").cast("string")))
    lines.write_line_documents(df, path, batch=7)
    lines.write_line_documents(df.filter("id < 3"), path, overwrite=False)
    back = lines.read_line_documents(spark, path, "id long, text string", 512)
    assert back.count() == 1003 and back.select("id", "text").distinct().count() == 1000
    bad = df.withColumn("boom", F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).cast("string"))
    with pytest.raises(Exception, match="no"):
        lines.write_line_documents(bad, path)
    assert lines.read_line_documents(spark, path, "id long, text string").count() == 1003
    lines.write_line_documents(df.limit(0), path)
    assert lines.read_line_documents(spark, path, "id long, text string").count() == 0


def test_rows_are_visited_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def visit(rows):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([r["id"] for r in rows]))

    lines.for_each_batch_of_rows(spark.range(0, 103, 1, 3), visit, 10)
    seen = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(i for s in seen for i in s) == list(range(103)) and max(map(len, seen)) == 10


def test_nested_records(spark):
    low = M.Level("low", "id", {"size": "r.n", "note": "coalesce(r.missing, 'none')"})
    mid = M.Level("mid", "id", {"title": "upper(r.t)"}, "kids", low)
    top = M.Level("top", "id", {"who": "r.name"}, "things", mid)
    rows = [(1, "a", [("m1", "t", [("x", 1), ("y", 2)]), (None, "u", None)]), (2, "b", None), (3, None, [None, ("m2", None, [("z", None)])])]
    df = spark.createDataFrame(rows, "id int, name string, things array<struct<id:string,t:string,kids:array<struct<id:string,n:int>>>>")
    tables = M.migrate(df, top)
    assert sorted(tuple(r) for r in tables["mid"].select("path", "parent", "depth").collect()) == [("1/#1", "1", 1), ("1/m1", "1", 1), ("3/m2", "3", 1)]
    assert sorted((r.path, r.size, r.note) for r in tables["low"].collect()) == [("1/m1/x", 1, "none"), ("1/m1/y", 2, "none"), ("3/m2/z", None, "none")]
    assert {r.level: (r.records, r.rows, r.orphans, r.missing) for r in M.migration_check(df, tables, top).collect()} == {"top": (3, 3, 0, 0), "mid": (3, 3, 0, 0), "low": (3, 3, 0, 0)}
    lost = tables | {"mid": tables["mid"].filter("path <> '1/m1'")}
    assert {r.level: (r.orphans, r.missing) for r in M.migration_check(df, lost, top).collect()}["low"] == (2, 0)
    assert set(M.migrate(df, top, deepest=2)) == {"top", "mid"}
