"""Operators that no SQL expresses, against small independent versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.functions import scores, text, vectors
from rankloom.operators import decisions, entities, joins, retrieval, sections, selection, state
from rankloom.sources import artifacts
from rankloom.streaming import rollups

DATA = "/root/testdata/sf0.001"


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_mmr_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, float(rng.random()), rng.normal(size=4).tolist()) for i in range(60)]
    got = retrieval.mmr(spark.createDataFrame(rows, "g int, id int, score double, v array<double>"), "g", "id", "score", "v", k=3)
    for g in (0, 1):
        pool = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:18]
        unit = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in pool}
        left, order = list(pool), []
        while len(order) < 3:
            best = max(left, key=lambda r: 0.82 * r[2] - 0.18 * max((float(unit[r[1]] @ unit[o]) for o in order), default=0.0))
            order.append(best[1])
            left.remove(best)
        order += [r[1] for r in left]
        assert [r.id for r in got.filter(F.col("g") == g).orderBy("position").collect()] == order


def test_mmr_with_ties_missing_vectors_and_one_row(spark):
    rows = spark.createDataFrame([("a", 2, 1.0, [0.0]), ("a", 1, 1.0, [0.0]), ("b", 7, 0.5, [1.0])], "g string, id int, score double, v array<double>")
    assert pairs(retrieval.mmr(rows, "g", "id", "score", "v", k=1), "g", "position", "id") == [("a", 1, 1), ("a", 2, 2), ("b", 1, 7)]


def test_xquad_equals_picks_from_the_whole_group(spark):
    rng = random.Random(12)
    rows = [(g, i, rng.random(), [rng.random() ** 8 for _ in range(6)]) for g in range(4) for i in range((5, 60, 200, 201)[g])]
    df = spark.createDataFrame(rows, "g int, id int, base double, s array<double>")
    for pool in (None, 1, 3):
        got = retrieval.xquad(df, "g", "id", "base", "s", limit=12, trade=2.0, pool=pool).orderBy("g", "position").collect()
        for g in range(4):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
            most = [max(r[3][k] for r in mine) for k in range(6)]
            covered, picked = [0.0] * 6, []
            for _ in range(min(12, len(mine))):
                best = max((r for r in mine if r[1] not in picked), key=lambda r: r[2] + 2.0 * sum(x / m / (1 + c) for x, m, c in zip(r[3], most, covered)))
                picked.append(best[1])
                covered = [c + x / m for c, x, m in zip(covered, best[3], most)]
            assert [r.id for r in got if r.g == g] == picked


def test_xquad_prefers_uncovered_aspects(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.95, [1.0, 0.0]), (0, 3, 0.8, [0.0, 1.0])], "g int, id int, base double, s array<double>")
    got = retrieval.xquad(rows, "g", "id", "base", "s", limit=3, trade=1.0)
    assert [r.id for r in got.orderBy("position").collect()] == [1, 3, 2]


def test_bm25_counts_repeated_query_terms_and_common_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha gamma"), (3, ""), (4, None)], "d int, t string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha"), (3, "")], "q int, t string")
    got = {(r.q, r.d): r.score for r in retrieval.bm25(docs, queries, "d", "t", "q", "t").collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    idf, mean = np.log(1 + 2.5 / 2.5), 5 / 4
    assert np.isclose(got[1, 1], idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)))
    assert np.isclose(got[2, 1], 2 * got[1, 1])


def test_online_merge_equals_a_replay(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [f"k{k}" for k in rng.integers(0, 150, rng.integers(0, 4))] + (["hot"] if i % 3 == 0 else [])) for i in rng.permutation(600)]
    rows += [(1000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(40)]  # a chain of steps
    owner, wanted = {}, []
    for i, keys in sorted(rows):
        cluster = next((owner[k] for k in keys if k in owner), i)
        for k in keys:
            owner.setdefault(k, cluster)
        wanted.append((i, cluster))
    rows += [(2000, None), (2001, [None]), (2002, [None, "hot"])]
    wanted += [(2000, 2000), (2001, 2001), (2002, owner["hot"])]
    got = entities.merge_online(spark.createDataFrame(rows, "rid long, keys array<string>"), "rid", "keys")
    assert pairs(got, "rid", "cluster") == wanted


def test_online_merge_does_not_unify_bridged_clusters(spark):
    rows = [(1, ["a"]), (2, ["b"]), (3, ["b", "a", "c"]), (4, ["c"]), (5, ["a", "c"]), (6, []), (7, ["d"])]
    got = entities.merge_online(spark.createDataFrame(rows, "rid long, keys array<string>"), "rid", "keys")
    assert pairs(got, "rid", "cluster") == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (6, 6), (7, 7)]


def test_online_merge_of_the_query(spark):
    from rankloom.plans import entities as plan

    keyed = plan._keyed(spark, DATA).select("rid", "keys").collect()
    owner, expected = {}, []
    for r in sorted(keyed, key=lambda r: r.rid):
        cluster = next((owner[k] for k in r.keys if k in owner), r.rid)
        for k in r.keys:
            owner.setdefault(k, cluster)
        expected.append((r.rid, cluster))
    assert pairs(plan.candidate_dedupe_online(spark, DATA), "rid", "cluster") == expected


def test_lease(spark):
    events = [("t", 1, "claim", 0), ("t", 2, "claim", 5), ("t", 3, "claim", 20), ("t", 4, "complete", 21), ("t", 5, "complete", 22), ("u", 1, "complete", 0)]
    got = state.lease_replay(spark.createDataFrame(events, "task string, n int, action string, at long"), "task", ["n"], 10)
    assert pairs(got, "task", "n", "outcome") == [("t", 1, "claimed"), ("t", 2, "refused"), ("t", 3, "reclaimed"), ("t", 4, "completed"), ("t", 5, "already_done"), ("u", 1, "refused")]


def test_reservations(spark):
    rows = [(1, 1, "a", "reserve", 6.0), (1, 2, "b", "reserve", 6.0), (1, 3, "a", "reserve", 1.0), (1, 4, "a", "release", 0.0), (1, 5, "b", "reserve", 6.0), (1, 6, "a", "reserve", 1.0), (1, 7, "z", "release", 0.0)]
    df = spark.createDataFrame(rows, "u int, n int, operation string, kind string, required double").withColumn("balance", F.lit(10.0))
    got = [(r.outcome, r.available) for r in state.reservations(df, "u", ["n"]).orderBy("n").collect()]
    assert got == [("reserved", 4.0), ("blocked", 4.0), ("already_reserved", 4.0), ("released", 10.0), ("reserved", 4.0), ("finalized", 4.0), ("unknown", 4.0)]


def test_rate_limit_closed_form_equals_a_loop(spark):
    at = [0, 10, 500, 510, 520, 3000]
    got = state.rate_limit(spark.createDataFrame([("p", i, a) for i, a in enumerate(at)], "p string, i int, at long"), "p", "at", ["i"], 100, 5)
    following, expected = 0, []
    for now in at:
        expected.append(max(now + 5, following))
        following = expected[-1] + 100
    assert [r.reserved for r in got.orderBy("i").collect()] == expected


def test_rate_limit_resets_slots_too_far_ahead(spark, tmp_path):
    rows = [(p, i, 7 * i) for p in ("p", "q") for i in range(60)]
    expected, following = {}, {}
    for p, _, now in rows:
        after = following.get(p, 0)
        after = now if after > now + 500 else after
        expected[p, now] = max(now + 5, after)
        following[p] = expected[p, now] + 100
    frame = spark.createDataFrame(rows, "p string, i int, at long")
    got = state.rate_limit(frame, "p", "at", ["i"], 100, 5, 500).collect()
    assert {(r.p, r.at): r.reserved for r in got} == expected and all(r.wait == r.reserved - r.at <= 500 for r in got)
    frame.select("p", "at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rollups.rate_limit(spark.readStream.schema("p string, at long").parquet(str(tmp_path / "in")), "p", 100, 5, 500)
    stream.writeStream.format("memory").queryName("reset").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.p, r.at): r.reserved for r in spark.table("reset").collect()} == expected
    day = spark.createDataFrame([("p", i, i) for i in range(30)], "p string, i int, at long")
    assert max(r.wait for r in state.rate_limit(day, "p", "at", ["i"], 3_600_000 * 2, 5).collect()) <= 86_400_000


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("p", a) for a in (0, 10, 500, 510)] + [("q", 7)], "p string, at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rollups.rate_limit(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "p", 100, 5)
    query = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert pairs(spark.table("limited"), "p", "at", "reserved") == [("p", 0, 5), ("p", 10, 105), ("p", 500, 505), ("p", 510, 605), ("q", 7, 12)]


def test_stream_counts_each_grant_once(spark, tmp_path):
    rows = spark.sql("select * from values (1, timestamp '2024-01-01 00:00:00'), (1, timestamp '2024-01-01 00:01:00'), (2, timestamp '2024-01-01 00:02:00') as t(grant_id, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rollups.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "grant_id", "ts", "1 hour")
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert pairs(spark.table("once"), "grant_id") == [(1,), (2,)]


def test_document_decisions_give_every_reason(spark):
    documents = spark.createDataFrame([(i,) for i in range(6)], "doc int")
    rows = [(1, 1, 10.0, 0.1, True), (2, 1, 20.0, 0.1, True), (3, 1, 50.0, 0.1, False), (4, 1, 36.0, 0.0, True), (5, 1, 90.0, 0.9, True), (5, 2, 60.0, 0.9, True)]
    found = decisions.document_decisions(documents, spark.createDataFrame(rows, "doc int, section int, score double, support double, type_ok boolean"), ["doc"], decisions.Thresholds(34, 22, 0.5, 18, 38))
    assert pairs(found.fillna({"reason": "-"}), "doc", "reason") == [(0, "no_ranked_sections"), (1, "below_floor"), (2, "no_useful_section"), (3, "only_penalised_sections"), (4, "low_probability"), (5, "-")]


def test_section_parents(spark):
    rows = spark.createDataFrame([(1, i, level) for i, level in enumerate([1, 2, 3, 2, 1, 3])], "d int, i int, level int")
    assert pairs(sections.parents(rows, "d", "i", "level").fillna({"parent": -1}), "i", "parent") == [(0, -1), (1, 0), (2, 1), (3, 0), (4, -1), (5, 4)]


def test_packed_passages(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e\nf g h i j k l m n"), (2, ""), (3, None)], "k int, t string")
    got = pairs(sections.packed_passages(rows, "k", "t", target=5, most=1.5), "k", "passage", "text")
    assert got == [(1, 0, "a b c d e"), (1, 1, "f g h i j"), (1, 2, "k l m n")]


def test_overlapping_chunks_repeat_the_last_sentence(spark):
    rows = spark.createDataFrame([(1, "One two.  Three\nfour. Five six. Seven."), (2, None), (3, "x y")], "k int, t string")
    want = [(1, 0, "One two. Three four."), (1, 1, "Three four. Five six."), (1, 2, "Five six. Seven."), (1, 3, "Seven."), (3, 0, "x y")]
    assert pairs(sections.overlapping_chunks(rows, "k", "t", most=24), "k", "chunk", "text") == want


def test_overlapping_chunks_keep_long_sentences(spark):
    words = [f"word{i}" for i in range(399)] + ["end."] + ["9" * 2000, "tail."]
    got = pairs(sections.overlapping_chunks(spark.createDataFrame([(1, " ".join(words))], "k int, t string"), "k", "t"), "chunk", "text")
    assert all(len(t) <= 900 for _, t in got)
    assert {w for _, t in got for w in t.split()} >= set(words) - {"9" * 2000} and sum(t.count("9" * 100) for _, t in got) >= 20


def test_interval_overlap_meets_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 55, 60)], "k int, s long, e long")
    b = spark.createDataFrame([(1, 40, 70), (1, 100, 100), (1, 101, 102)], "k int, s2 long, e2 long")
    got = joins.interval_overlap(a, b, ["k"], ("s", "e"), ("s2", "e2"), 10)
    assert pairs(got, "s", "s2") == [(0, 40), (0, 100), (55, 40)]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.clean_html(F.lit("<p>a &amp;lt; b&nbsp; c</p>")).alias("html"),
        text.ascii_fold(F.lit("Größe café Ж")).alias("fold"),
        text.natural_key(F.lit("2.10")).alias("key"),
        text.truncate(F.lit("abcdef"), 4).alias("cut"),
        text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("grams"),
        text.word_chunks(F.lit(" a b  c "), 2).alias("chunks"),
        text.word_chunks(F.lit(None).cast("string"), 2).alias("none"),
        artifacts.inverted_index_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("back"),
        vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        scores.band(F.lit(70)).alias("band"),
    ).first()
    assert row.html == "a &lt; b c" and row.fold == "Groe cafe " and row["key"] == [2, 10] and row.cut == "abc…"
    assert row.grams == ["a b", "b c"] and row.chunks == ["a b", "c"] and row.none == [] and row.back == "a b a" and row.zero == 0 and row.band == "high"


def test_artifacts(spark, tmp_path):
    lines = tmp_path / "run"
    lines.mkdir()
    (lines / "b.jsonl").write_text('{"id": 2}\n\nnot json\n{"id": 3}\n')
    (lines / "a.jsonl").write_text('{"id": 1}\n')
    assert pairs(artifacts.read_shards(spark, str(lines), "*.jsonl", "id int"), "shard", "id") == [("a.jsonl", 1), ("b.jsonl", 2), ("b.jsonl", 3)]
    assert artifacts.count_lines(spark, str(lines)).first().n == 4
    files = artifacts.read_files(spark, str(lines))
    assert artifacts.check_manifest(files, files).isEmpty()
    wrong = files.select("path", F.lit("0").alias("sha256")).union(spark.createDataFrame([("../x", "1")], "path string, sha256 string"))
    assert sorted(r.problem for r in artifacts.check_manifest(files, wrong).collect()) == ["differs", "differs", "unsafe"]
    rows = spark.createDataFrame([(1, ["x", "y"], "p"), (2, [], "q")], "id int, tags array<string>, part string")
    artifacts.write_csv(rows.drop("part"), str(tmp_path / "csv"))
    assert pairs(spark.read.option("header", True).csv(str(tmp_path / "csv")).fillna(""), "id", "tags") == [("1", "x, y"), ("2", "")]
    artifacts.replace_partitions(rows, str(tmp_path / "t"), ["part"])
    artifacts.replace_partitions(rows.filter("part = 'q'").withColumn("id", F.lit(9)), str(tmp_path / "t"), ["part"])
    table = spark.read.parquet(str(tmp_path / "t"))
    assert pairs(table, "id") == [(1,), (9,)]
    assert artifacts.verify_written(table, rows, ["id"]).first().asDict() == {"expected": 2, "missing": 1, "unexpected": 1}
    outline = spark.createDataFrame([(1, '[{"title": "A", "page": 1, "children": [{"title": "B", "page": 2}]}]')], "d int, o string")
    assert pairs(artifacts.outline_rows(spark, outline, "d", "o", 3), "level", "title") == [(1, "A"), (2, "B")]


def test_quotas_then_fill(spark):
    rows = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(8)], "id int, b string").withColumn("g", F.lit(1))
    got = selection.quotas_then_fill(rows, ["g"], F.col("b"), {"y": 1, "x": 2}, ["id"], 5)
    assert [r.id for r in got.orderBy("position").collect()] == [5, 0, 1, 2, 3]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g int, id int, score double, v array<double>")
    assert retrieval.mmr(empty, "g", "id", "score", "v").isEmpty()
    assert entities.merge_online(spark.createDataFrame([], "rid long, keys array<string>"), "rid", "keys").isEmpty()


def test_anchors_search_the_page_then_its_neighbours_then_all(spark):
    from rankloom.operators import structure

    blocks = spark.createDataFrame([(1, 0, 1, "Intro text"), (1, 1, 2, "Methods"), (1, 2, 2, "Other"), (1, 3, 4, "Results here")], "d int, block int, page int, said string")
    proposals = spark.createDataFrame([(1, 10, 2, "methods"), (1, 11, 2, "nothing alike"), (1, 12, 3, "Results  here"), (1, 13, 9, "Intro, text"), (1, 14, 9, "zzz")], "d int, proposal int, page int, title string")
    got = structure.anchor_headings(proposals, blocks, "d").fillna({"block": -1, "method": "-"})
    assert pairs(got, "proposal", "block", "method") == [(10, 1, "text_match"), (11, 1, "page_start"), (12, 3, "text_match"), (13, 0, "text_match"), (14, -1, "-")]


def test_greedy_matching_is_one_to_one(spark):
    from rankloom.operators import structure

    rows = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.85), ("g", 2, 2, 0.5), ("g", 3, 1, 0.9)], "g string, truth int, produced int, score double")
    assert pairs(structure.one_to_one(rows, "g"), "truth", "produced") == [(1, 1), (2, 2)]


def test_sequence_ratio_is_that_of_the_library(spark):
    from difflib import SequenceMatcher

    from rankloom.operators import structure

    a, b = "growth of towns", "the growth of a town"
    row = spark.range(1).select(structure.sequence_ratio(F.lit(a), F.lit(b)).alias("r"), structure.similarity(F.lit(""), F.lit("")).alias("z")).first()
    assert row.r == SequenceMatcher(None, a, b).ratio() and row.z == 0


def test_imports_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True).returncode == 0


def test_ranks_and_statistics_over_many_ranges(spark):
    import random

    from rankloom.operators import ordering

    rng = random.Random(4)
    rows = [(i % 3, i, rng.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, id int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.global_rank(df.repartition(7), [F.desc("v"), "id"]).collect()
        assert [(r.position, r.id) for r in sorted(got, key=lambda r: r.position)] == [(i + 1, r[1]) for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))]
        ranks = ordering.group_rank(df.repartition(7), "g", ["v", "id"], "rank").collect()
        for g in range(3):
            assert [r.id for r in sorted([r for r in ranks if r.g == g], key=lambda r: r["rank"])] == [r[1] for r in sorted([r for r in rows if r[0] == g], key=lambda r: (r[2], r[1]))]
        middle = {r.g: r.m for r in ordering.order_statistics(df, "g", "v", {"m": F.floor(F.col("n") / 2)}).collect()}
        assert middle == {g: sorted(r[2] for r in rows if r[0] == g)[sum(r[0] == g for r in rows) // 2] for g in range(3)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordering.global_rank(df.limit(0), ["v", "id"]).isEmpty()
