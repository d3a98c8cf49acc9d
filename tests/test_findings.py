"""Small cases of what a reviewer found on odd inputs and larger tables."""

import random

import duckdb
from pyspark.sql import functions as F

from rankloom.functions import anchors, querying
from rankloom.functions.vectors import cosine as vectors_cosine
from rankloom.operators import bridges, decisions, entities, headings, joins, retrieval, state, stats, structure, workspace
from rankloom.plans import registry

from .test_oracles import rows_of


def same_as_sql(spark, tmp_path, name, **tables):
    """Runs a query on tables given as SQL and compares it with its own SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"create table {t} as {sql}")
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    expected = con.sql(registry.ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_rank_correlation_of_more_rows_than_the_cube_of_64_bits(spark):
    rows = spark.range(2_100_000).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), "id")
    row = stats.spearman(rows, "a", "b", "id").first()
    assert abs(row.rho + 1) < 1e-9 and row.n == 2_100_000


def test_latest_run_of_users_without_orders_and_with_nulls(spark, tmp_path):
    orders = "(1, 10, 'O', timestamp '2020-01-01'), (2, 10, null, timestamp '2019-01-01'), (3, 11, 'O', null), (4, 11, 'O', timestamp '2020-01-01'), (null, 12, 'O', timestamp '2021-01-01'), (5, 13, null, timestamp '2020-01-01'), (6, 14, 'F', timestamp '2020-01-01')"
    same_as_sql(
        spark, tmp_path, "latest_active_run", customer="select unnest([10, 10, 11, 12, 13, 14, 15, null])::bigint as c_custkey",
        orders=f"select k::bigint as o_orderkey, c::bigint as o_custkey, s as o_orderstatus, d as o_orderdate from (values {orders}) t(k, c, s, d)",
    )


def test_anchors_compare_a_text_once_with_a_title(spark):
    blocks = spark.range(4000).select(F.lit("d").alias("doc"), F.col("id").alias("block"), F.lit(1).alias("page"), F.concat(F.lit("growth of the towns along the river "), (F.col("id") % 3).cast("string")).alias("said"))
    proposals = spark.range(4000).select(F.lit("d").alias("doc"), F.col("id").alias("proposal"), F.lit(1).alias("page"), F.concat(F.lit("Growth of towns by the river "), (F.col("id") % 4).cast("string")).alias("title"))
    got = structure.anchor_headings(proposals, blocks, "doc").groupBy("block", "method").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(0, "text_match", 2000), (1, "text_match", 1000), (2, "text_match", 1000)]


def test_matching_without_pairs_is_that_of_the_pairs(spark):
    draw = random.Random(5)
    titles = ["data and methods", "the data and the methods used", "data and methods used", "results", "result", "", "general results of it", "methods and data", "conclusion"]
    rows = lambda n: [("gh"[draw.randrange(2)], draw.randrange(60), draw.choice(titles), draw.choice([None, 1, 4, 7, 20, 22, 90])) for _ in range(n)]
    truth = spark.createDataFrame(rows(90), "g string, truth int, a string, page int")
    produced = spark.createDataFrame(rows(90), "g string, produced int, b string, at int")
    plain = structure.one_to_one(structure.strong_pairs(truth, produced, "g"), "g")
    got = structure.matched_sections(truth, produced, "g")
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 30


def test_matching_of_a_large_group_of_equal_titles(spark):
    truth = spark.range(30_000).select(F.lit("g").alias("g"), F.col("id").alias("truth"), F.lit("results").alias("a"), (F.col("id") % 50).alias("page"))
    produced = spark.range(30_000).select(F.lit("g").alias("g"), F.col("id").alias("produced"), F.lit("results").alias("b"), (F.col("id") % 50).alias("at"))
    row = structure.matched_sections(truth, produced, "g").agg(F.count("*").alias("n"), F.countDistinct("truth").alias("t"), F.countDistinct("produced").alias("p")).first()
    assert row.asDict() == {"n": 30_000, "t": 30_000, "p": 30_000}


def test_similar_titles_of_repeated_titles(spark):
    rows = [(i, "g" if i < 40 else "h", ["a b c", "a b", "c d", "", "a b d"][i % 5]) for i in range(60)]
    got = joins.similar_titles(spark.createDataFrame(rows, "left_id int, g string, t string"), ["g"], "left_id", "right_id", "t", 0.5)
    jaccard = lambda x, y: len({*x.split(" ")} & {*y.split(" ")}) / len({*x.split(" ")} | {*y.split(" ")})
    expected = sorted((i, j) for i, g, x in rows for j, h, y in rows if g == h and i < j and jaccard(x, y) >= 0.5)
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == expected


def test_sources_of_a_candidate_with_many_records(spark):
    """Each source once, in order, where comparing all with all would take hours."""
    k = F.col("id")
    none = F.lit(None).cast("string")
    records = spark.range(200_000).select(
        k.alias("rid"), F.lit("10.1/a").alias("doi"), none.alias("arxiv"), none.alias("pmid"), F.lit("t").alias("title"), F.lit(2000).alias("year"), F.array(F.lit("A. Name")).alias("authors"), k.alias("citations"),
        F.lit(True).alias("is_core"), F.lit("one").alias("provider"), F.lit("h").alias("query_hash"), (100_000 - F.abs(k - 100_000)).alias("query"), F.when(k % 2 == 0, 1).alias("rank"),
    )
    row = entities.build_candidates(records, "rid").select("n", F.transform("sources", lambda s: s["query"]).alias("asked")).first()
    assert row.n == 200_000 and row.asked == list(range(100_001))


def test_terms_of_a_document_are_summed_before_they_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "fox hunts"), (3, None), (4, "blue")], "d int, t string")
    queries = spark.createDataFrame([(7, "red red fox"), (8, "fox"), (9, "none here")], "q int, t string")
    found = retrieval.bm25(docs, queries, "d", "t", "q", "t")
    assert sorted((r.q, r.d) for r in found.collect()) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_replays_of_many_keys_need_no_task_a_key(spark):
    rows = spark.range(600_000).select((F.col("id") % 200_000).alias("task"), F.col("id").alias("event_id"), F.col("id").alias("at"), F.when(F.col("id") >= 400_000, "complete").otherwise("claim").alias("action"))
    got = {r.outcome: r.n for r in state.lease_replay(rows, "task", ["at", "event_id"], 100_000_000).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {"claimed": 200_000, "refused": 200_000, "completed": 200_000}
    assert "FlatMapGroupsInPandas" not in state.lease_replay(rows, "task", ["at", "event_id"], 1)._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([("a", 1, "claim", None), ("a", 2, "claim", 5), (None, 3, "claim", 1), (None, 4, "claim", 9), (None, 5, "complete", 9)], "task string, event_id int, action string, at long")
    assert sorted((r.event_id, r.outcome) for r in state.lease_replay(odd, "task", ["at", "event_id"], 3).collect()) == [(1, "refused"), (2, "claimed"), (3, "claimed"), (4, "reclaimed"), (5, "completed")]
    held = spark.createDataFrame([("u", 1, 1, "reserve", 5.0, 8.0), ("u", 2, 2, "reserve", 5.0, 8.0), ("u", 3, 1, "release", 0.0, 8.0), ("v", 4, 1, "reserve", None, 1.0)], "u string, k int, operation int, kind string, required double, balance double")
    assert sorted(map(tuple, state.reservations(held, "u", ["k"]).collect())) == [("u", 1, "reserved", 3.0), ("u", 2, "blocked", 3.0), ("u", 3, "released", 8.0), ("v", 4, "reserved", None)]


def test_chapter_matrix_reads_its_decisions_once(spark):
    rows = spark.createDataFrame([(1, 0, 0.4, True), (1, 2, 0.4, False), (1, 3, 0.1, True), (2, 1, None, False)], "doc int, chapter int, probability double, useful boolean")
    wide = decisions.chapter_matrix(rows, "doc", "chapter", [0, 1, 2])
    assert sorted(map(tuple, wide.select("doc", "n_useful", "best_chapter", "chapter_0", "chapter_1", "chapter_2").collect())) == [(1, 2, 0, 0.4, 0.0, 0.4), (2, 0, 1, 0.0, 0.0, 0.0)]
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_of_all_pairs_without_a_join_of_rows(spark, tmp_path):
    """Copies, equal scores, halves and a zero vector; then vectors that cannot be multiplied."""
    vectors = "select i::bigint as vec_id, 0::int as label, [i % 7 - 3, (i // 7) % 5, case when i % 3 = 0 then 0.3 else i % 11 end, 1]::float[] as embedding from range(1, 1501) t(i)"
    same_as_sql(spark, tmp_path, "cosine_topk", embeddings=vectors)
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "embedding")
    more = spark.sql("select * from values (2000L, array(0f, 0f, 0f, 0f)), (2001L, null), (2002L, array(1f, 2f)), (2100L, array(1f, null, 2f, 3f)), (null, array(1f, 1f, 1f, 1f)), (2003L, array(float('nan'), 1f, 1f, 1f)) as t(vec_id, embedding)")
    rows = rows.union(more)
    asked = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = joins.against_all(rows, asked.withColumnRenamed("embedding", "asked"), "query_id").select("query_id", "vec_id", F.round(vectors_cosine(F.col("asked"), F.col("embedding")), 6).alias("score"))
    expected = retrieval.ranked(pairs, ["query_id"], "score", ["vec_id"], 10)
    for block in (8192, 5):
        found = retrieval.cosine_best(rows, asked, "vec_id", "query_id", "embedding", 10, block)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(found.columns).collect()))
    plain = registry.QUERIES["cosine_topk"](spark, str(tmp_path))
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString()


def test_partitions_by_number_of_rows(spark, tmp_path):
    """More rows mean more partitions, not larger ones, and a decision's features need no other shuffle."""
    rows = spark.range(20_000).withColumn("k", F.col("id") % 5000)
    assert workspace.dealt(rows, "k", each=1000).rdd.getNumPartitions() == 20
    assert workspace.dealt(rows, "k").rdd.getNumPartitions() == 4
    lines = "select i::bigint as l_orderkey, i % 7 as l_suppkey, i % 5 as l_linenumber, i % 11 as l_partkey, (i % 50)::double as l_quantity, 0.05 as l_discount, 'A' as l_returnflag, i::double as l_extendedprice from range(500) t(i)"
    same_as_sql(spark, tmp_path, "doc_decision", lineitem=lines)
    for name in ("doc_decision", "doc_rescue"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan


def test_a_block_is_read_once_for_all_its_variants(spark):
    """The text was normalised again at each place that names it: some hundred times a block, in code too large to compile."""
    said = F.concat("said", F.lit(" once")).alias("said")
    df = spark.createDataFrame([("1 First Title: more. And the rest\nSecond line",), ("",), (None,)], "said string").withColumn("v", headings.variants(said))
    assert [len(r.v) for r in df.collect()] == [7, 1, 0]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(" once") == 1
    looks = df.select(headings.looks_like_heading(said).alias("ok"))
    assert looks._jdf.queryExecution().optimizedPlan().toString().count(" once") == 1


def test_an_evidence_is_not_normalised_for_each_use(spark):
    """Seven: as it is, and twice to see whether it is plain ASCII; blanks of any kind count as one, at the ends as none."""
    rows = [("\u2003 Some\u00a0 fine\twords, here –\u2028 (now) \n", "some fine words here"), ("´a b", "a b"), ("\u00a0", "x")]
    text = F.concat("e", F.lit(" once"))
    df = spark.createDataFrame(rows, "e string, a string").withColumn("v", anchors.validate_anchor(F.col("a"), text, 1, 6))
    assert [(r.v.reason, r.v.text, r.v.start) for r in df.collect()] == [("snapped", "Some fine words, here", 0), ("snapped", "´a b", 0), ("not_found_in_evidence", "x", None)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(" once") <= 7


def test_words_of_a_section_do_not_carry_all_of_its_text(spark):
    sections = spark.createDataFrame([(1, 0, "Red fox", "a red fox. a red foxes"), (1, 1, None, "fox red"), (2, 0, "x", "the big red fox")], "d int, s int, title string, text string")
    terms = spark.createDataFrame([("red fox",), ("Fox",), ("big red fox",), ("fox red fox",), (".",)], "term string")
    found = bridges.term_support(terms, sections, "d", "s")
    assert sorted((r.term, r.section_hits, r.doc_hits, r.title_hits, r.text_hits, r.example_titles) for r in found.collect()) == [("Fox", 3, 2, 1, 3, ["Red fox", "x"]), ("big red fox", 1, 1, 0, 1, ["x"]), ("red fox", 2, 2, 1, 2, ["Red fox", "x"])]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # the texts were read for counts and for examples


def test_a_query_is_made_a_tree_once(spark):
    """Its tree was made again at each of its nodes."""
    text = F.concat("q", F.lit(" once"))
    rows = [('a NOT (b or "c d") e NOT f',), ("NOT",), (None,), ("NOT ((x) y",)]
    df = spark.createDataFrame(rows, "q string").select(querying.excluded_terms(querying.tree(text)).alias("out"))
    assert [r.out for r in df.collect()] == [["b", "c d", "f"], ["once"], [], ["x", "y", "once"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(" once") == 1
