"""Training data from ``documents``: language, repeated lines, near duplicates, benchmark leaks, token ids.

Every stage takes any table with the columns of documents; others stay until the last one. Null and
empty texts have no language and go first. Repeated rows, which have the same id and text, are one document: they come out
of the near duplicates once. Null ids count as one id. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import langid
from rankloom.llm.bpe import bpe_encode
from rankloom.llm.decontaminate import contaminated
from rankloom.llm.linededup import dedup_lines
from rankloom.llm.neardup import near_duplicates
from rankloom.operators.workspace import Workspace

#: Texts whose most probable language is less probable than this are rejected.
LEAST_CONFIDENCE = 0.5
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose language is doubtful."""
    found = langid.identify(docs)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_CONFIDENCE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document of which nothing is left goes."""
    found = dedup_lines(docs).filter((F.size("removed") == 0) | (F.col("text") != ""))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id; of rows with the same id and text one."""
    others = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    left = docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
    again = Workspace(spark, "pipeline-near").save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return left
    repeated = left.join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left_anti").union(repeated)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to."""
    coded = bpe_encode(docs, public_tokenizers.path(TOKENIZER), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("leaks", leaks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each on the table that the one before wrote."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Naive Bayes, token ids and connected components are not SQL; tests compare with brute force.
ORACLE_SQL = None
