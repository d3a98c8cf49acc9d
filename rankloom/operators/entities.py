"""Records of the same work: keys, merge rules, and clusters as a one-by-one merge builds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_author_lastname, normalize_arxiv, normalize_doi, normalize_title
from .workspace import Workspace


def candidate_keys(doi: Column, arxiv: Column, pmid: Column, title: Column, year: Column, authors: Column) -> Column:
    """Keys of a record, the surest first; a fallback of title, year and first author where the title is not blank."""
    named = F.nullif(normalize_title(title), F.lit(""))
    fallback = F.when(named.isNotNull(), F.concat_ws("|", F.concat(F.lit("fallback:"), named), F.coalesce(year.cast("string"), F.lit("")), first_author_lastname(F.coalesce(authors, F.array().cast("array<string>")))))
    prefixed = [F.concat(F.lit(p), k) for p, k in (("doi:", normalize_doi(doi)), ("arxiv:", normalize_arxiv(arxiv)), ("pmid:", F.nullif(F.regexp_extract(pmid, "[0-9]+", 0), F.lit(""))))]
    return F.array_compact(F.array(*prefixed, fallback))


def merged_fields(order: str) -> list[Column]:
    """Aggregates that merge a cluster's records: the longest text (the first of equals by ``order``), the longest list, the least
    year, the largest counts; a flag is true if any says so, null if none says anything."""
    longest = lambda c: F.max_by(c, F.struct(F.length(c).alias("n"), (-F.col(order)).alias("o")))
    return [
        F.min(order).alias("first"),
        F.count("*").alias("n"),
        longest("title").alias("title"),
        F.max_by("authors", F.struct(F.size("authors").alias("n"), (-F.col(order)).alias("o"))).alias("authors"),
        F.min("year").alias("year"),
        F.max("citations").alias("citations"),
        F.bool_or("is_core").alias("is_core"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
    ]


def final_id(doi: Column, arxiv: Column, pmid: Column, content: Column) -> Column:
    return F.coalesce(doi, F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("cand_"), content))


def merge_online(records: DataFrame, order: str, keys: str) -> DataFrame:
    """(order, cluster): the cluster, named by its first record, that each record joins when they come one by one.

    A record joins the cluster that its first known key belongs to, and then all its keys that are
    new belong to that cluster; clusters that a later record bridges stay apart.  So a key belongs to
    the cluster of the first record that has it, and each record follows one earlier record: the first
    one with its first key that any earlier record has.  Those steps are followed to their ends, twice
    as far in every round; no group of records meets in one task.

    ``order`` is unique.  Null keys are none; records without keys are clusters of their own.
    """
    ws = Workspace(records.sparkSession, "entities")
    ids = records.select(F.col(order).alias("id"))
    pairs = ws.save(records.select(F.col(order).alias("id"), F.posexplode(keys).alias("at", "key")).filter("key is not null"))
    first = ws.save(pairs.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"))
    steps = ws.save(pairs.join(first, "key").filter("first < id").groupBy("id").agg(F.min_by("first", "at").alias("cluster")))
    ws.drop(pairs, first)
    while True:
        beyond = steps.select(F.col("id").alias("cluster"), F.col("cluster").alias("beyond"))
        further = ws.save(steps.join(beyond, "cluster", "left").select("id", F.coalesce("beyond", "cluster").alias("cluster"), F.col("beyond").isNotNull().alias("moved")))
        ws.drop(steps)
        steps = further
        if steps.filter("moved").isEmpty():
            return ids.join(steps, "id", "left").select(F.col("id").alias(order), F.coalesce("cluster", "id").alias("cluster"))


def provider_ids(provider: str, own: str) -> Column:
    """Aggregate: the ids that each provider has given, each once."""
    pairs = F.collect_set(F.struct(F.col(provider).alias("provider"), F.col(own).cast("string").alias("id")))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p.provider)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_sort(F.transform(F.filter(pairs, lambda p: p.provider == n), lambda p: p.id))))


def build_candidates(records: DataFrame, order: str) -> DataFrame:
    """Candidates from records: keys, one-by-one merging, merged fields, provider ids, sources and final ids.

    records: ``order``, doi, arxiv, pmid, title, year, authors, citations, is_core, provider, query_hash, query, rank.
    sources holds (provider, query_hash, query, rank) of all records in order, each once.  Records without any key are candidates of their own.
    collisions tells how many candidates share the final id.
    """
    keyed = records.withColumn("keys", candidate_keys(F.col("doi"), F.col("arxiv"), F.col("pmid"), F.col("title"), F.col("year"), F.col("authors")))
    placed = keyed.join(merge_online(keyed.select(order, "keys"), order, "keys"), order)
    source = ["provider", "query_hash", "query", "rank"]
    once = placed.groupBy("cluster", *source).agg(F.min(order).alias("at")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*source).alias("source")))).alias("sources"))
    merged = placed.groupBy("cluster").agg(*merged_fields(order), F.min("doi").alias("doi"), F.min("arxiv").alias("arxiv"), F.min("pmid").alias("pmid"), provider_ids("provider", order).alias("provider_ids"))
    merged = merged.join(once, "cluster").withColumn("sources", F.transform("sources", lambda s: s.source))
    named = merged.withColumn("candidate", final_id(normalize_doi(F.col("doi")), normalize_arxiv(F.col("arxiv")), F.col("pmid"), F.substring(F.sha2(F.concat_ws("|", normalize_title(F.col("title")), F.col("year").cast("string")), 256), 1, 16)))
    same = named.groupBy("candidate").agg(F.count("*").alias("collisions"))
    return named.join(same, "candidate").drop("cluster")


def merge_metrics(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(records, candidates, merged, colliding, core): what build_candidates did, in one row."""
    made = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("n") > 1).alias("merged"), F.count_if(F.col("collisions") > 1).alias("colliding"), F.count_if(F.coalesce("is_core", F.lit(False))).alias("core"))
    return records.agg(F.count("*").alias("records")).join(F.broadcast(made))
