"""Quality of a run: expectations as data, all evaluated in one pass, and the assessment of structured documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """What should hold of each row (``holds``, null counts as not), and what it means if rows break it: FAIL or WARN."""

    check: str
    holds: Column
    severity: str
    expected: str


def _broken(e: Expectation) -> Column:
    return F.count_if(~F.coalesce(e.holds, F.lit(False)))


def observed(rows: DataFrame, expectations: list[Expectation], name: str = "quality") -> tuple[DataFrame, Observation]:
    """``rows`` unchanged, and an observation that has the broken rows of each check (and ``rows``) after any action on them: no job of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[_broken(e).alias(e.check) for e in expectations]), seen


def verdict_of(metrics: dict, expectations: list[Expectation]) -> str:
    """failed, success_with_warnings or success, from an observation's numbers."""
    severities = {e.severity for e in expectations if metrics[e.check]}
    return "failed" if "FAIL" in severities or not metrics["rows"] else "success_with_warnings" if severities else "success"


def expectation_rows(rows: DataFrame, key: str, expectations: list[Expectation], examples: int = 5) -> DataFrame:
    """(check, status, broken, expected, examples) of every expectation, from one scan of ``rows``; examples are the least keys that break it.

    Each task keeps its least keys of a check only.
    """
    checks = F.array(*[F.struct(F.lit(e.check).alias("check"), F.coalesce(e.holds, F.lit(False)).alias("ok")) for e in expectations])
    each = rows.select(F.col(key).alias("key"), F.explode(checks).alias("c")).select("key", "c.check", "c.ok")
    counted = each.groupBy("check").agg(F.count_if(~F.col("ok")).alias("broken"))
    worst = each.filter("not ok").select("check", "key").distinct()
    place = F.row_number().over(Window.partitionBy("check").orderBy("key"))
    shown = worst.withColumn("n", place).filter(F.col("n") <= examples).groupBy("check").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "key"))), lambda x: x.key.cast("string")), ", ").alias("examples"))
    known = rows.sparkSession.createDataFrame([(i, e.check, e.severity, e.expected) for i, e in enumerate(expectations)], "place int, check string, severity string, expected string")
    joined = known.join(counted, "check", "left").join(shown, "check", "left")
    broken = F.coalesce("broken", F.lit(0))
    return joined.select("place", "check", F.when(broken == 0, "OK").otherwise(F.col("severity")).alias("status"), broken.alias("broken"), "expected", F.coalesce("examples", F.lit("none")).alias("examples"))


def document_expectations(least_coverage: float = 60.0, long_pages: int = 20) -> list[Expectation]:
    """What a structured document should be: columns sections, passages, coverage, page_count, section_count, tiny_count, fallback_count, has_references, orphans."""
    c = F.col
    return [
        Expectation("sections_produced", c("sections") > 0, "FAIL", "a section for every document"),
        Expectation("passages_produced", c("passages") > 0, "FAIL", "a passage for every document"),
        Expectation("orphan_passages", c("orphans") == 0, "FAIL", "every passage in a section"),
        Expectation("coverage", c("coverage") >= least_coverage, "WARN", f">= {least_coverage:g} % of the text in sections"),
        Expectation("single_section", ~((c("section_count") <= 1) & (c("page_count") >= 10)), "WARN", "several sections on ten pages or more"),
        Expectation("references", ~((c("page_count") >= long_pages) & ~c("has_references")), "WARN", "references in long documents"),
        Expectation("fallback_anchors", c("fallback_count") == 0, "WARN", "headings found in the text"),
        Expectation("tiny_sections", ~((c("page_count") >= 20) & (c("section_count") > 0) & (c("tiny_count") / F.greatest(c("section_count"), F.lit(1)) >= 0.25)), "WARN", "< 25 % tiny sections on 20 pages or more"),
    ]


def structured_documents(summary: DataFrame, sections: DataFrame, passages: DataFrame, doc: str = "doc_id", section: str = "section_id") -> DataFrame:
    """``summary`` with sections, passages and orphans (passages whose section does not exist) of each document; counts are pre-combined."""
    produced = sections.groupBy(doc).agg(F.count("*").alias("sections"))
    ids = sections.select(F.col(section).alias("_known")).distinct()
    placed = passages.join(ids, passages[section] == ids["_known"], "left")
    split = placed.groupBy(doc).agg(F.count("*").alias("passages"), F.count_if(F.col("_known").isNull()).alias("orphans"))
    joined = summary.join(produced, doc, "left").join(split, doc, "left")
    return joined.fillna(0, ["sections", "passages", "orphans"])


def assessment(checks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: status, quality_band, can_continue, failures, warnings and documents, from expectation rows."""
    n = documents.agg(F.count("*").alias("documents"))
    sums = checks.agg(F.coalesce(F.sum(F.when(F.col("status") == "FAIL", F.col("broken"))), F.lit(0)).alias("failures"), F.coalesce(F.sum(F.when(F.col("status") == "WARN", F.col("broken"))), F.lit(0)).alias("warnings"))
    both = sums.crossJoin(n)  # one row each
    failed, warned = (F.col("failures") > 0) | (F.col("documents") == 0), F.col("warnings") > 0
    return both.select(
        F.when(failed, "failed").when(warned, "success_with_warnings").otherwise("success").alias("status"),
        F.when(failed, "insufficient").when(warned, "acceptable_with_issues").otherwise("high").alias("quality_band"),
        (~failed).alias("can_continue"),
        "failures",
        "warnings",
        "documents",
    )
