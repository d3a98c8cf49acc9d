"""Scores of ranked evidence as column expressions.  Weights are parameters with the reference values as defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip01, doubles, total


def facet_match(scores: Column, weights: Column, threshold: float, top: int, blend: tuple[float, float, float] = (0.55, 0.25, 0.20)) -> Column:
    """struct(best, top_m, coverage, match) of facet scores under importance weights 1 to 5.

    best is the largest weighted score over 5, top_m the ``top`` largest over the sum of
    weights, coverage the weighted excess over ``threshold``.
    """
    s, w = doubles(scores), doubles(weights)
    weighted = F.zip_with(s, w, lambda x, y: x * y)
    mass = F.greatest(total(w), F.lit(1e-12))
    best = F.coalesce(F.array_max(weighted), F.lit(0.0)) / 5
    top_m = total(F.slice(F.sort_array(weighted, asc=False), 1, top)) / mass
    coverage = total(F.zip_with(s, w, lambda x, y: y * F.greatest(x - threshold, F.lit(0.0)))) / mass
    return F.struct(best.alias("best"), top_m.alias("top_m"), coverage.alias("coverage"), (blend[0] * best + blend[1] * top_m + blend[2] * coverage).alias("match"))


def evidence_density(sections: Column, lanes: Column, terms: Column) -> Column:
    return 0.45 * F.least(sections, F.lit(4)) / 4 + 0.30 * F.least(lanes, F.lit(5)) / 5 + 0.25 * F.least(terms, F.lit(3)) / 3


def support_score(density: Column, count: Column, best: Column, judge: Column) -> Column:
    return 0.38 * density + 0.32 * F.least(count / 4, F.lit(1.0)) + 0.22 * best + F.coalesce(0.08 * judge, F.lit(0.0))


def judge_composite(usefulness: Column, match: Column, confidence: Column, violations: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.5 * usefulness / 5 + 0.35 * match / 5 + 0.15 * confidence / 5 - F.least(F.lit(0.45), 0.08 * violations))


def section_probability(rerank: Column, cross: Column, support: Column, count: Column, coverage: Column, judge: Column, penalty: Column) -> Column:
    raw = 0.52 * rerank + 0.18 * cross + 0.10 * support + 0.08 * F.least(count / 4, F.lit(1.0)) + 0.07 * coverage + 0.05 * F.coalesce(judge, F.lit(0.0))
    return F.round(clip01(raw - penalty), 8)


def band(score: Column) -> Column:
    """Label of a score from 0 to 100."""
    return F.when(score >= 85, "very_high").when(score >= 70, "high").when(score >= 55, "medium").when(score >= 40, "low").otherwise("very_low")


def support_label(x: Column) -> Column:
    return F.when(x >= 0.78, "strong").when(x >= 0.55, "partial").otherwise("weak")


def anchor_score(explicit: Column, phrase: Column, title: Column, body: Column) -> Column:
    return 3.0 * explicit + 1.6 * phrase + 1.15 * title + 0.55 * body


def cross_blend(best: Column, mean: Column, overall: Column) -> Column:
    return 0.62 * overall + 0.28 * best + 0.10 * mean


def blend(first: Column, second: Column, weight: float) -> Column:
    return weight * first + (1 - weight) * second
