"""Rule-based quality metrics of answers; each gives struct<name, score, passed>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, _c, diacritic_ratio

# Phrases of a refusal, and those that make a citation a phantom.
REFUSAL = ("không chứa thông tin", "không có thông tin", "tài liệu không", "not contain", "no relevant information")
PHANTOM = ("không chứa", "không có thông tin", "not contain", "no information")


def _metric(name: str, score: Column, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), score.cast("double").alias("score"), passed.cast("boolean").alias("passed"))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def word_count(c: C) -> Column:
    return F.size(F.filter(F.split(_c(c), r"(?U)\s+"), lambda w: w != ""))


def keyword_coverage(answer: C, keywords: C) -> Column:
    low = F.lower(_c(answer))
    found = F.size(F.filter(_c(keywords), lambda k: F.contains(low, F.lower(k))))
    score = F.when(F.size(_c(keywords)) > 0, found / F.size(_c(keywords))).otherwise(1.0)
    return _metric("keyword_coverage", score, score >= 0.5)


def missing_keywords(answer: C, keywords: C) -> Column:
    """The keywords that the answer lacks, whatever their case, in order; all of them for a null answer."""
    low = F.lower(F.coalesce(_c(answer), F.lit("")))
    return F.filter(_c(keywords), lambda k: ~F.contains(low, F.lower(k)))


def refusal_accuracy(answer: C, expected_refuse: C) -> Column:
    refuses, short = _any(F.lower(_c(answer)), REFUSAL), word_count(answer) < 20
    score = F.when(_c(expected_refuse), refuses.cast("double")).when(refuses & short, 0.0).when(refuses, 0.8).otherwise(1.0)
    return _metric("refusal_accuracy", score, score > 0)


def phantom_citations(answer: C) -> Column:
    a = _c(answer)
    cited = r"\[(?:IMG-)?\d+\]"
    full = _any(F.lower(a), PHANTOM) & (word_count(a) < 20) & a.rlike(cited)
    inside = F.exists(F.split(a, r"[.!?\n]"), lambda s: _any(F.lower(s), PHANTOM) & s.rlike(cited))
    score = F.when(full, 0.0).when(inside, 0.3).otherwise(1.0)
    return _metric("no_phantom_citations", score, score == 1)


def citation_format(answer: C) -> Column:
    good = ~_c(answer).rlike(r"\[\d+[,\s]+\d+\]")
    return _metric("citation_format", good.cast("int"), good)


def token_artifacts(answer: C) -> Column:
    good = ~_c(answer).rlike(r"<unused\d+>")
    return _metric("no_token_artifacts", good.cast("int"), good)


def language_match(answer: C, language: C) -> Column:
    good = F.coalesce((_c(language) != "vi") | (diacritic_ratio(answer) > 0.03), F.lit(True))
    return _metric("language_match", good.cast("int"), good)


def answer_completeness(answer: C, expected_refuse: C) -> Column:
    n = word_count(answer)
    score = F.when(_c(expected_refuse), 1.0).when(n < 10, 0.2).when(n < 30, 0.6).otherwise(1.0)
    return _metric("answer_completeness", score, score > 0.2)


def _cited(answer: C) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(_c(answer), F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("long"))))


def context_utilization(answer: C, n_sources: C, expected_refuse: C) -> Column:
    score = F.when(_c(expected_refuse) | (_c(n_sources) == 0), 1.0).otherwise(F.least(_cited(answer) / F.greatest(_c(n_sources), F.lit(1)), F.lit(1.0)))
    return _metric("context_utilization", score, score >= 0.2)


def answer_substance(answer: C) -> Column:
    return F.least(word_count(answer) / 10, F.lit(1.0))


def context_utilization_v2(answer: C, n_sources: C) -> Column:
    n = _cited(answer)
    return F.when(_c(n_sources) == 0, 1.0).when(n > 0, F.least(F.greatest(n / _c(n_sources), n / 3), F.lit(1.0))).otherwise(0.0)


def all_metrics(answer: C, keywords: C, expected_refuse: C, language: C, n_sources: C) -> Column:
    return F.array(
        keyword_coverage(answer, keywords), refusal_accuracy(answer, expected_refuse), phantom_citations(answer), citation_format(answer),
        token_artifacts(answer), language_match(answer, language), answer_completeness(answer, expected_refuse), context_utilization(answer, n_sources, expected_refuse),
    )


def overall_score(metrics: C) -> Column:
    return F.when(F.size(_c(metrics)) > 0, F.aggregate(_c(metrics), F.lit(0.0), lambda s, m: s + m["score"]) / F.size(_c(metrics))).otherwise(0.0)


def test_status(overall: C) -> Column:
    return F.when(_c(overall) >= 0.7, "PASS").when(_c(overall) >= 0.5, "PARTIAL").otherwise("FAIL")


def verdict(overall: C) -> Column:
    return F.when(_c(overall) >= 0.85, "EXCELLENT").when(_c(overall) >= 0.7, "GOOD").when(_c(overall) >= 0.5, "FAIR").otherwise("POOR")
