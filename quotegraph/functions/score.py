"""Scores, buckets, the display filter and reranking, as Column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quotegraph.functions.text import S, W, bind, full_match, strip

# Patterns of the quality score.
WIKI_JUNK = rf"(?iu)\{{\{{|\[\[|<ref|</ref|\|{S}*{W}|\bFile:|\bImage:|=={S}*{W}|&[a-z]+;|&#\p{{Nd}}+;|\bCategory:"
METADATA_LEAK = rf"(?iu)(?:p\.{S}*\p{{Nd}}+|pp\.{S}*\p{{Nd}}+|\[citation needed\]|\[[0-9]+\]|Read more|Continue reading)"
ODD_FORMATTING = rf"[.\-_]{{5,}}|^{S}*\*|(?:(?:^|{S})[a-z]){{5,}}"
# Texts that search results leave out; a dot doesn't match a line's end.
HIDDEN = (r".*\(\d{4}\).*", r".*p\. \d+.*", ".*https?://.*", ".*ASIN:.*", ".*published in.*")
SHOWN_BUCKETS = ("high_quality", "review")
# Names that reranking prefers.
FAMOUS_AUTHORS = (
    "william shakespeare", "shakespeare", "hamlet", "macbeth", "romeo and juliet", "albert einstein", "einstein", "mark twain", "oscar wilde",
    "aristotle", "plato", "socrates", "confucius", "martin luther king", "nelson mandela", "mahatma gandhi", "winston churchill",
    "abraham lincoln", "benjamin franklin",
)
FAMOUS_WORKS = ("hamlet", "macbeth", "romeo and juliet", "othello", "king lear", "the prophet", "the bible", "the quran", "the odyssey", "the iliad")


def scored_text(text: Column, before_cleaning: Column) -> Column:
    """The text, or the one before cleaning where it is null or empty."""
    return F.coalesce(F.when(text != "", text), before_cleaning, F.lit(""))


def quality_score(text: Column, has_person: Column, has_work: Column, has_source: Column, is_canonical: Column, needs_review: Column) -> Column:
    """``struct(score, bucket, high_quality, reasons)``. Only is_canonical = false counts as a duplicate."""
    seen = F.coalesce(text, F.lit(""))
    found = F.struct(F.length(strip(seen)).alias("n"), (seen.rlike(METADATA_LEAK) | seen.rlike(WIKI_JUNK)).alias("leak"), seen.rlike(ODD_FORMATTING).alias("odd"))

    def signals(x: Column) -> Column:
        n, leak = x["n"], x["leak"]
        table = [
            (has_person, 2, "has_person"),
            (has_work, 2, "has_work"),
            (has_source, 1, "has_source"),
            (n.between(30, 300), 1, "good_length"),
            (~leak, 1, "clean_text"),
            (is_canonical.eqNullSafe(F.lit(False)), -3, "duplicate"),
            (leak, -2, "metadata_leak"),
            (n < 30, -2, "too_short"),
            (n > 600, -2, "too_long"),
            (needs_review, -3, "needs_review"),
            (x["odd"], -1, "suspicious_formatting"),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(fires, F.lit(False)), F.struct(F.lit(points).alias("points"), F.lit(f"{points:+d}:{name}").alias("reason"))) for fires, points, name in table]))

    def named(fired: Column) -> Column:
        total = F.aggregate(fired, F.lit(0), lambda sum_, x: sum_ + x["points"])
        reasons = F.transform(fired, lambda x: x["reason"])
        return bind(total, lambda score: F.struct(score.cast("int").alias("score"), bucket(score).alias("bucket"), (bucket(score) == "high_quality").alias("high_quality"), reasons.alias("reasons")))

    return bind(bind(found, signals), named)


def bucket(score: Column) -> Column:
    return F.when(score >= 5, "high_quality").when(score >= 3, "review").when(score >= 1, "low_quality").otherwise("garbage")


def display_filter(text: Column, bucket: Column, is_canonical: Column) -> Column:
    """Whether a quote may be shown."""
    shown = bucket.isin(*SHOWN_BUCKETS) & F.coalesce(is_canonical, F.lit(True)) & (F.length(text) >= 40)
    for pattern in HIDDEN:
        shown = shown & ~full_match(text, pattern)
    return shown & ~text.startswith("http") & ~text.contains("&c.")


def rerank_score(query: Column, quote: Column, author: Column, work: Column, base: Column) -> Column:
    """The weighted score of a search result: relevance, length, author, work and coverage, times a bonus for a prefix."""
    q, d = F.lower(query), F.lower(quote)
    n = F.length(quote)
    length = F.when(n < 100, 1.5).when(n < 200, 1.2).when(n < 300, 1.0).otherwise(0.7)
    a, w = F.lower(F.coalesce(author, F.lit(""))), F.lower(F.coalesce(work, F.lit("")))
    famous = F.lit(False)
    for name in FAMOUS_AUTHORS:
        famous = famous | a.contains(name)
    for name in FAMOUS_WORKS:
        famous = famous | w.contains(name)
    known = (F.coalesce(author, F.lit("")) != "Unknown") & (F.length(F.coalesce(author, F.lit(""))) > 2)
    by_author = F.when(famous, 4.0).when(known, 1.3).otherwise(0.8)
    by_work = F.when((F.coalesce(work, F.lit("")) != "") & (work != "Unknown"), 1.2).otherwise(1.0)
    prefix = F.when(d.startswith(q), 1.2).when(F.substring(d, 1, 50).contains(q), 1.1).otherwise(1.0)
    words = lambda c: F.array_distinct(F.filter(F.split(c, rf"{S}+"), lambda x: x != ""))
    asked, has = words(q), words(d)
    coverage = F.when((F.size(asked) > 0) & (F.size(has) > 0), 1.0 + 0.5 * F.size(F.array_intersect(asked, has)) / F.greatest(F.size(asked), F.lit(1))).otherwise(1.0)
    return (base * 0.2 + length * 0.1 + by_author * 0.5 + by_work * 0.1 + coverage * 0.1) * prefix


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; it isn't symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_reaches(threshold: float):
    """A function of two texts: whether :func:`sequence_ratio` reaches ``threshold``; its upper bounds are tried first."""

    @F.pandas_udf("boolean")
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        found = (difflib.SequenceMatcher(None, x or "", y or "") for x, y in zip(a, b))
        return pd.Series([m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold for m in found], dtype="bool")

    return reaches


def match_rank(query: Column, quote: Column, score: Column) -> Column:
    """The alternative rank: search score, length ratio, common prefix and sequence ratio."""
    q, d = F.lower(query), F.lower(quote)
    short, long = F.least(F.length(q), F.length(d)), F.greatest(F.length(q), F.length(d))
    ratio = F.when(long > 0, short / F.greatest(long, F.lit(1))).otherwise(0.0)
    steps = F.when(short > 0, F.sequence(F.lit(1), F.greatest(short, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    common = F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i - 1) & (q.substr(i, F.lit(1)) == d.substr(i, F.lit(1))), i).otherwise(n))
    prefix = F.when(F.length(q) > 0, common / F.greatest(F.length(q), F.lit(1))).otherwise(0.0)
    return score * 0.5 + ratio * 0.2 + prefix * 0.15 + sequence_ratio(q, d) * 0.15


def relative_percent(score: Column, top: Column) -> Column:
    """A score as a whole percent of the top one, halves to even."""
    return F.when(top > 0, F.bround(score / top * 100, 0).cast("int")).otherwise(0)


# What a pair of similar quotes is recommended as.
LIKELY, SUSPICIOUS, VARIANT = "LIKELY_DUPLICATE — review and delete shorter", "SUSPICIOUS — compare carefully", "POSSIBLE_VARIANT — may keep both"


def recommendation(similarity: Column, text_a: Column, text_b: Column) -> Column:
    ratio = F.least(F.length(text_a), F.length(text_b)) / F.greatest(F.length(text_a), F.length(text_b), F.lit(1))
    return F.when((similarity >= 0.98) & (ratio >= 0.90), LIKELY).when(similarity >= 0.95, SUSPICIOUS).otherwise(VARIANT)
