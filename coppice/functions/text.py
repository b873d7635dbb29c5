"""Scalar and array expressions over text, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become terms or keywords (English, ticket words, German, French, Italian).
STOPWORDS = (
    "a an and are as at be by for from has in is it of on or that the to was were with without not no can cannot "
    "user users ticket incident issue problem error "
    "der die das den dem ein eine und oder ist im mit nicht auf zu von "
    "pour avec sans dans des les une est pas sur "
    "per con senza non gli del della che"
).split()

SPACE = r"\p{IsWhite_Space}"
LEAST_TOKEN_BYTES = 2
GRAM_CHARS = 4
GRAM_PREFIX = "char:"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends; a missing cell is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def null_if_blank(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case; runs of other than letters and digits are one space; no space at the ends.

    Characters are lowered one by one, so a capital sigma never becomes a final one.
    """
    lowered = F.lower(F.translate(c, "Σ", "σ"))
    return F.trim(F.regexp_replace(lowered, r"[^\p{IsAlphabetic}\p{N}]+", " "))


def tokens(normalized: Column) -> Column:
    """Words of two bytes or more that aren't stopwords, in order, repeats kept."""
    # a long IN list becomes a hash set in the plan
    return F.filter(
        F.split(normalized, " "),
        lambda t: (F.octet_length(t) >= LEAST_TOKEN_BYTES) & ~t.isin(STOPWORDS),
    )


def bigrams(words: Column) -> Column:
    """Neighbours among the words that are left, joined by a space."""
    n = F.size(words)
    left, right = F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))


def char_ngrams(words: Column) -> Column:
    """Windows of four characters of words longer than that, marked as such."""
    long = F.filter(words, lambda t: F.length(t) > GRAM_CHARS)
    return F.flatten(
        F.transform(
            long,
            lambda t: F.transform(
                F.sequence(F.lit(1), F.length(t) - (GRAM_CHARS - 1)),
                lambda i: F.concat(F.lit(GRAM_PREFIX), F.substring(t, i, F.lit(GRAM_CHARS))),
            ),
        )
    )


def feature_terms(text: Column) -> Column:
    """All terms of a text: words, pairs of words, character windows; repeats kept."""
    words = tokens(normalize_text(text))
    return F.concat(words, bigrams(words), char_ngrams(words))


def sentence_case(c: Column) -> Column:
    """Upper-case first character, the rest as it is."""
    whole = F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    return F.when(F.length(c) == 0, F.lit("Similar incidents")).otherwise(whole)


def cluster_code(cluster_id: Column) -> Column:
    return F.when(cluster_id == 0, F.lit("Unclustered")).otherwise(F.format_string("C%04d", cluster_id))


def contains_ignoring_case(value: Column, term: str | Column) -> Column:
    return F.contains(F.lower(value), F.lower(F.lit(term) if isinstance(term, str) else term))


def blank_display(value: Column) -> Column:
    return F.when(value == "", F.lit("(blank)")).otherwise(value)


def parse_date(c: Column) -> Column:
    """The first of year-month-day, day.month.year, day/month/year and month/day/year that fits the whole cell."""
    patterns = ("y-M-d", "d.M.y", "d/M/y", "M/d/y")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(p))) for p in patterns])


def duration_text(seconds: Column) -> Column:
    """``format_duration`` of a column of seconds."""
    millis = F.floor(seconds * 1000)
    whole, rest = F.floor(millis / 1000), F.pmod(millis, F.lit(1000))
    minutes = F.format_string("%dm %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
    return F.when(whole >= 60, minutes).when(whole > 0, F.format_string("%d.%03ds", whole, rest)).otherwise(F.format_string("%dms", rest))


def format_duration(seconds: float) -> str:
    """``Xm SSs``, ``S.mmms``-style seconds, or milliseconds."""
    millis = int(seconds * 1000)
    whole, millis = divmod(millis, 1000)
    if whole >= 60:
        return f"{whole // 60}m {whole % 60:02d}s"
    return f"{whole}.{millis:03d}s" if whole else f"{millis}ms"
