"""Text cleaning and tokens as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from patronage.functions.fixed_values import REDACTION_PATTERN, SPACE_PATTERN, URL_PATTERN
from patronage.functions.numeric import col

# The same matches as EMAIL_PATTERN, tried once per word instead of once per character.
EMAIL_WORD = r"(?<!\S)\S[^\s@]*@\S+"
# NON_LETTER_PATTERN to a space and SPACE_PATTERN to one space, in one pass.
NON_LETTERS = "[^a-z]+"


def _scrub(c: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """``patterns`` maps each to plain texts of which any match holds one: looking for these is far cheaper."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    for pattern, signs in patterns.items():
        found = reduce(Column.__or__, [F.contains(text, F.lit(sign)) for sign in signs])
        text = F.when(found, F.regexp_replace(text, pattern, " ")).otherwise(text)
    return F.trim(F.regexp_replace(text, NON_LETTERS, " "))


def clean_text(c: str | Column) -> Column:
    """Lower case letters and single spaces; addresses and everything else removed."""
    return _scrub(col(c), {URL_PATTERN: ["http", "www"], EMAIL_WORD: ["@"]})


def clean_redacted(c: str | Column) -> Column:
    """``clean_text`` that also drops runs of x (redactions) before other characters go."""
    return _scrub(col(c), {URL_PATTERN: ["http", "www"], EMAIL_WORD: ["@"], REDACTION_PATTERN: ["x"]})


def words(cleaned: str | Column) -> Column:
    """Words of cleaned text; empty text has none."""
    cleaned = col(cleaned)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def raw_words(c: str | Column) -> Column:
    """Lower-case words of raw text split at white space, punctuation kept."""
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")


def tokens(c: str | Column, min_length: int = 3) -> Column:
    """Redaction-free words of at least ``min_length`` letters."""
    return F.filter(F.split(clean_redacted(c), " "), lambda w: F.length(w) >= min_length)


def lexicon_score(tokens_: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Positive words minus negative words, in one walk over the words."""
    plus, minus = list(positive), list(negative)
    return F.aggregate(
        tokens_,
        F.lit(0),
        lambda total, w: total + w.isin(*plus).cast("int") - w.isin(*minus).cast("int"),
    )


def polarity(score: Column) -> Column:
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")


def ngrams_1_2(terms: Column) -> Column:
    """Unigrams and bigrams of a word array."""
    pairs = F.zip_with(
        F.slice(terms, 1, F.greatest(F.size(terms) - 1, F.lit(0))),
        F.slice(terms, 2, F.greatest(F.size(terms) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(terms, pairs)
