"""Tokens, bigrams and text shaping as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterflow import constants as C

# A run of ASCII letters and digits is one token; every other letter or digit is its own.
TOKEN_PATTERN = r"[a-z0-9]+|[\p{L}\p{Nd}]"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def is_blank(col: Column) -> Column:
    return ~F.coalesce(col.rlike(r"\S"), F.lit(False))


def tokenize(col: Column) -> Column:
    """Lower-cased tokens in text order; an empty array for null or blank text."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0)), _no_strings())


def counted(ordered: str) -> Column:
    """(feature, tf) of each distinct token in a column of sorted tokens: where it starts, and how far the next one is."""
    tokens = F.col(ordered)
    starts = F.array_compact(F.transform(tokens, lambda x, i: F.when(~x.eqNullSafe(F.get(tokens, i - 1)), i)))
    # In an array of one, so that the starts are found once and not for each of them.
    each = F.transform(F.array(starts), lambda at: F.transform(at, lambda p, i: F.struct(
        F.get(tokens, p).alias("feature"), (F.coalesce(F.get(at, i + 1), F.size(tokens)) - p).alias("tf"))))
    return F.get(each, F.lit(0))


def bigrams(col: Column) -> Column:
    """Distinct adjacent character pairs of the lower-cased text without white space.

    One zero-width look-ahead match per position keeps this linear in the text
    length (position-wise ``substring`` is quadratic on UTF-8 strings).
    """
    squeezed = F.regexp_replace(F.lower(col), r"\s+", "")
    pairs = F.array_distinct(F.regexp_extract_all(squeezed, F.lit("(?s)(?=(..))"), F.lit(1)))
    return F.when(F.length(col) >= 2, pairs).otherwise(_no_strings())


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two bigram arrays; 0 when either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def searchable_text(section: Column, content: Column) -> Column:
    return F.concat_ws(" ", F.nullif(section, F.lit("")), F.nullif(content, F.lit("")))


def snippet(content: Column) -> Column:
    """Masked start of a text: 18-digit runs and phone numbers are replaced before the cut."""
    masked = F.regexp_replace(F.regexp_replace(content, r"\d{18}", "[ID]"), r"1[3-9]\d{9}", "[PHONE]")
    cut = F.when(
        F.length(masked) > C.SNIPPET_MAX, F.concat(F.substring(masked, 1, C.SNIPPET_MAX), F.lit("..."))
    ).otherwise(masked)
    return F.coalesce(cut, F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """0 for empty text, else a quarter of its length but at least 1."""
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def normalise_question(text: Column) -> Column:
    """Lower-cased tokens joined by one blank: the key of the frequent-question report."""
    return F.array_join(tokenize(text), " ")


def message_is_valid(student_id: Column, message: Column) -> Column:
    return (
        ~is_blank(student_id) & ~is_blank(message)
        & F.length(message).between(1, C.MESSAGE_MAX_LENGTH)
    )
