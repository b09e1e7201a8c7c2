"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def lines(text: Column) -> Column:
    """The text split at line feeds; a trailing empty line is kept, a null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def split_lines(text: Column) -> Column:
    """The lines as Python's splitlines cuts them: at every line boundary of Unicode, without a trailing empty line; a null has none."""
    x = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]", -1)
    return F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x)


def token_estimate(text: Column) -> Column:
    return F.floor(F.coalesce(F.char_length(text), F.lit(0)) / CHARS_PER_TOKEN).cast("long")


def word_tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")).cast("long")


def any_of(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def first_match(text: Column, patterns) -> Column:
    """The match of the first pattern, in the order given, that hits; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))
