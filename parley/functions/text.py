"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def normal_name(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one underscore."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def slug(c: Column) -> Column:
    """As ``normal_name`` with dashes; 'study' when nothing is left."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    dashed = F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("study"))


def has_text(text: Column, needle: str | Column) -> Column:
    """Case-insensitive containment, false on null."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.contains(F.lower(text), F.lower(needle)), F.lit(False))


def matches(text: Column, pattern: str | None) -> Column:
    """Case-insensitive regex search; no pattern matches nothing.

    Letters, digits and word boundaries are those of Unicode, not of ASCII.
    """
    if not pattern:
        return F.lit(False)
    return F.coalesce(text.rlike("(?iU)" + pattern), F.lit(False))


def filled(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(c, F.lit(""))
