"""Published numbers and missing-value markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The markers that stand for a missing value, in lower case.
MISSING_MARKERS = ("", "-", "na", "n.a.", "null")
# Fixed value: the written form of a number (ASCII digits only).
NUMBER = r"^[+-]?([0-9]+|[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)\z"


def trimmed(raw: Column) -> Column:
    """``raw`` without leading and trailing U+0020."""
    return F.trim(raw)


def is_missing(raw: Column) -> Column:
    """True for null and for a missing-value marker in any case."""
    return raw.isNull() | F.lower(F.trim(raw)).isin(*MISSING_MARKERS)


def is_number(raw: Column) -> Column:
    """True for a number in the published form; null for null."""
    return F.trim(raw).rlike(NUMBER)


def number(raw: Column) -> Column:
    """The value of a published number as double, null for anything else."""
    text = F.trim(raw)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def canonical(raw: Column) -> Column:
    """Text that is equal for equal values: numbers by value, else trimmed text.

    Works on the digits, so it is exact for numbers of any length.
    """
    text = F.trim(raw)
    negative = text.startswith("-")
    digits = F.regexp_replace(text, r"^[+-]", "")
    whole = F.regexp_replace(F.substring_index(digits, ".", 1), "^0+", "")
    part = F.when(digits.contains("."), F.regexp_replace(F.substring_index(digits, ".", -1), "0+$", "")).otherwise("")
    plain = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    signed = F.when(negative & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)
    return F.when(text.rlike(NUMBER), signed).otherwise(F.concat(F.lit("text:"), text))
