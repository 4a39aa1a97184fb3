"""Number and flag parsing, rounding and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxline.functions.text import WHITESPACE, col, strip

# Accepted spellings of yes and no.
TRUE_WORDS = ("true", "t", "yes", "y", "1", "opt in", "opt-in", "subscribed")
FALSE_WORDS = ("false", "f", "no", "n", "0", "opt out", "opt-out", "unsubscribed")

# A whole number text in its white space. Spark's own cast also takes Java suffixes such as "1d", hence the pattern.
_NUMERIC = rf"^[{WHITESPACE}]*+([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[{WHITESPACE}]*+\z"


def _to_double(text: Column) -> Column:
    """The number that a text is, without looking at the text twice; texts that are none, null words among them, give null."""
    return F.regexp_extract(text, _NUMERIC, 1).try_cast("double")


def parse_number(c: Column | str, default: float | None = 0.0) -> Column:
    """Currency, quantity or percentage text to double; ``(x)`` is negative."""
    value = _to_double(F.translate(col(c).cast("string"), "($,%)", "-"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def parse_bool(c: Column | str, default: bool = False) -> Column:
    text = F.lower(strip(c))
    return (
        F.when(text.isin(*TRUE_WORDS), F.lit(True))
        .when(text.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(default))
    )


def parse_target(c: Column | str) -> Column:
    """Target typed by a planner; null when it is blank or not a number."""
    return _to_double(F.translate(col(c).cast("string"), ",$", ""))


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def round_hundreds(c: Column | str) -> Column:
    """Half-even rounding to the nearest hundred."""
    return F.bround(col(c).cast("double"), -2)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value, keeping null as null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def safe_ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is above zero."""
    ratio = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, ratio).otherwise(F.lit(default).cast("double"))


def safe_index(actual: Column, expected: Column) -> Column:
    """Actual over expected; any sale against no expectation scores 1.25."""
    return (
        F.when(expected > 0, actual.cast("double") / expected.cast("double"))
        .when(actual > 0, F.lit(1.25))
        .otherwise(F.lit(0.0))
    )


def display_index(actual: Column, expected: Column) -> Column:
    return F.coalesce(safe_ratio(F.coalesce(actual, F.lit(0.0)), expected), F.lit(0.0))
