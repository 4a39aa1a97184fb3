"""Date parsing and calendar arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from boxline.functions.text import WHITESPACE, col, once, strip

DAY_MICROS = 86_400_000_000
_NUMERIC = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})(?![0-9])"
_SHORT_YEAR = r"^([0-9]{1,2}[/.-][0-9]{1,2}[/.-])([0-9]{2})(?![0-9])"
_OLD_YEAR = r"^([0-9]{1,2}[/.-][0-9]{1,2}[/.-])(69|[7-9][0-9])(?![0-9])"
_YEAR_FIRST = r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?![0-9])"
_ISO_DAY = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?![0-9])"
_ISO = r"(?s)^([0-9]{4}-[0-9]{1,2}-.*)$"
_DAY_NAMED = r"(?i)^([0-9]{1,2})[ -]([a-z]{3})[a-z]*[ ,-]+([0-9]{4})(?![0-9])"
_NAMED_DAY = r"(?i)^([a-z]{3})[a-z]* ([0-9]{1,2}),? ([0-9]{4})(?![0-9])"
# How every text begins that can be read as a date at all, in numbers, or with the month as a word.
_DATELIKE = r"(?i)^([+-]?[0-9]|[a-z]+ [0-9])"
_NUMBERED = r"^[0-9]{1,4}[/.-][0-9]{1,2}[/.-]"
_WORDED = r"(?i)^([0-9]+[ -]|[a-z]+ [0-9])"


# What every text has that any layout below fits, whatever white space is around it: a text without it costs one look.
_POSSIBLE = rf"(?is)^[\s{WHITESPACE}]*+(?:[0-9]{{1,4}}[/.-][0-9]{{1,2}}[/.-]|[0-9]++[ -](?:.*[0-9 ,-])?[a-z]{{3}}|[a-z]+ [0-9]|[+-]?[0-9].*[ap]m\s*$)"


def _timestamp(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_date(c: Column | str, day_first: bool = True) -> Column:
    """Mixed date text to ``timestamp_ntz``; null when nothing fits.

    ISO text is never day-swapped unless it has no such month. Other text is
    read day first, then month first (or the other way round). Each row finds
    its own layout: texts are rewritten to ISO shape, so one cast serves all.
    A text is rewritten only if it begins like a date, as most cells do not.
    The two commonest layouts, with a year of four digits, need one rewriting.
    A column given by its name is trimmed and read only where a date is possible.
    """
    if isinstance(c, str):
        return F.when(F.col(c).cast("string").rlike(_POSSIBLE), once(strip(c), lambda trimmed: _read_date(F.col(c), trimmed, day_first)))
    return once(c, lambda raw: once(strip(raw), lambda trimmed: _read_date(raw, trimmed, day_first)))


def _read_date(raw: Column, trimmed: Column, day_first: bool) -> Column:
    read_as = lambda pattern, *orders: F.coalesce(*[F.regexp_replace(trimmed, pattern, o).try_cast("timestamp_ntz") for o in orders])
    orders = ("$3-$2-$1", "$3-$1-$2") if day_first else ("$3-$1-$2", "$3-$2-$1")
    common = F.when(trimmed.rlike(_NUMERIC), read_as(_NUMERIC, *orders)).when(trimmed.rlike(_ISO_DAY), read_as(_ISO_DAY, "$1-$2-$3", "$1-$3-$2"))
    # Two-digit years 69-99 belong to the 1900s.
    full = F.regexp_replace(F.regexp_replace(trimmed, _OLD_YEAR, "$119$2"), _SHORT_YEAR, "$120$2")
    shaped = F.regexp_replace(full, _NUMERIC, "$3-$2-$1" if day_first else "$3-$1-$2")
    shaped = F.regexp_replace(shaped, _YEAR_FIRST, "$1-$2-$3")
    swapped = F.regexp_replace(shaped, _ISO_DAY, "$1-$3-$2")
    iso = lambda text: F.regexp_extract(text, _ISO, 1).try_cast("timestamp_ntz")
    named = F.regexp_replace(F.regexp_replace(trimmed, _NAMED_DAY, "$2 $1 $3"), _DAY_NAMED, "$1 $2 $3")
    # The rare layouts are only tried on texts that could have them.
    half_day = raw.rlike(r"(?i)[0-9] ?[ap]m\s*$")
    worded = trimmed.rlike(_WORDED) & raw.rlike("(?i)[0-9 ,-][a-z]{3}|^\\s*[a-z]{3}.*[0-9]{4}")
    read = F.coalesce(
        F.when(trimmed.rlike(_NUMBERED), F.coalesce(iso(shaped), iso(swapped))),
        F.when(half_day, F.coalesce(*[_timestamp(F.upper(t), "yyyy-M-d h:mm[:ss] a") for t in (shaped, swapped)])),
        F.when(worded, _timestamp(F.initcap(named), "d MMM yyyy[ H:mm[:ss]]")),
    )
    return F.coalesce(common, F.when(trimmed.rlike(_DATELIKE), read))


# Date shapes looked for inside event names, in this order.
DATE_IN_TEXT = (
    r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
    r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})",
    r"([0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4})",
)


def date_text_in(c: Column | str) -> Column:
    """First date-shaped piece of a text, as text."""
    text = col(c).cast("string")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in DATE_IN_TEXT])


def date_in_text(c: Column | str) -> Column:
    return parse_date(date_text_in(c))


def day(c: Column | str) -> Column:
    return col(c).cast("date")


def floor_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down.

    A sale at 10:00 on the day before a midnight match is 0 days out, not 1.
    """
    start, end = col(earlier).cast("timestamp_ntz"), col(later).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(float(DAY_MICROS))).cast("int")


def date_lit(value: dt.date | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def midnight(value: dt.date | str | Column) -> Column:
    return date_lit(value).cast("timestamp_ntz")


def day_label(c: Column | str) -> Column:
    return F.date_format(col(c), "dd MMM yyyy")


def month_day(c: Column | str) -> Column:
    return F.date_format(col(c), "MM-dd")


def day_name(c: Column | str) -> Column:
    return F.date_format(col(c), "EEEE")


def month_name(c: Column | str) -> Column:
    return F.date_format(col(c), "MMMM")


def age_in_years(birth: Column | str, as_of: dt.date | str) -> Column:
    """Age on a given day, half-even rounded."""
    return F.bround(F.date_diff(date_lit(as_of), col(birth).cast("date")) / F.lit(365.25), 0)


def age_band(age: Column | str) -> Column:
    age = col(age)
    return (
        F.when(age < 18, "Under 18")
        .when(age <= 30, "18-30")
        .when(age <= 45, "31-45")
        .when(age <= 60, "46-60")
        .when(age > 60, "61+")
    )
