"""Season labels such as ``2024/25`` (July to June)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxline.functions.text import clean_text, col, once

_RANGE = r"([0-9]{2,4})\s*[-/]\s*([0-9]{2,4})"
_YEAR = r"(20[0-9]{2})"


def _label(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("/"), F.lpad(end.cast("string"), 2, "0"))


def season_label(c: Column | str) -> Column:
    """Canonical label from free text; other text is kept as it is."""
    return once(clean_text(c), _canonical)


def _canonical(text: Column) -> Column:
    start = F.regexp_extract(text, _RANGE, 1).try_cast("int")
    start = F.when(start < 100, start + 2000).otherwise(start)
    end = F.right(F.regexp_extract(text, _RANGE, 2), F.lit(2)).try_cast("int")
    year = F.regexp_extract(text, _YEAR, 1).try_cast("int")
    return (
        F.when(text.rlike(_RANGE), _label(start, end))
        .when(text.rlike(_YEAR), _label(year, (year + 1) % 100))
        .otherwise(text)
    )


def season_start_of_date(d: Column | str) -> Column:
    d = col(d)
    return F.year(d) - F.when(F.month(d) < 7, 1).otherwise(0)


def season_label_of_date(d: Column | str) -> Column:
    start = season_start_of_date(d)
    return F.when(col(d).isNotNull(), _label(start, (start + 1) % 100))


def season_start(c: Column | str) -> Column:
    """First 20xx year in a label; null for other labels."""
    return F.regexp_extract(clean_text(c), _YEAR, 1).try_cast("int")


def season_start_year(c: Column | str) -> Column:
    """Number before the slash, whatever the century."""
    return F.trim(F.substring_index(col(c), "/", 1)).try_cast("int")


def days_since_season_start(d: Column | str, label: Column | str, month: int = 8, day: int = 1) -> Column:
    """Days from the first on-sale day of the season (1 August) to a sale."""
    start = F.make_date(season_start_year(label), F.lit(month), F.lit(day))
    return F.date_diff(col(d).cast("date"), start)
