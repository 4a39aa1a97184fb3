"""Identifiers, match keys and display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxline.functions.dates import day_label
from boxline.functions.text import clean_text, col, normalise_token, text_or_empty


def anonymise(c: Column | str, salt: str) -> Column:
    """First 16 hex digits of a salted SHA-256; null for blank ids."""
    text = clean_text(c)
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), text), 256), 1, 16)


def crc_hex(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(F.encode(text, "UTF-8")))), 8, "0")


def fixture_key_text(competition, season_label, match_date, opponent, venue, default_competition: str = "BBL") -> Column:
    """The text a generated fixture id is a checksum of."""
    or_else = lambda c, default: F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))
    return F.concat_ws(
        "|",
        or_else(competition, default_competition),
        text_or_empty(season_label),
        F.coalesce(F.date_format(col(match_date), "yyyy-MM-dd"), F.lit("")),
        or_else(opponent, "unknown"),
        or_else(venue, "unknown"),
    )


def fixture_id(competition, season_label, match_date, opponent, venue, default_competition: str = "BBL") -> Column:
    prefix = F.upper(normalise_token(F.coalesce(F.nullif(col(competition), F.lit("")), F.lit(default_competition))))
    text = fixture_key_text(competition, season_label, match_date, opponent, venue, default_competition)
    return F.concat(prefix, F.lit("_"), crc_hex(text))


def row_id(prefix: str, row_number: Column | str, *columns: Column | str) -> Column:
    """Stable id of a row without one: checksum of its text and its number."""
    text = F.concat_ws("|", *[text_or_empty(c) for c in columns])
    return F.concat(F.lit(f"{prefix}_"), crc_hex(text), F.lit("_"), col(row_number).cast("string"))


def match_key(competition, season_label, opponent, venue, match_date=None) -> Column:
    """Normalised fixture key, with the date when one is given."""
    parts = [normalise_token(c) for c in (competition, season_label, opponent, venue)]
    if match_date is not None:
        parts.append(F.coalesce(F.date_format(col(match_date), "yyyyMMdd"), F.lit("")))
    return F.concat_ws("|", *parts)


def fixture_label(competition, opponent, match_date, status, is_assumed) -> Column:
    state = F.when(F.coalesce(col(is_assumed), F.lit(False)), "TBD / assumed").otherwise(
        F.coalesce(F.nullif(col(status), F.lit("")), F.lit("historical"))
    )
    return F.concat(
        F.coalesce(col(competition), F.lit("BBL")),
        F.lit(" v "),
        F.coalesce(col(opponent), F.lit("Opponent TBC")),
        F.lit(" | "),
        F.coalesce(day_label(match_date), F.lit("date TBC")),
        F.lit(" | "),
        state,
    )


def match_label(competition, round_number, opponent, event_date) -> Column:
    return F.concat(
        col(competition), F.lit(" | M"), col(round_number).cast("int").cast("string"),
        F.lit(" | v "), col(opponent), F.lit(" | "), day_label(event_date),
    )


def date_range_label(first: Column, last: Column) -> Column:
    text = F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit(" to "), F.date_format(last, "yyyy-MM-dd"))
    return F.coalesce(text, F.lit("Unavailable"))


def thousands(c: Column, decimals: int = 0) -> Column:
    """Number with separators, half-even like Python's format()."""
    return F.format_number(c.cast("double"), decimals)
