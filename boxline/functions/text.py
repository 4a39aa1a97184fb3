"""Text cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Texts that mean "no value" in raw exports.
NULL_TOKENS = ("", "null", "none", "nan", "nat", "#n/a", "n/a", "-")
# The shorter lists used for join keys and for filter labels.
ID_NULL_TOKENS = ("", "nan", "none", "null", "<na>")
UNKNOWN_TOKENS = ("", "unknown", "unmatched", "none", "nan", "<na>")
UNKNOWN_LABEL = "Unknown / unmatched"

BOM = "\ufeff"
# Every character that counts as white space in Unicode text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` looks at it."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column | str) -> Column:
    """Trim any Unicode white space from both ends.

    A column given by its name is looked at several times, so that texts which
    begin and end with visible ASCII need no trimming; an expression is not
    repeated for that.
    """
    text = col(c).cast("string")
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(text.between("!", "~") & F.reverse(text).between("!", "~"), text).otherwise(trimmed) if isinstance(c, str) else trimmed


def clean_text(c: Column | str) -> Column:
    """Trim, drop byte-order marks, and turn null-like tokens into null. A column given by its name costs less, as in ``strip``."""
    if not isinstance(c, str):
        text = strip(F.replace(col(c).cast("string"), F.lit(BOM), F.lit("")))
        return F.when(~F.lower(text).isin(*NULL_TOKENS), text)
    raw = F.col(c).cast("string")
    text = F.when(F.contains(raw, F.lit(BOM)), strip(F.replace(raw, F.lit(BOM), F.lit("")))).otherwise(strip(c))
    return F.when((F.length(text) > max(map(len, NULL_TOKENS))) | ~F.lower(text).isin(*NULL_TOKENS), text)


def normalise_token(c: Column | str) -> Column:
    """Lower-case ``a_b_c`` form used for keys and fuzzy header matching."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    text = F.lower(strip(F.replace(text, F.lit(BOM), F.lit(""))))
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))


def join_id(c: Column | str) -> Column:
    """Case-insensitive identifier used to join customers; null when blank."""
    text = F.lower(strip(c))
    return F.when(~text.isin(*ID_NULL_TOKENS), text)


def unknown_bucket(c: Column | str) -> Column:
    """Filter label: trimmed text, or a visible bucket when there is none."""
    text = strip(c)
    return F.when(text.isNull() | F.lower(text).isin(*ID_NULL_TOKENS), F.lit(UNKNOWN_LABEL)).otherwise(text)


def fill_missing_text(primary: Column | str, fallback: Column | str) -> Column:
    """Keep ``primary`` unless it is null, blank or an "unknown" word."""
    primary = col(primary)
    missing = primary.isNull() | F.lower(strip(primary)).isin(*UNKNOWN_TOKENS)
    return F.when(missing, col(fallback)).otherwise(primary)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def truthy(c: Column | str) -> Column:
    """Null-safe boolean from a boolean or text flag."""
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("false")))
    return text.isin("true", "1", "yes", "y")
