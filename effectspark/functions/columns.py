"""Column expressions for text slices, calendar parts and row hashes.

All of them are built-in Spark expressions, so they stay inside generated
code; none depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
HOUR_SECONDS = 3_600

# Fixed value: the year stands in brackets at the end of the title.
YEAR_PATTERN = r"\((\d{4})\)\s*$"


def right_chars(text: Column, n: int) -> Column:
    """The rightmost ``n`` characters (all of them when the text is shorter)."""
    return F.right(text, F.lit(n))


def drop_last_char(text: Column) -> Column:
    return F.left(text, F.greatest(F.length(text) - 1, F.lit(0)))


def year_by_slice(title: Column) -> Column:
    """Year from a title that ends in ``(YYYY)``; NULL when the slice is no integer."""
    return drop_last_char(right_chars(title, 5)).try_cast("int")


def year_by_pattern(title: Column) -> Column:
    """Like :func:`year_by_slice`, but blanks after the bracket do no harm."""
    return F.regexp_extract(title, YEAR_PATTERN, 1).try_cast("int")


def utc_date(epoch_s: Column) -> Column:
    """UTC calendar date of epoch seconds, also before 1970."""
    return F.date_from_unix_date(F.floor(epoch_s / DAY_SECONDS).cast("int"))


def utc_hour(epoch_s: Column) -> Column:
    return F.floor(F.pmod(epoch_s, F.lit(DAY_SECONDS)) / HOUR_SECONDS).cast("int")


def row_hash(*keys: Column | str, seed: str = "") -> Column:
    """32 reproducible bits per row as a bigint.

    md5 gives the same bits in every engine and does not depend on how rows
    are partitioned, unlike ``rand(seed)``.
    """
    parts = ([F.lit(seed)] if seed else []) + [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_digits(h: Column, skip: int, base: int) -> Column:
    """``(h div skip) mod base``: independent digits of one hash."""
    return F.pmod(F.floor(h / skip), F.lit(base)).cast("int")
