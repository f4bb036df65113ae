"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gainsay.functions.time import utc_text


def basename(path: Column) -> Column:
    """Last path component; both slash kinds separate."""
    return F.regexp_extract(path, r"[^\\/]+$", 0)


# The characters that count as white space, Unicode ones included.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop leading and trailing white space."""
    return F.trim(text, F.lit(WHITE_SPACE))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    """Literal containment; a NULL text holds nothing."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(part))


def row_contains(columns: Sequence[str | Column], query: str) -> Column:
    """Case-insensitive search over the joined text of a whole row."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    joined = F.concat_ws("", *[cell.cast("string") for cell in cells])
    return F.contains(F.lower(joined), F.lit(query.lower()))


def html_escape(text: Column) -> Column:
    # The five characters HTML escapes, ampersand first.
    for raw, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def iso_timestamp(timestamp: Column) -> Column:
    """ISO-8601 in UTC; the fraction is left out when it is zero."""
    micros = F.pmod(F.unix_micros(timestamp), F.lit(1_000_000))
    fraction = F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    return F.concat(utc_text(timestamp), F.when(micros == 0, "").otherwise(fraction), F.lit("+00:00"))


def numeric_first(column: str | Column) -> list[Column]:
    """Sort keys: numbers by value first, then other texts."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    number = text.try_cast("double")
    return [number.isNull(), number, text]
