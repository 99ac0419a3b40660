"""Strings: digests, cursors, titles, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def sha256_hex(x: Column) -> Column:
    return F.sha2(F.encode(x, "UTF-8"), 256)


def base64url(x: Column) -> Column:
    """Base64 with the URL alphabet and without padding."""
    plain = F.regexp_replace(F.base64(x), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def unbase64url(x: Column) -> Column:
    plain = F.translate(x, "-_", "+/")
    missing = (F.lit(4) - F.length(plain) % 4) % 4
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), missing)))


def cursor_encode(fields: Column) -> Column:
    """An opaque cursor for a struct."""
    return base64url(F.encode(F.to_json(fields), "UTF-8"))


def cursor_decode(cursor: Column, schema: str) -> Column:
    """The struct behind a cursor; null for what holds no JSON object."""
    text = F.decode(unbase64url(cursor), "UTF-8")
    return F.when(F.startswith(text, F.lit("{")), F.from_json(text, schema))


def micros_iso(ts: Column) -> Column:
    """ISO text with all six decimals, so that a cursor loses nothing."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def squeeze(x: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")


def title(x: Column, most: int = 40) -> Column:
    """A title: squeezed, null if nothing is left, cut to ``most`` code points and an ellipsis."""
    s = squeeze(x)
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit(ELLIPSIS))).when(s != "", s)


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def utf16_left(x: Column, n: int) -> Column:
    """The first n UTF-16 units, short of one where the cut would split a pair."""
    units = F.encode(x, "UTF-16BE")
    high = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")  # the cut would leave half a pair
    cut = F.decode(F.substring(units, F.lit(1), F.when(high, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    plain = F.octet_length(F.encode(F.left(x, F.lit(n)), "UTF-16BE")) == 2 * F.length(F.left(x, F.lit(n)))
    return F.when(plain, F.left(x, F.lit(n))).otherwise(cut)


def truncated(x: Column, n: int) -> Column:
    """The text, or its first n UTF-16 units and an ellipsis."""
    return F.when(utf16_length(x) <= n, x).otherwise(F.concat(utf16_left(x, n), F.lit(ELLIPSIS)))


def token_estimate(x: Column) -> Column:
    """A third of the length, rounded up."""
    return F.ceil(utf16_length(x) / 3).cast("long")


def markers(x: Column) -> Column:
    """Distinct numbers in square brackets, in order of first mention."""
    found = F.regexp_extract_all(x, F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: m.cast("int")))


def report_cell(x: Column) -> Column:
    """A table cell: bars escaped, white space squeezed."""
    return F.replace(squeeze(x), F.lit("|"), F.lit("\\|"))
