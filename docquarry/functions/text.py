"""Text as Column expressions; all of them stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Unicode and the information separators U+001C to U+001F have it.
SPACES = r"(?U)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    """text without whitespace at its ends."""
    return F.regexp_replace(text, _EDGES, "")


def blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def three_places(x: Column) -> Column:
    """A number with three decimals, exact halves rounded to even."""
    return F.format_string("%.3f", F.bround(x.cast("decimal(38,20)"), 3).cast("double"))


def suffix(name: Column) -> Column:
    """The lower-cased last extension of a file name, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))


def fingerprint(name: Column, content: Column) -> Column:
    """SHA-256, in hex, of a file's name followed by its bytes."""
    return F.sha2(F.concat(F.encode(name, "UTF-8"), content), 256)
