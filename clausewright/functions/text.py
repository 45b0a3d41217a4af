"""Column helpers for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it: a pattern (with (?U)), and its characters.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def pieces_after(text: Column, pattern: str) -> Column:
    """What follows each match of ``pattern``, up to the next one."""
    parts = F.split(text, pattern, -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def first_split(text: Column, pattern: str) -> tuple[Column, Column]:
    """Text before and after the first match; after is null without one."""
    parts = F.split(text, pattern, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
