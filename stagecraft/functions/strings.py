"""String functions of the stage language.  Every one returns a native Column."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upcase(s) -> Column:
    return F.upper(_col(s))


def downcase(s) -> Column:
    return F.lower(_col(s))


def trim(s) -> Column:
    return F.trim(_col(s))


def ltrim(s) -> Column:
    return F.ltrim(_col(s))


def rtrim(s) -> Column:
    return F.rtrim(_col(s))


def length(s) -> Column:
    return F.length(_col(s))


def left(s, n: int) -> Column:
    return F.substring(_col(s), 1, n)


def right(s, n: int) -> Column:
    return F.right(_col(s), F.lit(n))


def mid(s, start: int, n: int) -> Column:
    """``n`` characters from the 1-based position ``start``."""
    return F.substring(_col(s), start, n)


def index(s, sub: str, occurrence: int = 1) -> Column:
    """1-based position of the n-th (non-overlapping) occurrence, 0 when there is none."""
    s = _col(s)
    if occurrence == 1:
        return F.locate(sub, s)
    parts = F.split(s, re.escape(sub), -1)
    head = F.concat_ws(sub, F.slice(parts, 1, occurrence))
    return F.when(F.size(parts) > occurrence, F.length(head) + 1).otherwise(
        F.when(s.isNotNull(), F.lit(0))
    )


def field(s, delimiter: str, n: int) -> Column:
    """n-th delimited field; the delimiter is literal text, not a pattern."""
    return F.split_part(_col(s), F.lit(delimiter), F.lit(n))


def char(x) -> Column:
    return _col(x).cast("string")


def str_(x) -> Column:
    return _col(x).cast("string")


def num(s) -> Column:
    """Text to number; NULL where the text is not a number (never raises)."""
    return _col(s).try_cast("double")


def space(n) -> Column:
    return F.repeat(F.lit(" "), n if isinstance(n, Column) else F.lit(n))


def convert(from_chars: str, to_chars: str, s) -> Column:
    """Character-wise replacement."""
    return F.translate(_col(s), from_chars, to_chars)


def concat(*parts) -> Column:
    """``a : b : c``; NULL when any part is NULL."""
    return F.concat(*[_col(p) for p in parts])
