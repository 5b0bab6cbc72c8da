"""Math functions and the change hash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stagecraft.functions.strings import _col


def abs_(x) -> Column:
    return F.abs(_col(x))


def sqrt(x) -> Column:
    return F.sqrt(_col(x))


def round_(x, n: int = 0) -> Column:
    """Half away from zero."""
    return F.round(_col(x), n)


def floor(x) -> Column:
    return F.floor(_col(x))


def ceiling(x) -> Column:
    return F.ceil(_col(x))


def mod(x, y) -> Column:
    """Remainder with the sign of x; NULL for a zero divisor."""
    return F.try_mod(_col(x), F.lit(y) if isinstance(y, (int, float)) else _col(y))


def power(x, y) -> Column:
    return F.pow(_col(x), y if isinstance(y, (int, float)) else _col(y))


def log(x) -> Column:
    """Natural logarithm; NULL at and below zero."""
    return F.ln(_col(x))


def exp(x) -> Column:
    return F.exp(_col(x))


def sign(x) -> Column:
    return F.signum(_col(x))


def checksum(*cols, algorithm: str = "sha2") -> Column:
    """Hash of the columns' text joined by '|'.

    NULL counts as empty text in its own place, so (a, NULL) and (NULL, a) differ.
    ``murmur3`` gives the 32-bit integer form.
    """
    if algorithm == "murmur3":
        return F.hash(*[_col(c) for c in cols])
    if algorithm != "sha2":
        raise ValueError(f"unknown checksum algorithm: {algorithm}")
    texts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *texts), 256)


def pack_digest(col) -> Column:
    """A digest text in half its bytes: what its hex digits stand for, after a mark; any other text unchanged, after another."""
    text = _col(col)
    return F.when(text.rlike(r"\A([0-9a-f]{2})+\z"), F.concat(F.unhex(F.lit("01")), F.unhex(text))).otherwise(
        F.concat(F.unhex(F.lit("00")), text.cast("binary")))


def unpack_digest(col) -> Column:
    """The text that ``pack_digest`` was given."""
    packed = _col(col)
    rest = F.substring(packed, 2, 0x7FFFFFFF)
    return F.when(F.substring(packed, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def random(seed: int | None = None) -> Column:
    return F.rand(seed)
