"""NULL handling and conditionals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stagecraft.functions.strings import _col


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def is_null(x) -> Column:
    return _col(x).isNull()


def is_not_null(x) -> Column:
    return _col(x).isNotNull()


def is_void(x) -> Column:
    return _col(x).isNull()


def nvl(x, default) -> Column:
    return F.coalesce(_col(x), _value(default))


def null_to_value(x, default) -> Column:
    return F.coalesce(_col(x), _value(default))


def conditional(branches: list[tuple[Column, object]], otherwise=None) -> Column:
    """``If c1 Then v1 Else If c2 Then v2 Else v``; the first true branch wins."""
    if not branches:
        return _value(otherwise)
    (cond, value), *rest = branches
    chain = F.when(cond, _value(value))
    for cond, value in rest:
        chain = chain.when(cond, _value(value))
    return chain.otherwise(_value(otherwise))
