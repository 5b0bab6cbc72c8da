"""The stage language's scalar functions, and the registry of custom routines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from stagecraft.functions import dates, maths, nulls, strings

# Stage-language name -> Column function.
BY_NAME: dict[str, Callable[..., Column]] = {
    "Upcase": strings.upcase, "Downcase": strings.downcase, "Trim": strings.trim,
    "LTrim": strings.ltrim, "RTrim": strings.rtrim, "Length": strings.length,
    "Left": strings.left, "Right": strings.right, "Mid": strings.mid, "Index": strings.index,
    "Field": strings.field, "Char": strings.char, "Str": strings.str_, "Num": strings.num,
    "Space": strings.space, "Convert": strings.convert,
    "Year": dates.year, "Month": dates.month, "Day": dates.day, "Hour": dates.hour,
    "Minute": dates.minute, "Second": dates.second, "DayOfWeek": dates.day_of_week,
    "WeekOfYear": dates.week_of_year, "Quarter": dates.quarter,
    "CurrentDate": dates.current_date, "CurrentTime": dates.current_time,
    "CurrentTimestamp": dates.current_timestamp,
    "DateFromComponents": dates.date_from_components,
    "TimestampFromComponents": dates.timestamp_from_components,
    "DaysAfter": dates.days_after, "DaysBefore": dates.days_before,
    "DateDiff": dates.date_diff, "MonthDiff": dates.month_diff,
    "DateToString": dates.date_to_string, "StringToDate": dates.string_to_date,
    "Abs": maths.abs_, "Sqrt": maths.sqrt, "Round": maths.round_, "Floor": maths.floor,
    "Ceiling": maths.ceiling, "Mod": maths.mod, "Power": maths.power, "Log": maths.log,
    "Exp": maths.exp, "Sign": maths.sign, "Checksum": maths.checksum, "Random": maths.random,
    "IsNull": nulls.is_null, "IsNotNull": nulls.is_not_null, "IsVoid": nulls.is_void,
    "Nvl": nulls.nvl, "NullToValue": nulls.null_to_value,
}


class Routines:
    """Custom routines of one job: native Column functions first, Arrow UDFs otherwise."""

    def __init__(self) -> None:
        self._columns: dict[str, Callable[..., Column]] = dict(BY_NAME)
        self._udfs: dict[str, object] = {}

    def add(self, name: str, fn: Callable[..., Column]) -> None:
        """A routine that can be written with built-in functions."""
        self._columns[name] = fn

    def add_arrow(self, name: str, udf) -> None:
        """A routine that cannot; ``udf`` is the result of ``pandas_udf``."""
        self._udfs[name] = udf
        self._columns[name] = udf

    def __getitem__(self, name: str) -> Callable[..., Column]:
        return self._columns[name]

    def register_for_sql(self, spark: SparkSession) -> None:
        """Make the Arrow routines callable by name from SQL text."""
        for name, udf in self._udfs.items():
            spark.udf.register(name, udf)
