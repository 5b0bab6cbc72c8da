"""Rewriting a table of stage expressions, column-wise, with native string functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# Stage-language call, number of arguments, replacement ($n = n-th argument).
# They apply in this order, each to the result of the one before.
SPARK_REWRITES = [
    ("Upcase", 1, "upper($1)"),
    ("Downcase", 1, "lower($1)"),
    ("Trim", 1, "trim($1)"),
    ("LTrim", 1, "ltrim($1)"),
    ("RTrim", 1, "rtrim($1)"),
    ("Length", 1, "length($1)"),
    ("Left", 2, "substring($1, 1, $2)"),
    ("Right", 2, "substring($1, -$2)"),
    ("Mid", 3, "substring($1, $2, $3)"),
    ("Index", 3, "locate($2, $1)"),
    ("Field", 3, "split($1, $2)[$3 - 1]"),
    ("Char", 1, "cast($1 as string)"),
    ("Str", 1, "cast($1 as string)"),
    ("Num", 1, "cast($1 as double)"),
    ("Space", 1, "repeat(' ', $1)"),
    ("Convert", 3, "translate($3, $1, $2)"),
    ("Year", 1, "year($1)"),
    ("Month", 1, "month($1)"),
    ("Day", 1, "dayofmonth($1)"),
    ("Hour", 1, "hour($1)"),
    ("Minute", 1, "minute($1)"),
    ("Second", 1, "second($1)"),
    ("DayOfWeek", 1, "dayofweek($1)"),
    ("WeekOfYear", 1, "weekofyear($1)"),
    ("Quarter", 1, "quarter($1)"),
    ("CurrentDate", 0, "current_date()"),
    ("CurrentTime", 0, "current_timestamp()"),
    ("CurrentTimestamp", 0, "current_timestamp()"),
    ("DateFromComponents", 3, "make_date($1, $2, $3)"),
    ("TimestampFromComponents", 6, "make_timestamp($1, $2, $3, $4, $5, $6)"),
    ("DaysAfter", 2, "date_add($2, $1)"),
    ("DaysBefore", 2, "date_sub($2, $1)"),
    ("DateDiff", 2, "datediff($1, $2)"),
    ("MonthDiff", 2, "months_between($1, $2)"),
    ("DateToString", "format", "date_format($1, '$2')"),
    ("StringToDate", "format", "to_date($1, '$2')"),
    ("Abs", 1, "abs($1)"),
    ("Sqrt", 1, "sqrt($1)"),
    ("Round", 2, "round($1, $2)"),
    ("Floor", 1, "floor($1)"),
    ("Ceiling", 1, "ceil($1)"),
    ("Mod", 2, "($1 % $2)"),
    ("Power", 2, "pow($1, $2)"),
    ("Log", 1, "log($1)"),
    ("Exp", 1, "exp($1)"),
    ("Sign", 1, "signum($1)"),
    ("Checksum", 1, "hash($1)"),
    ("Random", 0, "rand()"),
    ("IsNull", 1, "($1 is null)"),
    ("IsNotNull", 1, "($1 is not null)"),
    ("IsVoid", 1, "($1 is null)"),
    ("Nvl", 2, "coalesce($1, $2)"),
    ("NullToValue", 2, "coalesce($1, $2)"),
]

# The same for the SQL-dialect target.
SQL_REWRITES = [
    ("Upcase", 1, "UPPER($1)"),
    ("Downcase", 1, "LOWER($1)"),
    ("Trim", 1, "TRIM($1)"),
    ("LTrim", 1, "LTRIM($1)"),
    ("RTrim", 1, "RTRIM($1)"),
    ("Length", 1, "LENGTH($1)"),
    ("Left", 2, "SUBSTR($1, 1, $2)"),
    ("Right", 2, "SUBSTR($1, LENGTH($1) - $2 + 1, $2)"),
    ("Mid", 3, "SUBSTR($1, $2, $3)"),
    ("Char", 1, "CAST($1 AS STRING)"),
    ("Num", 1, "CAST($1 AS DOUBLE)"),
    ("Year", 1, "YEAR($1)"),
    ("Month", 1, "MONTH($1)"),
    ("Day", 1, "DAY($1)"),
    ("CurrentDate", 0, "CURRENT_DATE()"),
    ("CurrentTimestamp", 0, "CURRENT_TIMESTAMP()"),
    ("DateFromComponents", 3, "DATE($1, $2, $3)"),
    ("Abs", 1, "ABS($1)"),
    ("Sqrt", 1, "SQRT($1)"),
    ("Round", 2, "ROUND($1, $2)"),
    ("Floor", 1, "FLOOR($1)"),
    ("Ceiling", 1, "CEIL($1)"),
    ("Checksum", 1, "HASH($1)"),
    ("IsNull", 1, "($1 IS NULL)"),
    ("IsNotNull", 1, "($1 IS NOT NULL)"),
    ("Nvl", 2, "COALESCE($1, $2)"),
    ("NullToValue", 2, "COALESCE($1, $2)"),
]

# Calls whose presence marks an expression as not translated.
RESIDUAL_CALLS = ["Upcase(", "Downcase(", "Year(", "Month(", "IsNull("]

KEYWORDS = ["if", "then", "else", "and", "or", "not", "is", "null"]


def call_pattern(name: str, args: int | str) -> str:
    """Regex of a call with that many (shortest) arguments."""
    if args == "format":
        return name + r"""\((.+?),\s*["'](.+?)["']\)"""
    return name + r"\(" + r",\s*".join([r"(.+?)"] * args) + r"\)"


def _strip(e: Column) -> Column:
    return F.btrim(e, F.lit(" \t\n\r\f\v"))


def _literal(v: Column) -> Column:
    """``"X"`` -> ``'X'``."""
    return F.regexp_replace(v, '(?s)^"(.*)"$', "'$1'")


def _conditional(e: Column, target: str) -> Column:
    """If / Then / Else chain, one piece per branch."""
    branch = r"(?is)^If\s+(.+?)\s+Then\s+(.+)$"

    def condition(p: Column) -> Column:
        c = _strip(F.regexp_extract(p, branch, 1))
        c = F.regexp_replace(c, r"(?<![<>!])=(?!=)", "==")
        c = F.replace(c, F.lit(" Is Not Null"), F.lit(" is not null"))
        return F.replace(c, F.lit(" Is Null"), F.lit(" is null"))

    def piece(p: Column) -> Column:
        value = _literal(_strip(F.regexp_extract(p, branch, 2)))
        rest = _literal(_strip(p))
        if target == "spark":
            yes = F.concat(F.lit("when("), condition(p), F.lit(", "), value, F.lit(")"))
            no = F.concat(F.lit("otherwise("), rest, F.lit(")"))
        else:
            yes = F.concat(F.lit("WHEN "), condition(p), F.lit(" THEN "), value)
            no = F.concat(F.lit("ELSE "), rest)
        return F.when(p.rlike(branch), yes).otherwise(no)

    pieces = F.transform(F.split(e, r"(?i)\s+Else\s+"), piece)
    if target == "spark":
        return F.array_join(pieces, ".")
    return F.concat(F.lit("CASE "), F.array_join(pieces, " "), F.lit(" END"))


def _rewrite_calls(e: Column, rewrites: list[tuple]) -> Column:
    """All rewrites in order.  The cheap text test spares nearly every regex."""
    text = json.dumps([
        {"call": name + "(", "pattern": call_pattern(name, args), "replacement": replacement}
        for name, args, replacement in rewrites
    ])
    # A constant: parsed once, when the plan is optimized.
    rules = F.from_json(F.lit(text), "array<struct<call:string,pattern:string,replacement:string>>")
    return F.aggregate(rules, e, lambda acc, r: F.when(
        acc.contains(r["call"]), F.regexp_replace(acc, r["pattern"], r["replacement"])
    ).otherwise(acc))


def translate(expression, target: str = "spark") -> Column:
    """Translate a column of expressions; ``target`` is ``spark`` or ``sql``."""
    raw = F.col(expression) if isinstance(expression, str) else expression
    e = _strip(raw)
    calls = _rewrite_calls(e, SPARK_REWRITES if target == "spark" else SQL_REWRITES)
    concat = "concat(" if target == "spark" else "CONCAT("
    parts = F.transform(F.split(calls, ":"), _strip)
    joined = F.concat(F.lit(concat), F.array_join(parts, ", "), F.lit(")"))
    return (
        F.when(raw.isNull() | (raw == ""), raw)
        .when(e.rlike(r"(?i)^If\s+"), _conditional(e, target))
        .when(e.contains(":") & ~e.startswith("jdbc"), joined)
        .otherwise(calls)
    )


def with_translation(derivations: DataFrame, target: str = "spark", name: str = "translated") -> DataFrame:
    return derivations.withColumn(name, translate("expression", target))


def function_usage(derivations: DataFrame) -> DataFrame:
    """Calls per job, stage and function name."""
    calls = F.regexp_extract_all("expression", F.lit(r"([A-Za-z_]\w*)\("), 1)
    return (
        derivations.select("job_id", "stage_id", F.explode(calls).alias("function"))
        .groupBy("job_id", "stage_id", "function").agg(F.count(F.lit(1)).alias("uses"))
    )


def residual_calls(translated: Column) -> Column:
    """The stage-language calls still present, comma-separated."""
    return F.concat_ws(",", *[F.when(translated.contains(c), F.lit(c)) for c in RESIDUAL_CALLS])


def conditional_flags(derivations: DataFrame) -> DataFrame:
    """Conditional expressions; more than one ``if`` needs a look."""
    ifs = F.regexp_count(F.lower("expression"), F.lit("if "))
    return (
        derivations.withColumn("ifs", ifs).where("ifs > 0")
        .withColumn("needs_review", F.when(F.col("ifs") > 1, 1).otherwise(0))
    )


def references(expression) -> Column:
    """Distinct identifiers an expression reads: not in quotes, not called, not keywords."""
    e = F.col(expression) if isinstance(expression, str) else expression
    bare = F.regexp_replace(e, "\"[^\"]*\"|'[^']*'", " ")
    bare = F.regexp_replace(bare, r"[A-Za-z_]\w*\(", "(")
    names = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)"), 1)
    return F.array_distinct(F.filter(names, lambda n: ~F.lower(n).isin(*KEYWORDS)))


def column_refs(derivations: DataFrame) -> DataFrame:
    return derivations.select(
        "job_id", "stage_id", "output_column", F.explode(references("expression")).alias("ref")
    ).distinct()


def parse_aggregations(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``FN(col) AS alias, ...`` lists to rows."""
    item = r"(?i)^(\w+)\(([^)]+)\)\s+AS\s+(\w+)"
    part = _strip(F.col("part"))
    return (
        df.select(*keep, F.posexplode(F.split(column, ",")).alias("pos", "part"))
        .where(part.rlike(item))
        .select(
            *keep, "pos", F.upper(F.regexp_extract(part, item, 1)).alias("function"),
            _strip(F.regexp_extract(part, item, 2)).alias("column"),
            F.regexp_extract(part, item, 3).alias("alias"),
        )
    )
