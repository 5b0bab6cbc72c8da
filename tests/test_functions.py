"""Edge cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecraft.functions import BY_NAME, dates, maths, nulls, strings


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, sub, n, want", [
    ("a,b,c", ",", 1, 2), ("a,b,c", ",", 2, 4), ("a,b,c", ",", 3, 0), ("abc", ",", 2, 0), ("aaaa", "aa", 2, 3),
    ("x.y.z", ".", 2, 4),
])
def test_index(spark, text, sub, n, want):
    assert value(spark, strings.index(F.lit(text), sub, n)) == want


def test_index_of_null(spark):
    assert value(spark, strings.index(F.lit(None).cast("string"), ",", 2)) is None


def test_field_takes_the_delimiter_literally(spark):
    assert value(spark, strings.field(F.lit("a.b.c"), ".", 2)) == "b"
    assert value(spark, strings.field(F.lit("a.b"), ".", 5)) == ""


def test_right_longer_than_the_text(spark):
    assert value(spark, strings.right(F.lit("abc"), 5)) == "abc"


def test_num_of_bad_text_is_null(spark):
    assert value(spark, strings.num(F.lit("abc"))) is None
    assert value(spark, strings.num(F.lit("1.5"))) == 1.5


def test_convert_and_space(spark):
    assert value(spark, strings.convert("-", "_", F.lit("a-b"))) == "a_b"
    assert value(spark, strings.space(3)) == "   "


def test_concat_with_null(spark):
    assert value(spark, strings.concat(F.lit("a"), F.lit(None).cast("string"))) is None


def test_open_end_date(spark):
    assert value(spark, dates.date_from_components(9999, 12, 31)) == dt.date(9999, 12, 31)


def test_argument_order_of_date_functions(spark):
    day = F.lit("2024-02-28").cast("date")
    assert value(spark, dates.days_after(2, day)) == dt.date(2024, 3, 1)
    assert value(spark, dates.days_before(28, day)) == dt.date(2024, 1, 31)
    assert value(spark, dates.date_diff(F.lit("2024-03-01").cast("date"), day)) == 2


def test_string_to_date_of_bad_text_is_null(spark):
    assert value(spark, dates.string_to_date(F.lit("31/31/2024"), "dd/MM/yyyy")) is None


def test_month_diff_between_month_ends(spark):
    a, b = F.lit("2024-02-29").cast("date"), F.lit("2024-01-31").cast("date")
    assert value(spark, dates.month_diff(a, b)) == 1.0


def test_mod_keeps_the_sign_and_survives_zero(spark):
    assert value(spark, maths.mod(F.lit(-7), 3)) == -1
    assert value(spark, maths.mod(F.lit(7), 0)) is None


def test_log_of_zero_is_null(spark):
    assert value(spark, maths.log(F.lit(0.0))) is None


def test_round_goes_away_from_zero(spark):
    assert value(spark, maths.round_(F.lit("2.5").cast("decimal(4,1)"), 0)) == 3
    assert value(spark, maths.round_(F.lit("-2.5").cast("decimal(4,1)"), 0)) == -3


def test_checksum_tells_null_positions_apart(rows):
    df = rows([("a", None), (None, "a")], "x string, y string").select(maths.checksum("x", "y").alias("h"))
    assert df.distinct().count() == 2


def test_checksum_algorithms(spark):
    assert isinstance(value(spark, maths.checksum(F.lit("a"), algorithm="murmur3")), int)
    with pytest.raises(ValueError):
        maths.checksum(F.lit("a"), algorithm="md6")


@pytest.mark.parametrize("net, want", [(10000.01, "GOLD"), (10000.0, "SILVER"), (5000.0, "BRONZE"), (0.0, "BRONZE"), (None, "BRONZE")])
def test_conditional_boundaries(spark, net, want):
    x = F.lit(net).cast("double")
    assert value(spark, nulls.conditional([(x > 10000, "GOLD"), (x > 5000, "SILVER")], "BRONZE")) == want


def test_every_stage_function_is_there():
    assert len(BY_NAME) == 53
