from datetime import date, timedelta

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casestats.functions import dates
from casestats.functions.text import (
    days_text,
    decimal_comma,
    deviation_label,
    number_text,
    plain_number,
)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def sunday_before(d):
    return d - timedelta(days=d.isoweekday() % 7)


def test_week_start(spark):
    assert value(spark, dates.week_start("2024-05-15 12:00:00")) == date(2024, 5, 12)
    assert value(spark, dates.week_start("2024-05-12 00:00:00")) == date(2024, 5, 12)
    assert value(spark, dates.week_start("2024-05-11 23:59:59")) == date(2024, 5, 5)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.dates(date(1970, 1, 1), date(2100, 12, 31)), min_size=50, max_size=200))
def test_week_arithmetic(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d DATE")
    d = F.col("d")
    start = dates.week_start(d)
    out = df.select(
        "d", start, dates.week_of_year(d), dates.sunday_number(start), dates.month_start(d),
        dates.previous_month_end(d), dates.short_date(d), dates.period_label(d),
    )
    for d, start, week, sunday, first, last, short, period in rows(out):
        assert start == sunday_before(d)
        # Week 1 holds 1 January; every later Sunday opens another week.
        new_year = date(d.year, 1, 1)
        assert week == (sunday_before(d) - sunday_before(new_year)).days // 7 + 1
        assert sunday == int(start.strftime("%U"))
        assert first == d.replace(day=1)
        assert last == d.replace(day=1) - timedelta(days=1)
        assert short == f"{d.day}/{d.month}/{d.year}"
        assert period == f"{d.month}/{d.year}"


@pytest.mark.parametrize(
    "start, label, named",
    [
        ("2001-03-04", "04-10/Mar", "04-10/mar"),
        ("2001-02-25", "25/Feb-03/Mar", "25/fev-03/mar"),
        ("1999-12-26", "26/Dec-01/Jan", "26/dez-01/jan"),
    ],
)
def test_week_label(spark, start, label, named):
    months = "jan fev mar abr mai jun jul ago set out nov dez".split()
    a = F.lit(start).cast("date")
    b = F.date_add(a, 6)
    assert value(spark, dates.week_label(a, b)) == label
    assert value(spark, dates.week_label(a, b, months)) == named


def test_days_between_counts_midnights(spark):
    late, early = dates.moment("2001-01-01 23:59:00"), dates.moment("2001-01-02 00:01:00")
    assert value(spark, dates.days_between(late, early)) == 1
    assert value(spark, dates.days_between(early, late)) == -1


@pytest.mark.parametrize(
    "x, text, plain, comma",
    [
        (5.0, "5", "5", "5"),
        (5.5, "5,5", "5.5", "5,5"),
        (1234567.0, "1.234.567", "1234567", "1234567"),
        (1234.25, "1.234,25", "1234.25", "1234,25"),
        (0.0, "0", "0", "0"),
    ],
)
def test_number_text(spark, x, text, plain, comma):
    c = F.lit(x)
    assert value(spark, plain_number(c)) == plain
    assert value(spark, decimal_comma(c)) == comma
    assert value(spark, number_text(c)) == text
    assert value(spark, days_text(c)) == f"{text}  dias"
    if x == int(x):
        assert value(spark, number_text(F.lit(int(x)))) == text


@pytest.mark.parametrize(
    "scoped, overall, label",
    [
        (10.0, 5.0, "Atrasado  5  dias"),
        (10.5, 5.0, "Atrasado  5.5  dias"),
        (2.0, 5.0, "Adiantado"),
        (3.0, 5.0, "Dentro do esperado"),
        (4.0, 4.0, "Dentro do esperado"),
    ],
)
def test_deviation_label(spark, scoped, overall, label):
    assert value(spark, deviation_label(F.lit(scoped), F.lit(overall), F.lit(3.0))) == label
