"""Column functions against the hand-written fixtures (FIXTURES.md 1.1-1.8)."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portrisk.functions import scalars as X

NAN = float("nan")


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_br_number(spark):
    data = [("52.500,75",), ("1.250.000",), ("abc",), ("nan",), ("1.000",), (None,), (" 12,5 ",)]
    out = one(spark, X.parse_br_number("s"), data, "s string")
    assert out == [52500.75, 1250000.0, 0.0, 0.0, 1000.0, 0.0, 12.5]


@settings(max_examples=12, deadline=None)
@given(st.integers(min_value=0, max_value=10**9), st.integers(min_value=0, max_value=99))
def test_br_number_roundtrip(spark, whole, cents):
    text = f"{whole:,}".replace(",", ".") + f",{cents:02d}"
    out = one(spark, X.parse_br_number("s"), [(text,)], "s string")[0]
    assert out == float(f"{whole}.{cents:02d}")


def test_dayfirst(spark):
    data = [("03/01/2026 10:30",), ("31/12/2025",), ("13/13/2026",), ("05/01/2026",), (None,),
            ("2026-01-07",)]
    out = one(spark, X.parse_dayfirst("s"), data, "s string")
    assert out == [dt.datetime(2026, 1, 3, 10, 30), dt.datetime(2025, 12, 31), None,
                   dt.datetime(2026, 1, 5), None, dt.datetime(2026, 1, 7)]


@pytest.mark.parametrize("rain,wind,expected", [
    (0.0, 10.0, False), (5.0, 15.0, False), (5.1, 2.0, True), (None, 16.0, True),
    (None, None, False), (NAN, 1.0, False), (6.0, None, True), (NAN, NAN, False), (1.0, NAN, False),
])
def test_critical_alert_null_nan_grid(spark, rain, wind, expected):
    out = one(spark, X.critical_alert("r", "w"), [(rain, wind)], "r double, w double")
    assert out == [expected]


def test_fill_zero(spark):
    assert one(spark, X.fill_zero("r"), [(None,), (NAN,), (2.5,)], "r double") == [0.0, 0.0, 2.5]


def test_tiers_at_exact_thresholds(spark):
    news = one(spark, X.news_tier("v"), [(0.0,), (0.0001,), (0.4,), (0.41,), (None,)], "v double")
    assert news == ["normal", "attention", "attention", "alert", "normal"]
    prob = one(spark, X.probability_tier("v"), [(0.4,), (0.41,), (0.7,), (0.71,), (None,)], "v double")
    assert prob == ["safe", "moderate", "moderate", "high", "safe"]


def test_delay_label_fixture(spark):
    data = [(0.0, 30.1, 0.0), (25.1, 0.0, 0.0), (0.0, 0.0, 0.86), (10.0, 15.0, 0.5),
            (10.0, 10.0, 0.25), (0.0, 0.0, 0.0), (None, None, None)]
    out = one(spark, X.delay_label("r", "w", "n"), data, "r double, w double, n double")
    assert out == [1, 1, 1, 1, 0, 0, 0]


@settings(max_examples=12, deadline=None)
@given(st.floats(0, 100), st.floats(0, 60), st.floats(0, 1))
def test_delay_label_matches_python_rule(spark, r, w, n):
    def rule(r, w, n):
        if w > 30 or r > 25 or n > 0.85:
            return 1
        return 1 if (r * 0.02) + (w * 0.03) + (n * 0.4) > 0.7 else 0
    out = one(spark, X.delay_label("r", "w", "n"), [(r, w, n)], "r double, w double, n double")
    assert out == [rule(r, w, n)]


def test_format_local(spark):
    out = one(spark, X.format_local("t"), [(dt.datetime(2026, 12, 1, 2, 30),)], "t timestamp")
    assert out == ["30/11/2026 23:30"]


def test_headline_always_ellipsis(spark):
    out = one(spark, X.headline("t", 40), [("Greve no porto",), ("x" * 60,), (None,)], "t string")
    assert out == ["Greve no porto...", "x" * 40 + "...", None]


def test_wkt_points(spark):
    data = [("POINT(-46.3339 -23.9608)",), ("POINT (-46.4961 -23.8919)",), ("point(1e1 -2.5E0)",),
            ("LINESTRING(0 0,1 1)",), (None,)]
    xs = one(spark, X.point_x("c"), data, "c string")
    ys = one(spark, X.point_y("c"), data, "c string")
    assert xs == [-46.3339, -46.4961, 10.0, None, None]
    assert ys == [-23.9608, -23.8919, -2.5, None, None]


def test_json_key_default(spark):
    data = [('{"evento":"Teste","rodovia":"Anchieta"}',), ('{"rodovia":"Anchieta"}',), ("not json",)]
    assert one(spark, X.json_key("j", "evento", "N/A"), data, "j string") == ["Teste", "N/A", "N/A"]


def test_contains_any_unicode_case(spark):
    data = [("LENTIDÃO no km 40",), ("INTERDIÇÃO",), ("normal",), (None,)]
    out = one(spark, X.contains_any("t", ["lentidão", "interdição"]), data, "t string")
    assert out == [True, True, False, False]


def test_fmt(spark):
    data = [(12.34, 0.4567)]
    df = spark.createDataFrame(data, "a double, p double")
    r = df.select(X.fmt("a", ".1f mm"), X.fmt("p", ".1%"), X.fmt("p", ".2%"), X.fmt("a", ".0f%")).first()
    assert tuple(r) == ("12.3 mm", "45.7%", "45.67%", "12%")


def test_row_hash_id_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    a = [r[0] for r in df.select(X.row_hash_id("k", "v")).collect()]
    b = [r[0] for r in df.repartition(3).orderBy("k").select(X.row_hash_id("k", "v")).collect()]
    assert a == b and len(set(a)) == 2 and all(len(x) == 64 for x in a)


def test_weighted_risk_order(spark):
    out = one(spark, X.weighted_risk("r", "w", "n"), [(10.0, 15.0, 0.5)], "r double, w double, n double")
    assert math.isclose(out[0], (10.0 * 0.02) + (15.0 * 0.03) + (0.5 * 0.4))


def test_no_python_udf_in_scalars(spark):
    df = spark.createDataFrame([("1.000,5", "03/01/2026")], "n string, d string")
    plan = df.select(X.parse_br_number("n"), X.parse_dayfirst("d"), X.delay_label(
        F.lit(1.0), F.lit(2.0), F.lit(0.1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_numbers_and_dates_the_cast_would_misread(spark):
    nums = [("10D",), ("5f",), ("1e3",), ("-1.250,5",), ("inf",), ("NaN",), ("",), (None,)]
    assert one(spark, X.parse_br_number("n"), nums, "n string") == [0.0, 0.0, 1000.0, -1250.5, 0.0, 0.0, 0.0, 0.0]
    texts = ["03/01/26", "03-01-2026", "3.1.2026 10:30", "31/12/99", "2026-01-03", "01/02/68 05:06:07", "13/13/26", "1/2/123"]
    got = one(spark, X.parse_dayfirst("d"), [(t,) for t in texts], "d string")
    d = dt.datetime
    assert got == [d(2026, 1, 3), d(2026, 1, 3), d(2026, 1, 3, 10, 30), d(1999, 12, 31), d(2026, 1, 3),
                   d(2068, 2, 1, 5, 6, 7), None, None]


def test_nan_is_missing(spark):
    nan = float("nan")
    assert one(spark, X.delay_label("r", "w", "n"), [(nan, 0.0, 0.0), (0.0, nan, nan)],
               "r double, w double, n double") == [0, 0]
    assert one(spark, X.news_tier("v"), [(nan,), (0.5,)], "v double") == ["normal", "alert"]


def test_row_hash_id_tells_keys_apart(spark):
    keys = [("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a", "", "b"), ("a1:b", None, None)]
    assert len(set(one(spark, X.row_hash_id("x", "y", "z"), keys, "x string, y string, z string"))) == len(keys)
