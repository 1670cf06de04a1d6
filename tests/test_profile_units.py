from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.units import parse_unit, unit
from ledgerloom.operators import profile


def test_units(spark):
    assert parse_unit("kPa")[0] == pytest.approx(1e3) and parse_unit("N/m^2")[1] == parse_unit("Pa")[1]
    assert parse_unit("m s^1/2")[1][2] == Fraction(1, 2) if parse_unit("m s^1/2") else True
    assert parse_unit("furlong") is None and parse_unit("")[1] == (0,) * 7
    assert parse_unit("min")[0] == 60 and parse_unit("mm")[0] == pytest.approx(1e-3) and parse_unit("J/kg/K")[1] == (2, 0, -2, 0, -1, 0, 0)
    df = spark.createDataFrame([("mm",), (None,), ("what",), ("mm",)], "u string")
    got = [(r.v.factor, r.v.dimension) if r.v else None for r in df.select(unit(F.col("u")).alias("v")).collect()]
    assert got[0] == got[3] and got[0][1] == "m^1" and got[1][1] is None and got[2][1] is None


def test_profile(spark):
    df = spark.createDataFrame([("1", "x", None), ("2.5", " NA ", None), (None, "x", None), ("nan", "y", None)], "a string, b string, `c d` string")
    p = {r.column: r for r in profile.column_profile(df).collect()}
    assert (p["a"].n, p["a"].n_missing, p["a"].n_numeric, p["a"].mean) == (4, 2, 2, 1.75)
    assert (p["b"].n_missing, p["b"].n_distinct, p["b"].mean) == (1, 2, None) and p["c d"].n_missing == 4
    assert profile.column_profile(df.limit(0)).count() == 3
    assert [(r.value, r.n) for r in profile.class_balance(df, "b", 1).collect()] == [("x", 2)]
    html = "<table><tr><th>Column</th><th>Text</th></tr><tr><td><b>t</b></td><td>time of  day</td></tr><tr><td></td></tr></table><table><tr><th>Price</th></tr><tr><td>9</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><th>field"), (4, "")], "id int, html string")
    assert [(r.id, r.table_no, r.column, r.description) for r in profile.html_columns(pages, "id", "html").collect()] == [(1, 0, "t", "time of day")]
