import pytest

from holdfast.functions import money, scoring
from holdfast.functions import series as s


def value(spark, sql):
    return spark.sql(f"SELECT {sql}").head()[0]


def arr(*xs):
    return "array(" + ", ".join(f"{float(x)}D" for x in xs) + ")" if xs else "cast(array() AS array<double>)"


def test_series_math(spark):
    assert value(spark, s.series_cagr(arr(100, 110, 121))) == pytest.approx(0.1)
    assert value(spark, s.series_cagr(arr(-1, 5))) is None
    assert value(spark, s.variation(arr(1, 3))) == pytest.approx(0.5)
    assert value(spark, s.variation(arr(1))) is None
    assert value(spark, s.variation(arr(-1, 1))) is None
    assert value(spark, s.fraction_at_least(arr(), 0.15)) == 0.0
    assert value(spark, s.end_to_end_change(arr(100, 90))) == pytest.approx(-0.1)
    assert value(spark, s.clamp("250D")) == 100.0


def test_roic_aligns_newest_and_defaults_tax(spark):
    got = value(spark, s.roic_history(arr(10, 20, 30), arr(0, 100, 100), arr(0.5)))
    assert got == pytest.approx([30 * 0.5 / 100, 20 * 0.79 / 100])


def test_implied_series(spark):
    assert value(spark, s.implied_series("0.1D", "121D", 3)) == pytest.approx([100, 110, 121])
    assert value(spark, s.implied_series("-0.96D", "121D")) == []
    assert value(spark, s.implied_series("cast(NULL AS double)", "5D", 2)) == [5.0, 5.0]


def test_zero_counts_as_missing(spark):
    same = value(spark, scoring.moat_points("0.3D", "NULL", "0D", "0.7D", "NULL"))
    assert same == pytest.approx(50 + 25 + 12.5)
    assert value(spark, scoring.valuation_points("NULL", "0D", "0D")) == 50.0
    assert value(spark, scoring.valuation_points("0D", "NULL", "NULL")) == pytest.approx(30.0)


def test_classes(spark):
    assert value(spark, scoring.moat_class("true", "NULL", "0.2D", "NULL", "0D")) == "STRONG"
    assert value(spark, scoring.moat_class("false", "cast(NULL AS double)", "0.2D", "NULL", "0D")) == "INSUFFICIENT_DATA"
    assert value(spark, scoring.moat_class("false", "0.2D", "NULL", "0.05D", "0.8D")) == "STRONG"
    assert value(spark, scoring.compounding_class("0.2D", "0.2D", "-0.06D")) == "EXCELLENT"
    assert value(spark, scoring.compounding_class("0.05D", "0.05D", "NULL")) == "MODERATE"


def test_money(spark):
    assert value(spark, money.display("1234.565D", "'USD'")) == "$ 1,234.57"
    assert float(value(spark, money.convert("10.123456785D", "1D"))) == pytest.approx(10.12345679)
    rows = spark.createDataFrame([(1.0, "USD"), (2.0, "EUR")], "a double, c string")
    assert rows.selectExpr(f"{money.guarded_sum('a', 'c')} AS x").head()[0] is None
    with pytest.raises(Exception, match="cannot mix"):
        rows.selectExpr(f"{money.strict_sum('a', 'c')} AS x").collect()


def test_finite(spark):
    rows = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.selectExpr(f"{s.finite('v')} AS x").collect()] == [1.5, None, None, None, None]
