from pyspark.sql import functions as F

from brickledger.functions import scalar as sc


def _values(spark, values, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_commute_bands_edges(spark):
    assert _values(spark, [5, 15, 16, 30, 75, 76, None], "int", sc.commute_band("x")) == [
        "0–15 min", "0–15 min", "16–30 min", "16–30 min", "61–75 min", "75+ min", "75+ min"]


def test_commute_cut_is_left_open(spark):
    assert _values(spark, [0, 1, 15, 16, 75, 76, 120, 121, None], "int", sc.commute_cut("x")) == [
        None, "0–15", "0–15", "16–30", "61–75", "75+", "75+", None, None]


def test_error_bands_edges(spark):
    assert _values(spark, [5.0, -5.0, 5.1, 10.0, -10.1, 20.0, -20.0, 20.1, -20.1, None], "double", sc.error_band("x")) == [
        "Within ±5%", "Within ±5%", "Within ±10%", "Within ±10%", "Within ±20%", "Within ±20%", "Within ±20%",
        "Overestimate >20%", "Underestimate >20%", "Underestimate >20%"]


def test_importance_and_chart_classes(spark):
    values = [20.0, 19.99, 15.0, 15.1, 10.0, 5.0, 5.1, 1.0, 0.99]
    assert _values(spark, values, "double", sc.importance_band("x")) == [
        "Critical", "High", "High", "High", "High", "Medium", "Medium", "Low", "Minimal"]
    assert _values(spark, values, "double", sc.chart_class("x"))[2:7] == [
        "High (5–15%)", "Critical (>15%)", "High (5–15%)", "Medium (<5%)", "High (5–15%)"]


def test_rounding_modes_and_guards(spark):
    halves = [0.5, 1.5, 2.5, -0.5, -2.5]
    assert _values(spark, halves, "double", sc.half_up(F.col("x"))) == [1.0, 2.0, 3.0, -1.0, -3.0]
    assert [abs(v) for v in _values(spark, halves, "double", sc.half_even(F.col("x")))] == [0.0, 2.0, 2.0, 0.0, 2.0]
    assert _values(spark, [2, 0, None], "int", sc.ratio(F.lit(1), F.col("x"))) == [0.5, None, None]
    assert _values(spark, [1, 60, 500], "int", sc.clamp(F.col("x"), 5, 120)) == [5, 60, 120]


def test_texts(spark):
    assert _values(spark, ["log_dist_centre", "bedrooms"], "string", sc.pretty_label(F.col("x"))) == ["Log Dist Centre", "Bedrooms"]
    assert _values(spark, [482000.0, 152500.0], "double", sc.thousands_text(F.col("x"))) == ["£482k", "£152k"]
    assert _values(spark, [1234567.5], "double", sc.pounds_text(F.col("x"))) == ["£1,234,568"]


def test_lookup_misses_and_unknown_keys(spark):
    assert _values(spark, ["a", "z", None], "string", sc.decode("x", {"a": 1})) == [1, None, None]
    assert _values(spark, ["a", "z", None], "string", sc.decode("x", {"a": 1}, 9)) == [1, 9, 9]


def test_age_bands(spark):
    assert _values(spark, [1899, 1900, 1944, 1945, 1999, 2000, 2014, 2015, None], "int", sc.age_band("x")) == [
        "Pre-1900", "1900-1945", "1900-1945", "1945-1975", "1975-2000", "2000-2015", "2000-2015", "Post-2015", None]
