"""Column expressions and the missing-value / rounding rules."""

import datetime as dt

from pyspark.sql import functions as F

from kpiframe import functions as X


def one(df):
    return [tuple(r) for r in df.collect()]


def test_round_even_and_percent(spark):
    df = spark.createDataFrame([(1.0, 8.0), (23.0, 40.0), (1.0, 0.0), (None, 3.0), (5.0, 2.0)],
                               "n double, d double")
    out = df.select(X.percent_of("n", "d", 2).alias("p"), X.proportion_of("n", "d", 2).alias("q"),
                    X.percent_of("n", "d", 0).alias("w"), X.round_even("n", 0).alias("r"))
    rows = one(out)
    assert rows[0] == (12.5, 0.12, 12.0, 1.0)       # 0.125 → 0.12 (half to even)
    # 23/40*100 is 57.49999999999999 as a double: rounds to 57 (as in R)
    assert rows[1][0] == 57.5 and rows[1][1] == 0.57 and rows[1][2] == 57.0
    assert rows[2] == (None, None, None, 1.0)       # zero denominator → NULL, not an error
    assert rows[3][:3] == (None, None, None)
    assert rows[4][2] == 250.0


def test_rint_ties(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(X.round_even("x", 0)).collect()] == [0.0, 2.0, 2.0, -0.0]


def test_sum_na_all_missing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), ("b", None)], "g string, x double")
    got = dict(df.groupBy("g").agg(X.sum_na("x").alias("s")).collect())
    assert got == {"a": 0.0, "b": 2.0}


def test_if_else_keeps_missing_condition(spark):
    df = spark.createDataFrame([("Yes", 3.0), ("No", 3.0), (None, 3.0), ("Yes", None)],
                               "f string, n double")
    got = [r[0] for r in df.select(X.if_else(F.col("f") == "Yes", F.col("n"), 0.0)).collect()]
    assert got == [3.0, 0.0, None, None]


def test_regex_flag_false_on_null(spark):
    df = spark.createDataFrame([("Kasama",), (None,), ("Other",)], "s string")
    assert [r[0] for r in df.select(X.regex_flag("s", "Kas")).collect()] == [True, False, False]


def test_classify_first_match_and_default(spark):
    df = spark.createDataFrame([("x_female_5",), ("x_male_5",), ("malaria_5yrs",), (None,)], "s string")
    out = df.select(X.classify("s", [("_female", "Female"), ("_male", "Male")], default="Combined"),
                    X.classify("s", [("malaria", "Malaria"), ("female", "F")]))
    assert one(out) == [("Female", "F"), ("Male", None), ("Combined", "Malaria"), ("Combined", None)]


def test_lookup_by_pattern_first_rule_wins(spark):
    df = spark.createDataFrame([("NATION_1",), ("NATION_12",), ("NATION_2",), ("NATION_3",)], "d string")
    rules = [("NATION_1$", 70.0), ("NATION_1", 60.0), ("NATION_2", 40.0)]
    assert [r[0] for r in df.select(X.lookup_by_pattern("d", rules)).collect()] == [70.0, 60.0, 40.0, None]


def test_recode_and_category_order(spark):
    df = spark.createDataFrame([("amoxyl",), ("ors",), ("zinc",), (None,)], "s string")
    out = df.select(X.recode("s", {"ors": "ORS"}), X.category_order("s", ["zinc", "amoxyl", "ors"]))
    assert one(out) == [("amoxyl", 2), ("ORS", 3), ("zinc", 1), (None, None)]


def test_percent_label_and_na_label(spark):
    df = spark.createDataFrame([(57.0,), (None,)], "p double")
    out = df.select(X.percent_label("p"), X.percent_label("p", na_label="NA%"))
    assert one(out) == [("57%", "57%"), (None, "NA%")]


def test_period_parse_every_month(spark):
    df = spark.createDataFrame([("August 2025",), ("July 2025",), ("January 2020",), ("junk",)], "s string")
    got = [r[0] for r in df.select(X.period_parse("s")).collect()]
    assert got == [dt.date(2025, 8, 1), dt.date(2025, 7, 1), dt.date(2020, 1, 1), None]


def test_month_helpers_and_stamp(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 8, 17, 13, 5),)], "t timestamp_ntz")
    r = df.select(X.month_start("t"), X.month_name(X.month_start("t")), X.report_stamp()).first()
    assert r[0] == dt.date(2025, 8, 1) and r[1] == "August 2025"
    assert r[2] == dt.date.today().strftime("%Y-%b-%d")


def test_row_sum_complement_per_thousand(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 800.0, 360000.0)], "a double, b double, c double, n double, d double")
    r = df.select(X.row_sum("a", "b"), X.row_sum("a", "b", "c"), X.complement(F.lit(12.5)),
                  X.per_thousand("n", "d")).first()
    assert r[0] == 3.0 and r[1] is None and r[2] == 87.5
    assert abs(r[3] - 2.2222222) < 1e-6


def test_percent_label_keeps_decimals(spark):
    df = spark.createDataFrame([(45.7,), (100.0,), (0.25,)], "p double")
    assert [r[0] for r in df.select(X.percent_label("p")).collect()] == ["45.7%", "100%", "0.25%"]
