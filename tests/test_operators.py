"""DataFrame operators on small hand-written tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiframe import functions as X
from kpiframe import operators as O


def rows(df, *order):
    if order:
        df = df.orderBy(*order)
    return [tuple(r) for r in df.collect()]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7)],
                               ["RHCC Target (clinical)", "rhcc1.1", "Actual number of male CHWs trained",
                                "% done", "x", "X", "2nd"])
    assert O.clean_names(df).columns == [
        "rhcc_target_clinical", "rhcc1_1", "actual_number_of_male_ch_ws_trained",
        "percent_done", "x", "x_2", "x2nd"]
    accented = spark.createDataFrame([(1, 2)], ["Número de CHWs", "Província"])
    assert O.clean_names(accented).columns == ["numero_de_ch_ws", "provincia"]


def test_column_selectors(report):
    assert O.cols_matching(report, "REFERRED") == ["diarrhoea_referred_5_female", "malaria_referred_5yrs"]
    assert O.cols_between(report, "stock_a", "diarrhoea_5_female") == ["stock_a", "stock_n",
                                                                        "diarrhoea_5_female"]
    assert "period" not in O.select_except(report, ["period"]).columns
    r = O.rename_select(report, ["facility", "district"], {"facility": "site"})
    assert r.columns == ["site", "district"]


def test_filters(report):
    assert O.not_null(report, "stock_a").count() == 3
    assert O.not_null(report, X.safe_ratio("stock_a", "stock_n")).count() == 2  # 0.5/0 → NULL
    kept = O.exclude_values(report, "facility", ["no D1 District"])
    assert kept.count() == 5
    assert O.matches(report, "facility", "^F").count() == 3
    assert O.filter_equals(report, "district", "D2").count() == 2
    assert O.complete_rows(report).count() == 1


def test_exclude_values_drops_missing(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "f string")
    assert rows(O.exclude_values(df, "f", ["b"])) == [("a",)]


def test_range_censor_keeps_row(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (100.0,), (101.0,), (None,)], "p double")
    assert [r[0] for r in O.range_censor(df, "p", 0, 100).collect()] == [None, 0.0, 50.0, 100.0, None, None]


def test_to_long_variants(report):
    long = O.to_long(report, ["district", "facility"], ["stock_a", "stock_n"], "stat", "v")
    assert long.count() == 12                        # NULLs kept, as pivot_longer does
    pat = O.to_long(report, ["facility"], None, "stat", "v", name_pattern="referred")
    assert {r[0] for r in pat.select("stat").distinct().collect()} == {
        "diarrhoea_referred_5_female", "malaria_referred_5yrs"}
    pre = O.to_long(report, ["facility"], ["stock_a", "stock_n"], "item", "v",
                    names_prefix="stock_", drop_na=True)
    assert {r[0] for r in pre.select("item").distinct().collect()} == {"a", "n"}
    assert pre.count() == 7                          # 3 present stock_a + 4 present stock_n


def test_part_remainder(spark):
    df = spark.createDataFrame([("DRC", 15.0)], "adm0 string, v double")
    assert rows(O.part_remainder(df, "adm0", "v"), "part") == [("DRC", "remainder", 85.0),
                                                                ("DRC", "value", 15.0)]


def test_left_join_nullsafe_matches_null(spark):
    left = spark.createDataFrame([("a", None, 1.0), ("b", "x", 2.0), ("c", "y", 3.0)], "k1 string, k2 string, v double")
    right = spark.createDataFrame([("a", None, 10.0), ("b", "x", 20.0), ("b", "x", 21.0)], "k1 string, k2 string, w double")
    out = rows(O.left_join_nullsafe(left, right, ["k1", "k2"]), "k1", "w")
    assert out == [("a", None, 1.0, 10.0), ("b", "x", 2.0, 20.0), ("b", "x", 2.0, 21.0), ("c", "y", 3.0, None)]
    assert O.inner_join_nullsafe(left, right, ["k1", "k2"]).count() == 3


def test_lookup_by_pattern_operator(spark):
    df = spark.createDataFrame([("Kasama District",), ("Chisamba",), (None,)], "district string")
    out = O.lookup_by_pattern(df, "district", [("Kasama", 747.0), ("Chisamba", 346.0)], "target")
    assert [r.target for r in out.collect()] == [747.0, 346.0, None]


def test_group_aggregates(report):
    s = dict((r[0], r[1]) for r in O.sum_by(report, "district", ["stock_a"]).collect())
    assert s == {"D1": 9.5, "D2": 0.0}             # all-missing group sums to 0
    c = dict(O.count_by(report, "district").collect())
    assert c == {"D1": 4, "D2": 2}
    k = dict(O.count_if_by(report, "district", {"k": F.col("stock_a") < 1}).collect())
    assert k == {"D1": 2, "D2": 0}                  # NULL < 1 is not counted


def test_with_total_single_pass(report):
    out = rows(O.with_total(report, ["district"], {"n": F.count(F.lit(1))}, label="All"), "district")
    assert out == [("All", 6), ("D1", 4), ("D2", 2)]


def test_ratio_of_sums_zero_denominator(report):
    out = dict((r[0], r[3]) for r in O.ratio_of_sums(report, "district", "actual_reports",
                                                     "expected_reports", "c").collect())
    assert out == {"D1": 0.92, "D2": None}


def test_share_without(report):
    filled = report.fillna(0)
    out = O.share_without(filled, "district", {"a": F.col("stock_a") < 1}).orderBy("district").collect()
    assert tuple(out[0]) == ("D1", 4, 3, 75.0, 25.0)   # NULL→0, 0 and 0.5 are below 1
    assert tuple(out[1]) == ("D2", 2, 2, 100.0, 0.0)


def test_histogram_reference_rule(spark):
    # values 0..12: width 12/19, first edge -6/19, 20 bins incl. empty ones
    df = spark.createDataFrame([(float(z),) for z in [0, 1, 1, 2, 3, 5, 5, 5, 8, 12]], "z double")
    h = O.histogram(df, "z", 20).orderBy("bin").collect()
    assert len(h) == 20
    w = 12 / 19
    assert abs(h[0].lower - (-6 / 19)) < 1e-12 and abs(h[0].upper - (-6 / 19 + w)) < 1e-12
    assert sum(r["count"] for r in h) == 10
    assert {r.bin: r["count"] for r in h if r["count"]} == {1: 1, 3: 2, 4: 1, 6: 1, 9: 3, 14: 1, 20: 1}


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "z double")
    h = O.histogram(df, "z", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 0, 0, 0, 0]


def test_windows(panel):
    first = rows(O.first_per_group(panel.select("adm0", "date", "rhcc6"), "adm0", "date"), "adm0")
    assert [r[1] for r in first] == [dt.date(2020, 1, 1)] * 4
    last = rows(O.last_per_group(panel.select("adm0", "date", "rhcc6"), "adm0", "date"), "adm0")
    assert [r[1] for r in last] == [dt.date(2020, 4, 1)] * 4
    lp = dict((r[0], r[2]) for r in O.last_present(panel.select("adm0", "date", "rhcc6"),
                                                   "adm0", "date", "rhcc6").collect())
    assert lp == {"DRC": 15.0, "MOZ": 50.0, "NGA": 70.0, "ZMB": 35.0}
    n = O.number_within(O.not_null(panel, "rhcc16"), "adm0", "date", "survey")
    assert rows(n.filter(F.col("adm0") == "DRC").select("rhcc16", "survey"), "survey") == [(50.0, 1), (60.0, 2)]
    gs = dict(O.group_size(O.not_null(panel, "rhcc16"), "adm0").select("adm0", "n").distinct().collect())
    assert gs == {"DRC": 2, "MOZ": 2, "NGA": 2, "ZMB": 1}


def test_windows_need_order(panel):
    with pytest.raises(ValueError):
        O.number_within(panel, "adm0", [], "s")


def test_stack_offsets(spark):
    df = spark.createDataFrame([("DRC", 1, 15.0), ("DRC", 2, 85.0)], "adm0 string, o int, v double")
    out = rows(O.stack_offsets(df, "adm0", F.col("o").desc(), "v", "pos"), "o")
    assert [r[3] for r in out] == [92.5, 42.5]


def test_entity_page(spark):
    df = spark.createDataFrame([(k, i) for k in "EDCBA" for i in range(2)], "k string, i int")
    p1 = rows(O.entity_page(df, "k", 2, 1).select("k", "panel").distinct(), "k")
    p2 = rows(O.entity_page(df, "k", 2, 2).select("k", "panel").distinct(), "k")
    assert p1 == [("A", 1), ("B", 2)] and p2 == [("C", 1), ("D", 2)]


def test_append_and_head(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(O.append(a, b, a), "i") == [(1, "x"), (1, "x"), (2, "y")]
    c = spark.createDataFrame([(1,)], "i int")
    with pytest.raises(Exception):
        O.append(a, c).collect()
    assert [r.i for r in O.head_rows(spark.range(100).select(F.col("id").alias("i")), 6, [F.col("i").desc()]).collect()] == [99, 98, 97, 96, 95, 94]


def test_tag(spark):
    df = O.tag(spark.range(2), "district", "Kasama")
    assert {r.district for r in df.collect()} == {"Kasama"}


def test_number_within_chunked_equals_window_with_hot_key(spark):
    # one key holds ~1/2 of the rows; distinct order values per group
    hot = spark.range(20000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 20011).alias("t"))
    cold = spark.range(3000).select((F.col("id") % 50).cast("string").alias("g"),
                                    (F.col("id") * 13).alias("t"))
    nulls = spark.range(5).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("t"))
    df = hot.unionByName(cold).unionByName(nulls)
    plain = O.number_within(df, "g", "t", "rn")
    chunked = O.number_within(df, "g", "t", "rn", chunks=16)
    assert chunked.columns == plain.columns
    assert chunked.exceptAll(plain).count() == 0 and plain.exceptAll(chunked).count() == 0
    # the hot group is spread over several window partitions
    assert chunked.filter(F.col("g") == "hot").agg(F.max("rn")).first()[0] == 20000


def test_number_within_chunked_dates(panel):
    plain = O.number_within(O.not_null(panel, "rhcc16"), "adm0", "date", "survey")
    chunked = O.number_within(O.not_null(panel, "rhcc16"), "adm0", "date", "survey", chunks=3)
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, plain.collect()))


def test_with_total_many_keys_and_null_group(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), (None, "x", 4.0)],
                               "k1 string, k2 string, v double")
    out = rows(O.with_total(df, ["k1", "k2"], {"s": F.sum("v")}, label="All"), "k1", "k2")
    # the NULL group stays a group; only the grand total gets the label
    assert out == [(None, "x", 4.0), ("All", None, 7.0), ("a", "x", 1.0), ("a", "y", 2.0)]


def test_last_per_group_with_map_column(spark):
    df = spark.createDataFrame([("a", 1, {"k": 1}), ("a", 2, {"k": 2}), ("b", 5, {"k": 5})],
                               "g string, t int, m map<string,int>")
    out = {r.g: (r.t, r.m) for r in O.last_per_group(df, "g", "t").collect()}
    assert out == {"a": (2, {"k": 2}), "b": (5, {"k": 5})}


def test_full_join_nullsafe_keeps_keys_of_both_sides(spark):
    left = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, v double")
    right = spark.createDataFrame([(None, 20.0), ("z", 30.0)], "k string, w double")
    out = sorted(map(tuple, O.left_join_nullsafe(left, right, "k", how="full").collect()), key=str)
    assert out == sorted([("a", 1.0, None), (None, 2.0, 20.0), ("z", None, 30.0)], key=str)


def test_right_join_nullsafe_spellings(spark):
    left = spark.createDataFrame([("a", 1.0)], "k string, v double")
    right = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "k string, w double")
    for how in ("right", "right_outer", "rightouter"):
        out = sorted(map(tuple, O.left_join_nullsafe(left, right, "k", how=how).collect()))
        assert out == [("a", 1.0, 10.0), ("b", None, 20.0)]


def test_histogram_single_bin(spark):
    df = spark.createDataFrame([(2.0,), (5.0,), (9.0,)], "z double")
    h = O.histogram(df, "z", 1).collect()
    assert [(r.bin, r.lower, r.upper, r["count"]) for r in h] == [(1, 2.0, 9.0, 3)]


def test_number_within_splits_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("g"),
                                  (F.col("id") % 11).alias("t"), F.col("id").alias("u"))
    split = O.number_within(df, "g", ["t", "u"], "rn")
    plain = O.number_within(df, "g", ["t", "u"], "rn", bounded=True)
    assert sorted(split.collect(), key=str) == sorted(plain.collect(), key=str)


def test_with_total_key_types_and_flag(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 5.0)], "k int, v double")
    out = {(r.k, r.s, r.total) for r in O.with_total(df, "k", {"s": F.sum("v")}, flag="total").collect()}
    assert out == {("1", 5.0, False), (None, 5.0, False), ("Total", 10.0, True)}
    summed = {(r.k, r.s) for r in O.with_total_sum(df, "k", {"s": F.sum("v")}).collect()}
    assert summed == {("1", 5.0), (None, 5.0), ("Total", 10.0)}


def test_exclude_nothing_still_drops_missing(spark):
    df = spark.createDataFrame([("a",), (None,)], "u string")
    assert [r.u for r in O.exclude_values(df, "u", ()).collect()] == ["a"]


def test_histogram_leaves_out_non_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (nan,), (inf,), (-inf,), (None,)], "x double")
    got = [(r.bin, r.lower, r.upper, r["count"]) for r in O.histogram(df, "x", 3).orderBy("bin").collect()]
    assert got == [(1, -0.5, 0.5, 1), (2, 0.5, 1.5, 1), (3, 1.5, 2.5, 1)]


def test_lookup_by_rules_first_match_any_size(spark, monkeypatch):
    from kpiframe.operators import joins

    monkeypatch.setattr(joins, "RULES_PER_BLOCK", 2)
    rules = spark.createDataFrame(
        [("Chisamba", 346.0, 2), ("Kasama", 747.0, 1), ("x{3}", 9.0, 5), ("^C", 1.0, 7), (None, 0.0, 0)],
        "pattern string, target double, priority int")
    df = spark.createDataFrame([("Kasama Chisamba",), ("Chongwe",), ("Chisamba",), ("none",), (None,)],
                               "d string")
    out = {r.d: r.t for r in O.lookup_by_rules(df, "d", rules, "t").collect()}
    assert out == {"Kasama Chisamba": 747.0, "Chongwe": 1.0, "Chisamba": 346.0, "none": None, None: None}
    empty = O.lookup_by_rules(df, "d", rules.limit(0), "t").collect()
    assert len(empty) == 5 and all(r.t is None for r in empty)


def test_level_number(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted((r.c or "", r.level) for r in O.level_number(df, "c").collect()) == [
        ("", None), ("a", 1), ("b", 2), ("b", 2)]
