"""Cleaning, transformations, binning, currency and profiles."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import currency, names
from tablewright.functions.arithmetic import arithmetic
from tablewright.operators import binning, categories, cleaning, matching, money, profile, projection, quantiles
from tablewright.plans.registry import TRANSFORMATIONS, Registry, Transformation
from tablewright.plans.steps import full_clean, run_steps


def test_fill_mean(spark, rows):
    df = spark.createDataFrame([("a", 25.0), ("b", None), ("c", 35.0)], "Name string, Age double")
    assert rows(cleaning.fill_missing(df, "mean", ["Age"]), "Age") == [(25.0,), (30.0,), (35.0,)]


def test_steps_go_on_after_a_bad_one(spark, rows):
    df = spark.createDataFrame([(1, 50000.0), (1, 50000.0), (2, None), (3, 80000.0)], "id long, salary double")
    run = run_steps(df, [{"op": "fill_nulls", "column": "salary", "method": "median"}, {"op": "fill_nulls", "column": "nothing"}, {"op": "what"},
                         {"op": "convert_currency", "column": "salary", "rate": 83.5, "to": "INR"}, {"op": "remove_duplicates", "subset": ["id"]}])
    assert rows(run.table, "id", "salary_INR") == [(1, 4175000.0), (2, 4175000.0), (3, 6680000.0)]
    report = [(r.status, r.rows_before, r.rows_after, r.cells_filled) for r in run.report().orderBy("step").collect()]
    assert report == [("done", 4, 4, 1), ("skipped", 4, 4, 0), ("skipped", 4, 4, 0), ("done", 4, 4, 0), ("done", 4, 3, 0)]
    assert df.count() == 4  # the input is untouched


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Customer Name` int, `Sale $ Amount` int, `Report-Date` int, `Status (Active/Inactive)` int")
    assert projection.standardise_names(df).columns == ["customer_name", "sale_amount", "report_date", "status_activeinactive"]
    assert names.unique_headers(["a", " ", "a", None, "a"]) == ["a", "Unnamed_2", "a_2", "Unnamed_4", "a_3"]
    assert projection.clean_headers(df.toDF(" Full Name ", "B", "C", "D")).columns[0] == "full_name"


def test_drop_cancelled(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "cancelled"), (3, None)], "order_id long, status string")
    assert run_steps(df, [{"op": "filter_rows", "column": "status", "operator": "not_equals", "value": "cancelled"}]).table.count() == 2


def test_full_clean_is_idempotent(spark, rows):
    data = [("A", " x  y ", "2024-01-15", 1.0), ("A", " x  y ", "2024-01-15", 1.0), ("B", None, "01/15/2024", None), ("C", "z", "2024-02-01", 3.0)]
    df = spark.createDataFrame(data, "`Full Name` string, note string, day string, v double")
    once = full_clean(df).table
    assert once.columns == ["full_name", "note", "day", "v"] and once.schema["day"].dataType.typeName() == "timestamp"
    assert rows(full_clean(once).table) == rows(once) and once.count() == 3


@pytest.mark.parametrize("keep,expected", [("first", [(1, "a"), (2, "c")]), ("last", [(1, "b"), (2, "c")]), (False, [(2, "c")])])
def test_dedup(spark, rows, keep, expected):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    assert rows(cleaning.remove_duplicates(df, ["id"], keep, ["v"])) == expected


def test_outliers_cap_remove_mark(spark):
    df = spark.createDataFrame([("p", v, q) for v, q in [(100, 11), (101, 10), (99, 12), (9999, 11), (100, 150), (102, 11), (98, 10), (100, 12)]], "Product string, Price long, Quantity long")
    assert cleaning.cap_outliers(df).agg(F.max("Price")).first()[0] < 200
    assert cleaning.remove_outliers(df).count() == 6
    assert cleaning.remove_outliers(df, sequential=True).count() <= 6
    assert cleaning.mark_outliers(df).filter("Price_is_outlier or Quantity_is_outlier").count() == 2


def test_forward_fill_keeps_leading_gaps(spark, rows):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, "a"), (3, None, None)], "t int, s double, w string")
    assert rows(cleaning.forward_fill(df, ["t"])) == [(1, None, "Unknown"), (2, 1.0, "a"), (3, 1.0, "a")]


def test_blank_to_null(spark, rows):
    df = spark.createDataFrame([(" a ",), ("​  ",), ("",), (None,)], "v string")
    assert rows(cleaning.blank_to_null(df)) == [("a",), (None,), (None,), (None,)]


def test_kinds(spark):
    data = [("25", "50000.00", "2023-01-15", "on"), ("30", "x", "2023-02-15", "off")]
    kinds = cleaning.column_kinds(spark.createDataFrame(data, "Age string, Salary string, JoinDate string, Status string"))
    assert kinds == {"Age": "numeric", "Salary": "categorical", "JoinDate": "datetime", "Status": "categorical"}


def test_registry():
    registry = Registry()
    entry = registry.register(Transformation("same", lambda d, p: d))
    with pytest.raises(ValueError):
        registry.register(entry)
    with pytest.raises(KeyError):
        registry.get("other")


def test_transformations_leave_the_input_alone(spark):
    df = spark.createDataFrame([(1, "a-b-c"), (2, "d")], "id long, v string")
    out = TRANSFORMATIONS.run(df, "split_column", {"column": "v", "delimiter": "-"})
    assert out.columns == ["id", "v", "v_part1", "v_part2", "v_part3"] and df.columns == ["id", "v"]
    assert TRANSFORMATIONS.get("merge_columns").preview(df, {"columns": ["id", "v"], "separator": ":"}, 1).count() == 1
    with pytest.raises(ValueError):
        TRANSFORMATIONS.run(df, "drop_columns", {"columns": ["id", "v"]})
    with pytest.raises(ValueError):
        TRANSFORMATIONS.run(df, "rename_columns", {"mapping": {"id": "v"}})


def test_schema_changes(spark, rows):
    before = spark.createDataFrame([(1, "a")], "a int, b string").schema
    after = spark.createDataFrame([(1.0, "a")], "a double, c string").schema
    assert rows(names.schema_changes(spark, before, after), "column", "change") == [("a", "retyped"), ("b", "removed"), ("c", "added")]


def test_arithmetic(spark):
    df = spark.createDataFrame([(6.0, 0.0)], "`unit price` double, n double")
    values = df.select(arithmetic("unit price * (2 + 1) - 1", df.columns).alias("a"), arithmetic("unit price / n", df.columns).alias("b")).first()
    assert tuple(values) == (17.0, None)
    for bad in ("__import__('os')", "n ** 2", "missing + 1", "n +"):
        with pytest.raises(ValueError):
            arithmetic(bad, df.columns)


# ---- binning ----------------------------------------------------------------


@pytest.mark.parametrize("values,ranges,expected", [
    ([0.4, 1.6, 2.8, 3.9, 4.8], ["0-1", "1-2", "2-3", "3-4", "4-5"], ["0-1", "1-2", "2-3", "3-4", "4-5"]),
    ([0.3, 0.9, 1.5, 2.75, 3.95], ["0.0-1.0", "1.0-2.0", "2.0-3.0", "3.0-4.0"], ["0.0-1.0", "0.0-1.0", "1.0-2.0", "2.0-3.0", "3.0-4.0"]),
    ([-60.0, -45.0, -20.0, -5.0, 0.0, 5.0, 20.0], ["-50--10", "-10-0", "0-10"], ["Out of Range", "-50--10", "-50--10", "-10-0", "-10-0", "0-10", "Out of Range"]),
    ([15.0, 19.0, 20.0, 25.0, 60.0], ["0-19", "20+"], ["0-19", "0-19", "20+", "20+", "20+"]),
    ([10.0, 49.0, 50.0, 99.0, 100.0, 150.0], ["below 50", "50-100", "above 100"], ["below 50", "below 50", "50-100", "50-100", "50-100", "above 100"]),
])
def test_bins(spark, values, ranges, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.v_Range for r in binning.bin_column(df, "v", ranges).orderBy("i").collect()] == expected


@pytest.mark.parametrize("ranges", [["0-10", "5-15"], ["10-20", "0-10"], ["cheap"], ["9-3"]])
def test_bad_ranges(spark, ranges):
    with pytest.raises(ValueError):
        binning.bin_column(spark.createDataFrame([(1.0,)], "v double"), "v", ranges)


def test_bad_bin_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, v double")
    for column in ("t", "none"):
        with pytest.raises(ValueError):
            binning.bin_column(df, column, ["0-1"])
    with pytest.raises(ValueError):
        binning.auto_ranges(df, "v")


def test_auto_ranges(spark):
    df = spark.createDataFrame([(0.0,), (100.0,)], "v double")
    assert binning.auto_ranges(df, "v") == ["0-20", "20-40", "40-60", "60-80", "80-100"]
    twice = binning.bin_column(binning.bin_column(df, "v"), "v")
    assert twice.columns == ["v", "v_Range", "v_Range_2"]


# ---- currency and categories -------------------------------------------------


@pytest.mark.parametrize("text,code,amount,shown", [
    ("$1250", "USD", 1250.0, "USD 1250.00"), ("Aed 150", "AED", 150.0, "AED 150.00"), ("Rubel 2500", "RUB", 2500.0, "RUB 2500.00"),
    ("INR 1,250.5", "INR", 1250.5, "₹1,250.50"), ("S$ 3", "SGD", 3.0, "SGD 3.00"), ("US$ 7", "USD", 7.0, "USD 7.00"), ("12", None, 12.0, "12"), ("nothing", None, None, "nothing"),
])
def test_currency(spark, text, code, amount, shown):
    c = F.col("v")
    row = spark.createDataFrame([(text,)], "v string").select(currency.currency_code(c), currency.amount(c), currency.standard_amount(c)).first()
    assert tuple(row) == (code, amount, shown)


def test_missing_rate_is_counted(spark, rows):
    df = spark.createDataFrame([(1.0, "USD", "INR"), (2.0, "XYZ", "INR"), (3.0, "INR", "INR")], "v double, a string, b string")
    rates = spark.createDataFrame([("USD", "INR", 80.0)], "`from` string, `to` string, rate double")
    done = money.convert_by_rates(df, "v", "a", "b", rates, "x")
    assert rows(done, "v", "x") == [(1.0, 80.0), (2.0, None), (3.0, 3.0)]
    assert rows(money.unconverted(done, "a", "b", "x")) == [("XYZ", "INR", 1)]


@pytest.mark.parametrize("kind,values,expected", [
    ("boolean", ["Yes", "No", "Y", "N", "yess", "NOOO", "1", "0", None], ["Yes", "No", "Yes", "No", "Yes", "No", "Yes", "No", "Unknown"]),
    ("gender", ["F", "Female", "Femalee", "M", "m", "Male", "T", "female"], ["Female"] * 3 + ["Male"] * 3 + ["Transgender", "Female"]),
    ("country", ["India", "india", "Idnia", "Uae", "Arab", "Atlantis", ""], ["India"] * 3 + ["United Arab Emirates"] * 2 + ["Atlantis", "Unknown"]),
])
def test_categories(spark, kind, values, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r.v_standard for r in categories.standardise(df, {"v": kind}).orderBy("i").collect()] == expected


def test_equally_near_names_match_nothing(spark):
    token = spark.createDataFrame([("cab",), ("cat",), ("zzzzz",)], "v string").select(categories.fuzzy(F.col("v"), {"x": "X"}, ["Car", "Can", "Cat"]))
    assert [r[0] for r in token.collect()] == [None, "Cat", None]


def test_places(spark, rows):
    places = spark.createDataFrame([("Kolkata", "West Bengal", "India", 22.5726, 88.3639), ("Springfield", "Illinois", "USA", 39.8, -89.6),
                                    ("Springfield", "Ohio", "USA", 39.9, -83.8)], "city string, region string, country string, latitude double, longitude double")
    df = spark.createDataFrame([(1, None, None, 22.5726, 88.3639, None), (2, "springfield", None, None, None, None), (3, "Springfield", None, None, None, "Ohio"),
                                (4, None, None, 95.0, 10.0, None)], "LocationID long, City string, Country string, Latitude_Center double, Longitude_Center double, Region string")
    columns = names.location_columns(df.columns)
    assert columns == {"city": "City", "country": "Country", "region": "Region", "latitude": "Latitude_Center", "longitude": "Longitude_Center", "location_id": "LocationID"}
    columns.pop("location_id")
    done = matching.fill_places(df, columns, places)
    assert rows(done, "LocationID", "City", "Region", "Country", "cells_filled") == [
        (1, "Kolkata", "West Bengal", "India", 3), (2, "springfield", None, None, 0), (3, "Springfield", "Ohio", "USA", 3), (4, None, None, None, 0)]


def test_nearest_place_equals_brute_force(spark):
    rng = random.Random(5)
    spots = [(f"c{i}", "r", "n", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(400)] + [("pole", "r", "n", 89.9, 10.0), ("line", "r", "n", 0.0, 179.99)]
    places = spark.createDataFrame(spots, "city string, region string, country string, latitude double, longitude double")
    asked = [(rng.uniform(-89.5, 89.5), rng.uniform(-180, 180)) for _ in range(300)] + [(89.95, -170.0), (0.0, -179.99)]
    points = spark.createDataFrame(asked, "latitude double, longitude double")
    near = {(r.latitude, r.longitude): r.place.city for r in matching.nearest_places(points, places, 300.0).collect()}
    joined = points.crossJoin(places.withColumnsRenamed({"latitude": "la", "longitude": "lo"}))
    km = matching.distance_km(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    brute = joined.withColumn("km", km).groupBy("latitude", "longitude").agg(F.min_by("city", "km").alias("c"), F.min("km").alias("k")).filter("k <= 300")
    assert near == {(r.latitude, r.longitude): r.c for r in brute.collect()} and len(near) > 50


# ---- profiles ----------------------------------------------------------------


def test_profile(spark, rows):
    df = spark.createDataFrame([(1, 10.5, "a"), (2, 20.0, "b"), (3, None, "a"), (4, 15.5, "a"), (4, 15.5, "a")], "id long, amount double, category string")
    assert rows(profile.duplicate_counts(df)) == [(5, 1, 2)]
    assert rows(profile.missing(df)) == [("amount", 1, 20.0), ("category", 0, 0.0), ("id", 0, 0.0)]
    assert rows(profile.categorical_stats(df)) == [("category", 4, 2, "a", 3)]
    assert rows(profile.describe(df, ["amount"]), "count", "mean", "median") == [(4, 15.375, 15.5)]
    one = spark.createDataFrame([(7.0,)], "v double")
    assert rows(profile.describe(one), "std", "q1") == [(0.0, 7.0)]
    assert rows(profile.describe(one.filter("v < 0")), "count", "std", "q1") == [(0, None, None)]


def test_quality_score(spark, rows):
    clean = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02")], "id long, date string")
    assert rows(profile.quality_score(clean), "quality_score", "quality_grade") == [(100.0, "Excellent")]
    messy = spark.createDataFrame([(1, "2026-01-01", 100, None), (2, "bad-date", 200, None), (2, "bad-date", 200, None), (3, "2026-01-04", 200, None)],
                                  "id long, date string, amount long, empty string")
    assert rows(profile.quality_score(messy), "quality_score", "quality_grade", "missing_cells", "duplicated_rows", "invalid_dates", "empty_columns") == [
        (62.5, "Fair", 4, 2, 2, 1)]
    blank = spark.createDataFrame([(" ",), ("x",)], "v string")
    assert rows(profile.quality_score(blank), "missing_cells") == [(1,)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    found = {(r.column_a, r.column_b): r.correlation for r in profile.correlation(df).collect()}
    assert found["a", "b"] == 1.0 and found["b", "a"] == 1.0 and found["a", "c"] is None and len(found) == 9


def test_quantiles_by_narrowing_are_exact(spark, monkeypatch):
    rng = random.Random(1)
    values = [7.0 if i % 3 == 0 else rng.random() ** 6 * 100 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for name, value in (("LIST_ROWS", 5), ("ACCURACY", 50), ("SLACK", 0.04)):
        monkeypatch.setattr(quantiles, name, value)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    exact = df.selectExpr(f"percentile(v, array({', '.join(map(str, wanted))}))").first()[0]
    assert quantiles.quantiles(df, ["v"], wanted, direct_rows=10)["v"] == pytest.approx(exact, abs=1e-12)


def test_modes_take_the_smallest_number_on_ties(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b")], "n int, t string")
    assert cleaning.modes(df, ["n", "t"]) == {"n": "9", "t": "a"}


def test_change_counts(spark, rows):
    before = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, v string, w string")
    after = spark.createDataFrame([(1, "a", None), (2, "B", "x"), (3, "c", None)], "id int, v string, w string")
    assert rows(cleaning.change_counts(before, after, ["id"])) == [("(any column)", 2), ("v", 1), ("w", 1)]
