"""Plans, filters, windows and the smaller query forms on small tables."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions.names import UnknownColumn, resolve
from tablewright.functions.predicates import cleaning_condition, role_condition
from tablewright.operators import ordered, projection
from tablewright.operators.roles import check_conditions
from tablewright.plans import structured
from tablewright.plans.query_plan import run_plan, select_where

SALES = [("North", "Widget", 10, 100.0), ("South", "Gadget", 5, 200.0), ("North", "Widget", 8, 100.0), ("East", "Gizmo", 3, 300.0),
         ("South", "Widget", 12, 100.0), ("West", "Gadget", 6, 200.0), ("East", "Gizmo", 4, 300.0), ("North", "Gizmo", 7, 300.0)]


@pytest.fixture(scope="module")
def sales(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(SALES)], "OrderID long, Region string, Product string, Quantity long, DiscountedPrice double")
    return df.withColumn("Revenue", F.col("Quantity") * F.col("DiscountedPrice"))


def test_revenue_by_region(sales):
    plan = {"group_by": ["region"], "metrics": [{"function": "sum", "column": "revenue", "alias": "Total Revenue"}],
            "order_by": [{"column": "Total Revenue", "direction": "desc"}]}
    assert [tuple(r) for r in run_plan(sales, plan).collect()] == [("North", 3900.0), ("South", 2200.0), ("East", 2100.0), ("West", 1200.0)]


def test_top_product_per_region(sales, rows):
    plan = {"group_by": ["Region", "Product"], "metrics": [{"function": "sum", "column": "Quantity", "alias": "q"}],
            "window": {"type": "rank", "partition_by": ["Region"], "order_by": [{"column": "q", "direction": "desc"}]},
            "keep_top_n_per_partition": 1}
    assert rows(run_plan(sales, plan)) == [("East", "Gizmo", 7, 1), ("North", "Widget", 18, 1), ("South", "Widget", 12, 1), ("West", "Gadget", 6, 1)]


def test_restaurants(spark, rows):
    data = [("Curry House", "Bangalore", 300, 4.2), ("Spice", "Bangalore", 500, 4.4), ("Tandoor", "Delhi", 400, 4.3), ("Chaat", "Mumbai", 200, 3.9)]
    df = spark.createDataFrame(data, "name string, city string, cost long, rating double")
    plan = {"filters": [{"column": "city", "operator": "equals", "value": "Bangalore"}, {"column": "cost", "operator": "less_than_equal", "value": "300"}]}
    assert rows(run_plan(df, plan), "name") == [("Curry House",)]


def test_new_and_returning(spark, rows):
    data = [("Anita", 500), ("Anita", 300), ("Vikram", 700), ("Deepa", 200), ("Deepa", 150), ("Deepa", 400), ("Rohan", 900)]
    df = spark.createDataFrame(data, "CustomerName string, TotalPrice long")
    condition = {"window_function": "count", "partition_by": ["CustomerName"], "operator": "greater_than", "value": 1}
    plan = {"derived_columns": [{"alias": "customer type", "case": {"condition": condition, "then": "Returning", "else": "New"}}],
            "group_by": ["customer_type"], "metrics": [{"function": "sum", "column": "TotalPrice"}]}
    assert rows(run_plan(df, plan)) == [("New", 1600), ("Returning", 1550)]


@pytest.mark.parametrize("plan", [
    {"group_by": ["no such thing"]}, {"metrics": [{"function": "median", "column": "Revenue"}]},
    {"filters": [{"column": "Region", "operator": "like", "value": "x"}]}, {"window": {"type": "running_total"}},
    {"group_by": ["Region"], "keep_top_n_per_partition": 2}, {},
])
def test_bad_plans_raise(sales, plan):
    with pytest.raises(ValueError):
        run_plan(sales, plan)


def test_column_lookup():
    assert resolve("ORDERID", ["OrderID", "x"]) == "OrderID"
    assert resolve("price", ["DiscountedPrice"]) == "DiscountedPrice"
    with pytest.raises(UnknownColumn):
        resolve("zzz", ["a"])


def test_values_are_bound_not_spliced(sales):
    found = select_where(sales, [{"column": "Region", "operator": "equals", "value": "North' OR '1'='1"}])
    assert found.count() == 0
    assert select_where(sales, [{"column": "Product", "operator": "contains", "value": "wid"}]).count() == 3


def test_null_rules_of_the_filter_families(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "v string")
    count = lambda c: df.filter(c).count()
    assert count(cleaning_condition(df, "v", "not_equals", 1)) == 3
    assert count(cleaning_condition(df, "v", "greater_than", 0)) == 2
    assert run_plan(df.withColumn("n", F.col("v").try_cast("int")), {"filters": [{"column": "n", "operator": "not_equals", "value": 1}]}).count() == 1
    flags = spark.createDataFrame([("Yes",), ("no",), ("maybe",), (None,)], "v string")
    both = [flags.filter(role_condition(flags, "boolean_capability", {"column": "v", "operator": op, "value": True})).count() for op in ("equals", "not_equals")]
    assert both == [1, 3]


def test_roles_are_checked():
    with pytest.raises(ValueError):
        check_conditions([{"column": "c1", "operator": "greater_than", "value": 1}], {"c1": "category"})
    with pytest.raises(ValueError):
        check_conditions([{"column": "c1", "operator": "contains", "value": "1"}], {"c1": "rating_metric"})


def test_restaurants_with_capabilities(spark):
    data = [("Aroma", "Kolkata", 4.3, "Yes", "No"), ("Spice", "Kolkata", 4.8, "No", "Yes"), ("Dosa", "Delhi", 3.9, "Yes", "Yes")]
    df = spark.createDataFrame(data, "RestaurantName string, Area string, Rating double, OnlineTableBooking string, OnlineDelivery string")
    request = {"operation": "filter", "conditions": [{"column": "Area", "operator": "equals", "value": "Kolkata"}, {"column": "OnlineDelivery", "operator": "equals", "value": True}]}
    found = structured.run_structured(df, request, {"Area": "geographic_area", "OnlineDelivery": "delivery_capability"})
    assert [r.RestaurantName for r in found.collect()] == ["Spice"]


def test_learner_plan_drops_what_is_no_number(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "3"), (None, "9")], "g string, v string")
    plan = {"operation": "aggregate", "column": "v", "group_by": "g", "function": "sum"}
    assert rows(structured.run_learner_plan(df, plan)) == [("a", 1.0), ("b", 3.0)]
    count = structured.run_learner_plan(df, {**plan, "function": "count"})
    assert rows(count) == [("a", 2), ("b", 1)]


# ---- ordered work against a plain window, with a hot key --------------------


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, and values repeat."""
    i = F.col("id")
    return spark.range(3000).select(
        i, F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 50).cast("string"))).alias("k"),
        (i * 7919 % 101).alias("o"), F.when(i % 5 != 0, (i % 17).cast("double")).alias("v"),
    )


@pytest.mark.parametrize("keys", [["k"], []])
def test_chunked_scans_equal_plain_windows(hot, rows, keys):
    order = [("o", True), "id"]
    for work in (
        lambda small: ordered.row_index(hot, order, keys, "x", small),
        lambda small: ordered.running_total(hot, "v", order, keys, "x", small),
        lambda small: ordered.moving_average(hot, "v", order, 4, keys, "x", small).withColumn("x", F.round("x", 9)),
    ):
        assert rows(work(False), "id", "x") == rows(work(True), "id", "x")


@pytest.mark.parametrize("dense", [True, False])
def test_rank_equals_plain_window(hot, rows, dense):
    from pyspark.sql import Window

    over = Window.partitionBy("k").orderBy(F.desc("o"))
    plain = hot.withColumn("x", (F.dense_rank() if dense else F.rank()).over(over))
    assert rows(ordered.rank(hot, [("o", True)], ["k"], dense, "x"), "id", "x") == rows(plain, "id", "x")


def test_forward_fill_equals_plain_window(hot, rows):
    from pyspark.sql import Window

    over = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumn("v", F.last("v", ignorenulls=True).over(over))
    assert rows(ordered.forward_fill(hot, ["v"], ["o", "id"], ["k"]), "id", "v") == rows(plain, "id", "v")


def test_moving_average_over_block_borders(spark, rows):
    df = spark.range((1 << 16) + 50).select("id", (F.col("id") % 10).cast("double").alias("v"))
    wide = ordered.moving_average(df, "v", ["id"], 4, out="x").withColumn("x", F.round("x", 9))
    plain = ordered.moving_average(df, "v", ["id"], 4, out="x", small=True).withColumn("x", F.round("x", 9))
    assert wide.exceptAll(plain).count() == 0 and wide.count() == plain.count()


def test_group_value_matches_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(ordered.group_value(df, ["k"], {"n": F.count(F.lit(1))}), "v", "n") == [(1, 2), (2, 2), (3, 1)]


def test_means_come_from_the_table_as_given(spark):
    """The scalar of a comparison does not run through the derived columns."""
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0), ("b", 4.0)], "g string, v double")
    condition = {"window_function": "sum", "partition_by": ["g"], "column": "v", "operator": "greater_than", "value": 5}
    plan = {"derived_columns": [{"alias": "size", "case": {"condition": condition, "then": "big", "else": "small"}}], "filters": [{"column": "v", "operator": "above_average"}]}
    found = run_plan(df, plan)
    assert [(r["v"], r["size"]) for r in found.collect()] == [(9.0, "big")]
    # One join puts the groups' sums on the rows; the mean needs none.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_too_wide_a_split_is_refused(spark, monkeypatch):
    monkeypatch.setattr(projection, "MOST_PARTS", 3)
    df = spark.createDataFrame([("a,b,c,d",), ("x",)], "t string")
    with pytest.raises(ValueError):
        projection.split_column(df, "t", ",")
    assert projection.split_column(df, "t", ",", 2).columns == ["t", "t_part1", "t_part2"]
    assert projection.split_column(df.filter("t = 'x'"), "t", ",").columns == ["t", "t_part1"]
