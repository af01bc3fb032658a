"""Trends, outliers, KPIs, recommendations, health, report."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import findings, insights, kpis
from tablewright.plans.report import build_report

CASES = {
    "rising": ([1000, 1100, 1184], ("Increasing", 18.4, 0.0, "March", "January", 2, 0)),
    "falling": ([1000, 900, 800, 700], ("Decreasing", -30.0, 30.0, "January", "April", 0, 3)),
    "stable": ([1000, 1005, 995, 1002], ("Stable", 0.2, 0.0, "February", "March", 1, 1)),
    "wavy": ([1000, 1200, 1100, 1300, 1250], ("Increasing", 25.0, 0.0, "April", "January", 1, 1)),
    "one": ([42], ("Stable", 0.0, 0.0, "January", "January", 0, 0)),
    "zero": ([0, 10, 20], ("Increasing", None, 0.0, "March", "January", 2, 0)),
    "gap": ([10, None, 30], ("Increasing", 200.0, 0.0, "March", "January", 1, 0)),
}
MONTHS = ["January", "February", "March", "April", "May"]


@pytest.fixture(scope="module")
def series(spark):
    data = [(name, i, MONTHS[i], v) for name, (values, _) in CASES.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "name string, i int, month string, revenue long")


@pytest.mark.parametrize("small", [True, False])
def test_trends(series, small):
    found = insights.trend(series, "revenue", ["i"], "month", ["name"], small=small).collect()
    assert len(found) == len(CASES)
    for r in found:
        got = (r.trend, r.growth_percent, r.decline_percent, r.highest_period, r.lowest_period, r.consecutive_increase, r.consecutive_decrease)
        assert got == CASES[r["name"]][1], r["name"]
        assert "increased consistently" in r.summary or r["name"] not in ("rising", "zero", "gap")
        assert "with some fluctuation" in r.summary or r["name"] != "wavy"


def test_trend_methods(spark):
    data = [("e", i, float(2**i)) for i in range(7)] + [("s", i, float(v)) for i, v in enumerate([1, 5, 2, 6, 3, 7, 4, 8])]
    df = spark.createDataFrame(data, "g string, i int, v double")
    assert {r.g: r.method for r in insights.trend(df, "v", ["i"], group_by=["g"], small=True).collect()} == {"e": "exponential_growth", "s": "seasonal_basic"}


def test_trend_refuses_unknown_columns(series):
    with pytest.raises(ValueError):
        insights.trend(series, "income", ["i"])
    assert insights.trend(series.filter("i > 99"), "revenue", ["i"], small=True).count() == 0


@pytest.mark.parametrize("t,freedom,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0), (3.707, 6, 0.01), (1.96, 100000, 0.05)])
def test_student_tail(t, freedom, p):
    assert insights._beta_tail(freedom / (freedom + t * t), freedom / 2) == pytest.approx(p, abs=2e-5)


def test_month_of_a_timestamp(spark):
    df = spark.sql("select timestamp'2024-03-01' + make_dt_interval(31 * id) as day, double(id) as v from range(3)")
    assert insights.trend(df, "v", ["day"], "day", small=True).first().highest_period == "May"


def test_outliers(spark):
    df = spark.createDataFrame([(v, 5, "a") for v in [10, 11, 9, 12, 10, 11, 9, 500, 10, 11]], "amount long, steady long, category string")
    found = {(r.column, r.method): r for r in insights.outliers(df).collect()}
    assert set(found) == {("amount", "iqr"), ("amount", "zscore")}
    iqr = found["amount", "iqr"]
    assert (iqr.outlier_count, iqr.percentage, iqr.severity, iqr.recommended_action, iqr.confidence, iqr.examples) == (1, 10.0, "High", "Validate source", 0.95, [500.0])
    assert (found["amount", "zscore"].outlier_count, found["amount", "zscore"].confidence, found["amount", "zscore"].recommended_action) == (0, 0.85, "Ignore")
    far = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 6, 7, 1000, 2000, 3000]], "x long")
    assert insights.outliers(far, methods=["iqr"]).first().severity == "Critical"
    calm = spark.createDataFrame([(v,) for v in range(1, 6)], "x long")
    assert insights.outliers(calm, methods=["iqr"]).first().outlier_count == 0
    with pytest.raises(ValueError):
        insights.outliers(df, ["category"])


@pytest.fixture(scope="module")
def business(spark):
    values = [100, 120, 110, 130, 140, 150, 160, 170, 180, 190, 230, 250]
    data = [(i, f"O{i + 1}", MONTHS[i // 3], f"cust{i % 3}", f"item{i % 2}", v, v // 2) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "i int, order_id string, month string, customer_name string, product_name string, revenue long, cost long")


def test_kpis(business):
    found = {r["name"]: r for r in kpis.kpis(business.drop("i").withColumn("i", F.col("revenue") * 0), order=["order_id"]).collect()}
    assert set(found) == set(kpis.ABOUT)
    assert found["Revenue"].value == 1930.0 and found["Order Count"].value == 12 and found["Customer Count"].value == 3
    assert found["Profit"].confidence == 0.72 and found["Profit Margin"].confidence == 0.68
    assert found["Average Order Value"].value == round(1930 / 12, 2)
    assert found["Top Product"].entity == "item1" and found["Top Customer"].entity == "cust2"
    assert sorted(r.rank for r in found.values()) == list(range(1, 10)) and found["Revenue"].rank == 1


def test_kpis_follow_row_order(business):
    found = {r["name"]: r for r in kpis.kpis(business, order=["i"]).collect()}
    assert found["Revenue"].trend == "Increasing" and found["Growth Rate"].value == 150.0


def test_no_kpis_without_fitting_columns(spark):
    assert kpis.kpis(spark.createDataFrame([(1, "x")], "alpha int, beta string")).count() == 0


def test_recommendations_and_health(spark):
    base = dict.fromkeys(["revenue_trend", "revenue_decline", "margin_trend", "margin_decline", "margin_change_percent", "worst_missing_column", "worst_missing_percent",
                          "missing_columns", "top_share_percent", "worst_outlier_column", "worst_outlier_percent", "quality_score", "outlier_severity", "trend",
                          "trend_confidence", "trend_decline"])
    rows = [{"d": "bad", **base, "revenue_trend": "Decreasing", "revenue_decline": 20.0, "worst_missing_column": "a", "worst_missing_percent": 25.0, "missing_columns": 1,
             "top_share_percent": 55.0, "quality_score": 30.0}, {"d": "good", **base, "quality_score": 99.0}]
    kinds = {"missing_columns": "long", **{c: "string" for c in ("revenue_trend", "margin_trend", "worst_missing_column", "worst_outlier_column", "outlier_severity", "trend")}}
    table = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'd' else kinds.get(c, 'double')}" for c in rows[0]))
    advice = findings.recommendations(table, ["d"])
    got = [(r.d, r.category, r.priority, r.confidence) for r in advice.collect()]
    assert got == [("bad", "Revenue", "High", 0.86), ("bad", "Customers", "Medium", 0.7), ("bad", "Data Quality", "Low", 0.58)]
    assert "declining 20.0%" in advice.first().reason
    assert {r.d: r.overall_health for r in findings.health(table, ["d"], advice).collect()} == {"bad": "Critical", "good": "Healthy"}


def test_report_gives_only_the_chosen_sections(business):
    out = build_report(business, ["statistics", "outliers", "executive_summary"], "revenue", order=["i"])
    assert list(out) == ["statistics", "outliers", "executive_summary"]
    assert out["statistics"].first()["count"] == 12 and out["executive_summary"].first().trend_health == "Healthy"
    with pytest.raises(ValueError):
        build_report(business, ["poem"])


def test_sentiment(spark, rows):
    from tablewright.functions import text

    df = spark.createDataFrame([("Great and friendly", "A"), ("noisy, dirty, but good", "A"), ("table", " ")], "t string, e string")
    labelled = df.withColumn("s", text.sentiment(F.col("t"))).select("e", "s.label", F.round("s.score", 4).alias("score"))
    assert rows(labelled, "label", "score") == [("Negative", -0.55), ("Neutral", 0.0), ("Positive", 0.55)]
    assert rows(insights.sentiment_rollup(labelled, "e"), "entity", "reviews", "satisfaction") == [("A", 2, 50.0), ("Unknown", 1, 0.0)]


def test_own_rules(spark, business):
    table = spark.createDataFrame([("a", 12.0)], "d string, churn double")
    own = findings.rule(F.col("churn") > 10, "Customers", "Call them", F.lit("churn is high"), F.col("churn"), (5.0, 20.0), (0.0, 24.0))
    assert [(r.category, r.priority, r.confidence) for r in findings.recommendations(table, ["d"], [own]).collect()] == [("Customers", "Medium", 0.75)]
    found = kpis.kpis(business, extra=[{"name": "Largest Sale", "value": F.max("revenue"), "unit": "currency", "confidence": 0.9}]).filter("name = 'Largest Sale'").first()
    assert (found.value, found.importance) == (250.0, "Low")
