"""Queries for outliers, trends, KPIs, recommendations, health, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import findings, insights, kpis
from tablewright.plans.report import build_report

from .common import load, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


# ---- outliers ---------------------------------------------------------------

SQUARED = "SELECT o_orderkey, o_totalprice * o_totalprice / 1e6 AS price, l FROM orders, (SELECT 1 AS l)"
FOUND = """
WITH t AS (SELECT pow(l_extendedprice, 3) / 1e9 AS cubed, l_quantity AS quantity FROM lineitem),
b AS (SELECT 'cubed' AS c, 'iqr' AS m, quantile_cont(cubed, .25) AS a, quantile_cont(cubed, .75) AS z, 1.0 AS k FROM t
  UNION ALL SELECT 'quantity', 'iqr', quantile_cont(quantity, .25), quantile_cont(quantity, .75), 1.0 FROM t),
w AS (SELECT c, m, a - k * (z - a) AS lo, z + k * (z - a) AS hi FROM b
  UNION ALL SELECT 'cubed', 'zscore', avg(cubed) - 2 * stddev_samp(cubed), avg(cubed) + 2 * stddev_samp(cubed) FROM t
  UNION ALL SELECT 'quantity', 'zscore', avg(quantity) - 2 * stddev_samp(quantity), avg(quantity) + 2 * stddev_samp(quantity) FROM t),
f AS (SELECT c AS "column", m AS method, lo, hi, count(*) FILTER (v < lo OR v > hi) AS outlier_count, count(v) AS total
  FROM w JOIN (SELECT 'cubed' AS c, cubed AS v FROM t UNION ALL SELECT 'quantity', quantity FROM t) USING (c) GROUP BY ALL),
p AS (SELECT *, round(outlier_count * 100.0::DOUBLE / total, 2) AS percentage FROM f),
s AS (SELECT *, CASE WHEN percentage >= 20 THEN 'Critical' WHEN percentage >= 10 THEN 'High' WHEN percentage >= 5 THEN 'Medium' ELSE 'Low' END AS severity FROM p)
"""


def skewed(spark, folder):
    return load(spark, folder, "lineitem").select((F.pow("l_extendedprice", 3) / 1e9).alias("cubed"), F.col("l_quantity").alias("quantity"))


@query(FOUND + """
SELECT "column", method, outlier_count, total, percentage, severity, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
  CASE WHEN outlier_count = 0 THEN 'Ignore' WHEN severity IN ('High', 'Critical') THEN 'Validate source' ELSE 'Review transaction' END AS recommended_action,
  round(CASE method WHEN 'iqr' THEN 0.95 ELSE 0.9 END + CASE WHEN outlier_count = 0 THEN -0.05 WHEN percentage >= 20 THEN 0.02 ELSE 0 END, 2)::DOUBLE AS confidence
FROM s""")  # fmt: skip
def outliers_both_methods(spark, folder):
    found = insights.outliers(skewed(spark, folder), multiplier=1.0, threshold=2.0).drop("examples")
    return rounded(found, {"lower_bound": 4, "upper_bound": 4})


@query(FOUND + """SELECT "column", arg_max(method, (percentage, method = 'iqr')) AS method, arg_max(outlier_count, (percentage, method = 'iqr')) AS outlier_count, max(percentage) AS percentage FROM s GROUP BY 1""")
def outliers_worst_method(spark, folder):
    return insights.worst_outliers(insights.outliers(skewed(spark, folder), multiplier=1.0, threshold=2.0))


@query("""
WITH t AS (SELECT l_extendedprice AS v FROM lineitem), b AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM t)
SELECT list(v ORDER BY abs(v - m) DESC, v)[1:5] AS examples FROM t, b WHERE abs(v - m) > 1.5 * s
""")
def outlier_examples(spark, folder):
    found = insights.outliers(load(spark, folder, "lineitem").select("l_extendedprice"), ["l_extendedprice"], ["zscore"], threshold=1.5)
    return found.select("examples")


# ---- trend ------------------------------------------------------------------

TREND = """
, x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY period) - 1 AS i, y - lag(y) OVER (PARTITION BY g ORDER BY period) AS d FROM s),
u AS (SELECT *, sum(CASE WHEN d > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY i) AS ru, sum(CASE WHEN d < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY i) AS rd FROM x),
inc AS (SELECT g, max(n) AS up FROM (SELECT g, ru, count(*) FILTER (d > 0) AS n FROM u GROUP BY 1, 2) GROUP BY 1),
dec AS (SELECT g, max(n) AS down FROM (SELECT g, rd, count(*) FILTER (d < 0) AS n FROM u GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT g, count(*) AS n, regr_slope(y, i) AS slope, regr_r2(y, i) AS r2, avg(y) AS m, arg_min(y, i) AS first, arg_max(y, i) AS last,
  arg_max(period, (y, -i)) AS hi, arg_min(period, (y, i)) AS lo FROM x GROUP BY 1)
SELECT g, n, CASE WHEN abs(slope / abs(m)) < 0.01 THEN 'Stable' WHEN slope > 0 THEN 'Increasing' ELSE 'Decreasing' END AS trend,
  round((last - first) / abs(first) * 100, 1) AS growth_percent, monthname(hi) AS highest_period, monthname(lo) AS lowest_period,
  up AS consecutive_increase, down AS consecutive_decrease, round(slope, 4) AS slope, round(r2, 8) AS r2 FROM f JOIN inc USING (g) JOIN dec USING (g)
"""
TREND_COLUMNS = ["n", "trend", "growth_percent", "highest_period", "lowest_period", "consecutive_increase", "consecutive_decrease", "slope", "r2"]


@query("WITH s AS (SELECT 'all' AS g, date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS y FROM orders GROUP BY 2)" + TREND)
def trend_monthly(spark, folder):
    series = insights.period_series(load(spark, folder, "orders"), "o_totalprice", F.date_trunc("month", "o_orderdate"))
    found = insights.trend(series, "value", ["period"], "period", small=True)
    return rounded(found.select(F.lit("all").alias("g"), *TREND_COLUMNS), {"slope": 4, "r2": 8})


@query("WITH s AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)" + TREND)
def trend_monthly_by_group(spark, folder):
    series = insights.period_series(load(spark, folder, "orders"), "o_totalprice", F.date_trunc("month", "o_orderdate"), group_by=["o_orderpriority"])
    found = insights.trend(series, "value", ["period"], "period", ["o_orderpriority"], small=True)
    return rounded(found.select(F.col("o_orderpriority").alias("g"), *TREND_COLUMNS), {"slope": 4, "r2": 8})


@query("WITH s AS (SELECT o_orderstatus AS g, o_orderdate + to_microseconds(o_orderkey) AS period, o_totalprice AS y FROM orders)" + TREND.replace("monthname(hi)", "monthname(hi)"))
def trend_over_rows(spark, folder):
    rows = load(spark, folder, "orders").withColumn("period", F.col("o_orderdate"))
    found = insights.trend(rows, "o_totalprice", ["o_orderdate", "o_orderkey"], "period", ["o_orderstatus"])
    return rounded(found.select(F.col("o_orderstatus").alias("g"), *TREND_COLUMNS), {"slope": 4, "r2": 8})


@query("""
WITH s AS (SELECT date_trunc('hour', ts) AS period, sum(value * (1 + hour(ts) % 6)) AS y FROM events GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM s),
f AS (SELECT regr_slope(y, i) AS b, regr_intercept(y, i) AS a, count(*) AS n FROM x), e AS (SELECT i, y - a - b * i AS e, n FROM x, f),
c AS (SELECT k, corr(l.e, r.e) AS c FROM range(2, 13) t(k), e l, e r WHERE r.i = l.i + k AND k <= l.n // 2 GROUP BY k)
SELECT (SELECT min(k)::INT FROM c WHERE c >= 0.75) AS seasonal_period, (SELECT n FROM f) AS n
""")
def trend_seasonality(spark, folder):
    rows = load(spark, folder, "events").withColumn("v", F.col("value") * (1 + F.hour("ts") % 6))
    series = insights.period_series(rows, "v", F.date_trunc("hour", "ts"))
    return insights.trend(series, "value", ["period"], "period", small=True).select("seasonal_period", "n")


@query()
def trend_full_report(spark, folder):
    series = insights.period_series(load(spark, folder, "events"), "value", F.date_trunc("hour", "ts"), group_by=["event_type"])
    return insights.trend(series, "value", ["period"], "period", ["event_type"], small=True)


# ---- KPIs -------------------------------------------------------------------

SALES = """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderpriority AS product_name, o_orderdate AS order_date,
  o_totalprice AS revenue, o_totalprice * 0.6 + 10 AS cost FROM orders"""


def sales(spark, folder):
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("product_name"),
        F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("revenue"), (F.col("o_totalprice") * 0.6 + 10).alias("cost"),
    )


@query(f"""
WITH s AS ({SALES}), a AS (SELECT sum(revenue) AS rev, sum(revenue - cost) AS prof, count(DISTINCT order_id) AS o, count(DISTINCT customer_id) AS c FROM s),
m AS (SELECT date_trunc('month', order_date) AS p, sum(revenue) AS r, sum(revenue - cost) AS q, count(DISTINCT order_id)::DOUBLE AS n,
  row_number() OVER (ORDER BY date_trunc('month', order_date)) AS i FROM s GROUP BY 1),
f AS (SELECT arg_min(r, i) AS r0, arg_max(r, i) AS r1, regr_slope(r, i) / abs(avg(r)) AS tr, regr_slope(q, i) / abs(avg(q)) AS tq, regr_slope(n, i) / abs(avg(n)) AS tn FROM m),
l AS (SELECT *, CASE WHEN abs(tr) < .01 THEN 'Stable' WHEN tr > 0 THEN 'Increasing' ELSE 'Decreasing' END AS lr,
  CASE WHEN abs(tq) < .01 THEN 'Stable' WHEN tq > 0 THEN 'Increasing' ELSE 'Decreasing' END AS lq,
  CASE WHEN abs(tn) < .01 THEN 'Stable' WHEN tn > 0 THEN 'Increasing' ELSE 'Decreasing' END AS ln FROM f)
SELECT name, round(value, 2) AS value, entity, trend, unit, confidence, importance, category, row_number() OVER (ORDER BY lvl, -confidence, name) AS rank FROM (
  SELECT 'Revenue' AS name, rev::DOUBLE AS value, NULL::VARCHAR AS entity, lr AS trend, 'currency' AS unit, 0.92::DOUBLE AS confidence, 'Critical' AS importance, 'Revenue' AS category, 1 AS lvl FROM a, l
  UNION ALL SELECT 'Profit', prof, NULL, lq, 'currency', 0.72, 'Critical', 'Profitability', 1 FROM a, l
  UNION ALL SELECT 'Profit Margin', prof / rev * 100, NULL, lq, '%', 0.68, 'High', 'Profitability', 2 FROM a, l
  UNION ALL SELECT 'Growth Rate', round((r1 - r0) / abs(r0) * 100, 1), NULL, lr, '%', 0.92, 'High', 'Revenue', 2 FROM l
  UNION ALL SELECT 'Order Count', o, NULL, ln, 'count', 0.9, 'High', 'Operations', 2 FROM a, l
  UNION ALL SELECT 'Customer Count', c, NULL, NULL, 'count', 0.88, 'High', 'Customers', 2 FROM a
  UNION ALL SELECT 'Average Order Value', rev / o, NULL, lr, 'currency', 0.9, 'Medium', 'Revenue', 3 FROM a, l
  UNION ALL SELECT 'Top Customer', NULL, (SELECT customer_id::VARCHAR FROM s GROUP BY customer_id ORDER BY sum(revenue) DESC, customer_id LIMIT 1), NULL, NULL, 0.88, 'Medium', 'Customers', 3
  UNION ALL SELECT 'Top Product', NULL, (SELECT product_name FROM s GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1), NULL, NULL, 0.88, 'Medium', 'Inventory', 3)
""")
def kpi_table(spark, folder):
    return rounded(kpis.kpis(sales(spark, folder), period=F.date_trunc("month", "order_date")), {"value": 2})


@query("SELECT round(max(w) * 100.0 / sum(w), 2) AS top_share_percent FROM (SELECT sum(o_totalprice) AS w FROM orders GROUP BY o_custkey)")
def kpi_concentration(spark, folder):
    return kpis.concentration(load(spark, folder, "orders"), "o_custkey", "o_totalprice")


# ---- recommendations, health, report ----------------------------------------

SEGMENTS = """
SELECT c_mktsegment AS segment, n_regionkey AS region, round(avg(c_acctbal) / 200, 2) AS a, round(max(c_acctbal) / 150, 2) AS b,
  round(count(*) FILTER (c_acctbal < 2000) * 100.0::DOUBLE / count(*), 2) AS c
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


def segment_findings(spark, folder):
    joined = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    base = joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region")).agg(
        F.round(F.avg("c_acctbal") / 200, 2).alias("a"), F.round(F.max("c_acctbal") / 150, 2).alias("b"),
        F.round(F.count_if(F.col("c_acctbal") < 2000) * 100.0 / F.count(F.lit(1)), 2).alias("c"),
    )
    down = lambda test: F.when(test, "Decreasing").otherwise("Increasing")
    return base.select(
        "segment", "region", down(F.col("region") % 2 == 0).alias("revenue_trend"), F.col("a").alias("revenue_decline"),
        down(F.col("region") == 1).alias("margin_trend"), F.col("c").alias("margin_decline"), (-F.col("a")).alias("margin_change_percent"),
        F.lit("phone").alias("worst_missing_column"), F.col("c").alias("worst_missing_percent"), F.lit(2).cast("long").alias("missing_columns"),
        F.col("b").alias("top_share_percent"), F.lit("price").alias("worst_outlier_column"), F.col("a").alias("worst_outlier_percent"),
        (F.col("b") + 5).alias("quality_score"), F.when(F.col("c") > 25, "High").otherwise("Low").alias("outlier_severity"),
        down(F.col("region") < 3).alias("trend"), (F.col("c") / 30).alias("trend_confidence"), F.col("a").alias("trend_decline"),
    )


def _scaled(v, lo, hi):
    return f"round(0.55::DOUBLE + least(1.0, greatest(0.0, ({v} - {lo}) / ({hi} - {lo})::DOUBLE)) * 0.40::DOUBLE, 2)"


def _priority(v, m, h):
    return f"CASE WHEN {v} >= {h} THEN 'High' WHEN {v} >= {m} THEN 'Medium' ELSE 'Low' END"


ADVICE = f"""
WITH f AS ({SEGMENTS}),
adv AS (
  SELECT segment, region, 'Revenue' AS category, {_priority('a', 5, 15)} AS priority, 'Improve marketing strategy' AS recommendation, {_scaled('a', 2, 25)} AS confidence FROM f WHERE region % 2 = 0
  UNION ALL SELECT segment, region, 'Profitability', {_priority('m', 3, 10)}, 'Review pricing strategy', {_scaled('m', 1, 20)}
    FROM (SELECT *, CASE WHEN region = 1 THEN c ELSE abs(a) END AS m FROM f) WHERE region = 1 OR a > 0
  UNION ALL SELECT segment, region, 'Data Quality', {_priority('c', 30, 50)}, 'Improve data quality', {_scaled('c', 20, 80)} FROM f WHERE c >= 20
  UNION ALL SELECT segment, region, 'Customers', {_priority('b', 50, 60)}, 'Diversify customer base', {_scaled('b', 40, 80)} FROM f WHERE b >= 40
  UNION ALL SELECT segment, region, 'Data Quality', {_priority('a', 15, 25)}, 'Investigate and clean outlier records', {_scaled('a', 10, 40)} FROM f WHERE a >= 10)
"""


@query(ADVICE + "SELECT *, priority AS impact FROM adv")
def recommendations(spark, folder):
    return findings.recommendations(segment_findings(spark, folder), ["segment", "region"]).drop("reason")


@query(ADVICE + """
, h AS (SELECT segment, region, CASE WHEN b + 5 < 40 THEN 3 WHEN b + 5 < 60 THEN 2 WHEN b + 5 < 75 THEN 1 ELSE 0 END AS q, CASE WHEN c > 25 THEN 2 ELSE 0 END AS o,
  CASE WHEN region < 3 AND c / 30 >= .8 AND a >= 15 THEN 2 WHEN region < 3 AND (c / 30 >= .65 OR a >= 5) THEN 1 ELSE 0 END AS t,
  coalesce((SELECT max(CASE priority WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) FROM adv WHERE adv.segment = f.segment AND adv.region = f.region), 0) AS r FROM f)
SELECT segment, region, ['Healthy', 'Needs Attention', 'At Risk', 'Critical'][greatest(q, o, t, r) + 1] AS overall_health, ['Healthy', 'Needs Attention', 'At Risk', 'Critical'][q + 1] AS quality_health,
  ['Healthy', 'Needs Attention', 'At Risk', 'Critical'][r + 1] AS advice_health, ['Healthy', 'Needs Attention', 'At Risk', 'Critical'][o + 1] AS outlier_health, ['Healthy', 'Needs Attention', 'At Risk', 'Critical'][t + 1] AS trend_health FROM h
""")  # fmt: skip
def health_levels(spark, folder):
    table = segment_findings(spark, folder)
    return findings.health(table, ["segment", "region"], findings.recommendations(table, ["segment", "region"]))


@query()
def report_summary(spark, folder):
    return build_report(sales(spark, folder), ["executive_summary"])["executive_summary"]


@query(f"""SELECT 'revenue' AS "column", count(revenue) AS count, round(avg(revenue), 4) AS mean, round(stddev_samp(revenue), 4) AS std, min(revenue) AS min,
  round(quantile_cont(revenue, .25), 4) AS q1, round(quantile_cont(revenue, .5), 4) AS median, round(quantile_cont(revenue, .75), 4) AS q3, max(revenue) AS max FROM ({SALES})""")  # fmt: skip
def report_statistics(spark, folder):
    found = build_report(sales(spark, folder), ["statistics"])["statistics"]
    return rounded(found, dict.fromkeys(["mean", "std", "q1", "median", "q3"], 4))
