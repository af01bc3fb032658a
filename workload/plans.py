"""Queries over structured plans, filters, sorts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.predicates import cleaning_condition, folded_condition, role_condition
from tablewright.operators import matching, ordered
from tablewright.plans import structured
from tablewright.plans.query_plan import run_plan, select_where

from .common import LINE_KEY, load, r, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _metric(function, column, alias=None):
    return {"function": function, "column": column, **({"alias": alias} if alias else {})}


@query("""
WITH src AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 10 THEN 'Returning' ELSE 'New' END AS kind
  FROM orders JOIN customer ON o_custkey = c_custkey),
agg AS (
  SELECT kind, c_mktsegment, o_orderpriority, sum(o_totalprice) AS revenue, count(o_orderkey) AS orders_n FROM src
  WHERE o_totalprice > (SELECT avg(o_totalprice) FROM src) AND o_totalprice BETWEEN 1000 AND 480000
  GROUP BY ALL)
SELECT kind, c_mktsegment, o_orderpriority, round(revenue, 2) AS revenue, orders_n, rnk FROM (
  SELECT *, rank() OVER (PARTITION BY kind, c_mktsegment ORDER BY revenue DESC) AS rnk FROM agg) WHERE rnk <= 2
""")
def plan_flagship(spark, folder):
    rows = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    plan = {
        "derived_columns": [{"alias": "kind", "case": {"condition": {
            "window_function": "count", "partition_by": ["o_custkey"], "operator": "greater_than", "value": 10},
            "then": "Returning", "else": "New"}}],
        "filters": [{"column": "o_totalprice", "operator": "above_average"},
                    {"column": "o_totalprice", "operator": "between", "value": 1000, "value2": 480000}],
        "group_by": ["kind", "c_mktsegment", "o_orderpriority"],
        "metrics": [_metric("sum", "o_totalprice", "revenue"), _metric("count", "o_orderkey", "orders_n")],
        "window": {"type": "rank", "partition_by": ["kind", "c_mktsegment"], "order_by": [{"column": "revenue", "direction": "desc"}]},
        "keep_top_n_per_partition": 2, "order_by": [{"column": "revenue", "direction": "desc"}],
    }
    return rounded(run_plan(rows, plan), {"revenue": 2})


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_discount), 8) AS avg_l_discount,
       count(l_orderkey) AS n, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-06-30' AND l_returnflag <> 'R' AND l_discount BETWEEN 0.02 AND 0.08
  AND lower(l_linestatus) LIKE '%o%' GROUP BY ALL
""")
def plan_group_metrics(spark, folder):
    plan = {
        "filters": [{"column": "l_shipdate", "operator": "greater_than", "value": "1996-06-30"},
                    {"column": "L_RETURNFLAG", "operator": "not_equals", "value": "R"},
                    {"column": "l_discount", "operator": "between", "value": "0.02", "value2": "0.08"},
                    {"column": "l_linestatus", "operator": "contains", "value": "o"}],
        "group_by": ["returnflag", "linestatus"],
        "metrics": [_metric("sum", "l_quantity"), _metric("avg", "l_discount"), _metric("count", "l_orderkey", "n"),
                    _metric("min", "l_extendedprice", "lowest"), _metric("max", "l_extendedprice", "highest")],
    }
    return rounded(run_plan(load(spark, folder, "lineitem"), plan), {"sum_l_quantity": 2, "avg_l_discount": 8})


@query("SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(o_custkey) AS n FROM orders WHERE o_orderstatus = 'F'")
def plan_global_metrics(spark, folder):
    plan = {"filters": [{"column": "o_orderstatus", "operator": "equals", "value": "F"}],
            "metrics": [_metric("sum", "o_totalprice", "total"), _metric("avg", "o_totalprice", "mean"), _metric("count", "o_custkey", "n")]}
    return rounded(run_plan(load(spark, folder, "orders"), plan), {"total": 2, "mean": 4})


@query("SELECT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 5000")
def plan_select_columns(spark, folder):
    plan = {"group_by": ["c_mktsegment", "c_nationkey"],
            "filters": [{"column": "c_acctbal", "operator": "greater_than_equal", "value": 100},
                        {"column": "c_acctbal", "operator": "less_than", "value": 5000}]}
    return run_plan(load(spark, folder, "customer"), plan)


@query("SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey ASC LIMIT 20")
def plan_order_limit(spark, folder):
    plan = {"order_by": [{"column": "c_acctbal"}, {"column": "c_custkey", "direction": "asc"}], "limit": 20}
    return run_plan(load(spark, folder, "customer"), plan)


@query("""
SELECT l_returnflag, l_suppkey, qty, rnk FROM (
  SELECT l_returnflag, l_suppkey, sum(l_quantity) AS qty,
         dense_rank() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC) AS rnk
  FROM lineitem GROUP BY 1, 2) WHERE rnk <= 5
""")
def plan_top_n_per_partition(spark, folder):
    plan = {"group_by": ["l_returnflag", "l_suppkey"], "metrics": [_metric("sum", "l_quantity", "qty")],
            "window": {"type": "dense_rank", "partition_by": ["l_returnflag"], "order_by": [{"column": "qty"}]},
            "keep_top_n_per_partition": 5}
    return run_plan(load(spark, folder, "lineitem"), plan)


@query("""
SELECT l_suppkey, qty, rank() OVER (ORDER BY qty DESC) AS rnk FROM (SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
""")
def plan_rank_all(spark, folder):
    plan = {"group_by": ["l_suppkey"], "metrics": [_metric("sum", "l_quantity", "qty")],
            "window": {"type": "rank", "order_by": [{"column": "qty", "direction": "desc"}]}}
    return run_plan(load(spark, folder, "lineitem"), plan)


@query("""
SELECT o_orderdate, round(total, 2) AS total, round(sum(total) OVER (ORDER BY o_orderdate ROWS UNBOUNDED PRECEDING), 2) AS running_total
FROM (SELECT o_orderdate, sum(o_totalprice) AS total FROM orders GROUP BY 1)
""")
def plan_running_total(spark, folder):
    plan = {"group_by": ["o_orderdate"], "metrics": [_metric("sum", "o_totalprice", "total")],
            "window": {"type": "running_total", "order_by": [{"column": "o_orderdate", "direction": "asc"}]}}
    return rounded(run_plan(load(spark, folder, "orders"), plan), {"total": 2, "running_total": 2})


@query("""
SELECT o_orderstatus, o_orderdate, round(total, 2) AS total,
       round(sum(total) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate ROWS UNBOUNDED PRECEDING), 2) AS running_total
FROM (SELECT o_orderstatus, o_orderdate, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
""")
def plan_running_total_by_group(spark, folder):
    plan = {"group_by": ["o_orderstatus", "o_orderdate"], "metrics": [_metric("sum", "o_totalprice", "total")],
            "window": {"type": "running_total", "partition_by": ["o_orderstatus"], "order_by": [{"column": "o_orderdate", "direction": "asc"}]}}
    return rounded(run_plan(load(spark, folder, "orders"), plan), {"total": 2, "running_total": 2})


@query("""
SELECT o_orderdate, round(total, 2) AS total,
       round(avg(total) OVER (ORDER BY o_orderdate ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_avg
FROM (SELECT o_orderdate, sum(o_totalprice) AS total FROM orders GROUP BY 1)
""")
def plan_moving_average(spark, folder):
    plan = {"group_by": ["o_orderdate"], "metrics": [_metric("sum", "o_totalprice", "total")],
            "window": {"type": "moving_average", "window_size": 7, "order_by": [{"column": "o_orderdate", "direction": "asc"}]}}
    return rounded(run_plan(load(spark, folder, "orders"), plan), {"total": 2, "moving_avg": 4})


@query("""
SELECT kind, big, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n FROM (
  SELECT *, CASE WHEN sum(o_totalprice) OVER (PARTITION BY kind, o_orderpriority) > 100000000 THEN 1 ELSE 0 END AS big FROM (
    SELECT *, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 10 THEN 'Returning' ELSE 'New' END AS kind FROM orders))
GROUP BY 1, 2
""")
def plan_derived_labels(spark, folder):
    derived = lambda alias, condition, then, other: {"alias": alias, "case": {"condition": condition, "then": then, "else": other}}
    plan = {
        "derived_columns": [
            derived("kind", {"window_function": "count", "partition_by": ["o_custkey"], "operator": "greater_than", "value": 10}, "Returning", "New"),
            derived("big", {"window_function": "sum", "column": "o_totalprice", "partition_by": ["kind", "o_orderpriority"],
                            "operator": "greater_than", "value": 100000000}, 1, 0),
        ],
        "group_by": ["kind", "big"], "metrics": [_metric("sum", "o_totalprice", "revenue"), _metric("count", "o_orderkey", "n")],
    }
    return rounded(run_plan(load(spark, folder, "orders"), plan), {"revenue": 2})


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice < (SELECT avg(o_totalprice) FROM orders) AND o_orderpriority = '5-LOW'
""")
def plan_below_average(spark, folder):
    plan = {"filters": [{"column": "o_totalprice", "operator": "below_average"}, {"column": "o_orderpriority", "operator": "equals", "value": "5-LOW"}]}
    return run_plan(load(spark, folder, "orders"), plan).select("o_orderkey", "o_totalprice")


@query("""
SELECT * FROM part WHERE p_size >= 40 AND p_retailprice BETWEEN 900 AND 950 AND contains(lower(p_name), 'ring') AND p_brand <> 'Brand#1'
""")
def filter_with_parameters(spark, folder):
    return select_where(load(spark, folder, "part"), [
        {"column": "p_size", "operator": "greater_than_equal", "value": "40"},
        {"column": "p_retailprice", "operator": "between", "value": 900, "value2": 950},
        {"column": "p_name", "operator": "contains", "value": "RING"}, {"column": "p_brand", "operator": "not_equals", "value": "Brand#1"},
    ])


GAPPY = "SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty FROM lineitem"


def gappy(spark, folder):
    return load(spark, folder, "lineitem").withColumn("qty", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


@query(f"""
SELECT count(*) FILTER (qty IS DISTINCT FROM 10) AS kept_not_equal, count(*) FILTER (qty > 25) AS kept_above,
       count(*) FILTER (qty IS NULL) AS kept_null, count(*) FILTER (qty IS NOT NULL) AS kept_filled,
       count(*) FILTER (contains(lower(l_returnflag), 'a')) AS kept_contains FROM ({GAPPY})
""")
def filter_cleaning_rules(spark, folder):
    df = gappy(spark, folder)
    count = lambda *a: F.count_if(cleaning_condition(df, *a))
    return df.agg(
        count("qty", "not_equals", "10").alias("kept_not_equal"), count("qty", "greater_than", 25).alias("kept_above"),
        count("qty", "is_null").alias("kept_null"), count("qty", "not_null").alias("kept_filled"),
        count("l_returnflag", "contains", "A").alias("kept_contains"),
    )


FLAGS = """SELECT *, CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'NO' ELSE 'maybe' END AS delivery FROM orders"""


def flags(spark, folder):
    word = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "NO").otherwise("maybe")
    return load(spark, folder, "orders").withColumn("delivery", word)


ROLES = {"delivery": "delivery_capability", "o_totalprice": "currency_metric", "o_orderpriority": "category", "o_orderstatus": "status"}


@query(f"""
SELECT o_orderstatus, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM ({FLAGS})
WHERE trim(lower(delivery)) <> 'yes' AND o_totalprice BETWEEN 5000 AND 400000 AND starts_with(o_orderpriority, '1') GROUP BY 1
""")
def filter_by_roles(spark, folder):
    request = {
        "operation": "group", "group_by": ["o_orderstatus"],
        "conditions": [{"column": "delivery", "operator": "not_equals", "value": True},
                       {"column": "o_totalprice", "operator": "between", "value": 5000, "value2": 400000},
                       {"column": "o_orderpriority", "operator": "starts_with", "value": "1"}],
        "aggregates": [{"column": "o_orderkey", "function": "count", "alias": "n"}, {"column": "o_totalprice", "function": "sum", "alias": "total"}],
    }
    return rounded(structured.run_structured(flags(spark, folder), request, ROLES), {"total": 2})


@query(f"""
SELECT count(*) FILTER (trim(lower(delivery)) = 'yes') AS is_true, count(*) FILTER (trim(lower(delivery)) <> 'yes') AS is_false,
       count(*) FILTER (o_orderpriority LIKE '%LOW') AS ends, count(*) FILTER (lower(o_orderpriority) LIKE '%urg%') AS holds FROM ({FLAGS})
""")
def filter_truth_words(spark, folder):
    df = flags(spark, folder)
    count = lambda c, op, v: F.count_if(role_condition(df, ROLES[c], {"column": c, "operator": op, "value": v}))
    return df.agg(
        count("delivery", "equals", True).alias("is_true"), count("delivery", "equals", "no").alias("is_false"),
        count("o_orderpriority", "ends_with", "LOW").alias("ends"), count("o_orderpriority", "contains", "URG").alias("holds"),
    )


@query("SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'P'")
def structured_count(spark, folder):
    conditions = [{"column": "o_totalprice", "operator": "greater_than", "value": 100000}, {"column": "o_orderstatus", "operator": "equals", "value": "P"}]
    return structured.run_structured(load(spark, folder, "orders"), {"operation": "count", "conditions": conditions}, ROLES)


@query("SELECT CASE WHEN l_linenumber < 3 THEN NULL ELSE l_returnflag END AS flag, count(*) AS count FROM lineitem GROUP BY 1")
def structured_group_sizes(spark, folder):
    df = load(spark, folder, "lineitem").withColumn("flag", F.when(F.col("l_linenumber") >= 3, F.col("l_returnflag")))
    return structured.run_structured(df, {"operation": "group", "group_by": ["flag"]}, {})


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, count(c_custkey) AS n FROM customer GROUP BY 1")
def structured_group_aggregates(spark, folder):
    wanted = [("c_acctbal", "avg", "mean"), ("c_acctbal", "min", "low"), ("c_acctbal", "max", "high"), ("c_custkey", "count", "n")]
    request = {"operation": "aggregate", "group_by": ["c_nationkey"], "aggregates": [{"column": c, "function": f, "alias": a} for c, f, a in wanted]}
    return rounded(structured.run_structured(load(spark, folder, "customer"), request, {}), {"mean": 4})


@query("SELECT *, (SELECT count(*) FROM customer) AS total_rows FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 25")
def structured_sort_preview(spark, folder):
    return structured.preview(load(spark, folder, "customer"), ["c_mktsegment", ("c_acctbal", True), "c_custkey"])


@query("SELECT count(*) FILTER (lower(p_type) = 'economy') AS eq, count(*) FILTER (p_size >= 25) AS gte, count(*) FILTER (p_size < 7) AS lt FROM part")
def filter_case_folded(spark, folder):
    df = load(spark, folder, "part")
    count = lambda c, op, v: F.count_if(folded_condition(df, {"column": c, "operator": op, "value": v}))
    return df.agg(count("p_type", "eq", "Economy").alias("eq"), count("p_size", "gte", "25").alias("gte"), count("p_size", "lt", 7).alias("lt"))


@query("""
(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15)
UNION ALL (SELECT 'bottom' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15)
""")
def top_and_bottom_rows(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    top = structured.extreme_rows(df, "o_totalprice", 15, True, ["o_orderkey"]).withColumn("side", F.lit("top"))
    return top.unionByName(structured.extreme_rows(df, "o_totalprice", 15, False, ["o_orderkey"]).withColumn("side", F.lit("bottom")))


@query("""
WITH cells AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL),
hits AS (SELECT *, p AS phrase, lower(value) = p AS exact FROM cells, (VALUES ('urgent'), ('2-high'), ('high')) t(p) WHERE contains(lower(value), p))
SELECT "column", value, phrase, exact, n FROM hits ORDER BY exact DESC, length(phrase) DESC, n DESC, "column" DESC, value DESC LIMIT 1
""")
def phrase_best_column(spark, folder):
    return matching.phrase_column(load(spark, folder, "orders"), ["Urgent", "2-high", "high"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")
def phrase_rows(spark, folder):
    return matching.rows_with_phrase(load(spark, folder, "orders"), ["urgent"]).select("o_orderkey", "o_orderpriority")


@query("SELECT count(*) AS matching_rows FROM customer WHERE lower(c_mktsegment) = 'building'")
def count_equal_value(spark, folder):
    return matching.count_equal(load(spark, folder, "customer"), "c_mktsegment", " Building ")


@query("""
SELECT unnest([{'check': 'p_size greater_than 30', 'violations': count(*) FILTER (NOT p_size > 30)},
               {'check': 'p_type equals PROMO', 'violations': count(*) FILTER (p_type <> 'PROMO')},
               {'check': 'missing column p_colour', 'violations': count(*)},
               {'check': 'missing column p_shape', 'violations': 1}], recursive := true) FROM part
""")
def result_audit(spark, folder):
    promised = [{"column": "p_size", "operator": "greater_than", "value": 30}, {"column": "p_type", "operator": "equals", "value": "PROMO"},
                {"column": "p_colour", "operator": "equals", "value": "red"}]
    return structured.audit_result(load(spark, folder, "part"), promised, ["p_name", "p_shape"])


# ---- learner plans ----------------------------------------------------------


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS p_retailprice FROM part WHERE p_size > 10 GROUP BY 1")
def learner_group_mean(spark, folder):
    plan = {"operation": "aggregate", "column": "p_retailprice", "group_by": "p_brand", "function": "mean",
            "where": {"column": "p_size", "operator": "gt", "value": 10}}
    return rounded(structured.run_learner_plan(load(spark, folder, "part"), plan), {"p_retailprice": 6})


@query("SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def learner_monthly_trend(spark, folder):
    plan = {"operation": "trend", "frequency": "month", "column": "o_totalprice", "group_by": "o_orderdate", "function": "sum"}
    return rounded(structured.run_learner_plan(load(spark, folder, "orders"), plan), {"o_totalprice": 2})


@query("""
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
WHERE rn = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 10
""")
def learner_best_per_group(spark, folder):
    plan = {"operation": "rank", "column": "p_retailprice", "group_by": "p_brand", "direction": "desc", "limit": 10}
    return structured.run_learner_plan(load(spark, folder, "part"), plan, ["p_partkey"])


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean_quantity, count(l_suppkey) AS n,
       min(l_tax) AS low_tax, max(l_tax) AS high_tax FROM lineitem GROUP BY 1, 2
""")
def pivot_report(spark, folder):
    fields = [("l_extendedprice", "sum", "total"), ("l_quantity", "average", "mean_quantity"), ("l_suppkey", "count", "n"),
              ("l_tax", "min", "low_tax"), ("l_tax", "max", "high_tax")]
    values = [{"field": f, "operation": o, "alias": a} for f, o, a in fields]
    return rounded(structured.pivot_summary(load(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], values), {"total": 2, "mean_quantity": 6})


@query("""
SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O",
       round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1
""")
def pivot_spread(spark, folder):
    df = structured.pivot_summary(load(spark, folder, "orders"), ["o_orderpriority"], [{"field": "o_totalprice", "operation": "sum"}], "o_orderstatus")
    return rounded(df, {c: 2 for c in df.columns if c != "o_orderpriority"})


# ---- ordered work over whole tables ------------------------------------------


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS rnk FROM orders")
def window_rank_rows(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return ordered.rank(df, [("o_orderdate", True)], ["o_orderstatus"]).select("o_orderkey", "rnk")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS rnk FROM orders")
def window_dense_rank_rows(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return ordered.rank(df, ["o_custkey"], dense=True).select("o_orderkey", "rnk")


@query(f"""
SELECT {', '.join(LINE_KEY)}, sum(l_quantity) OVER (ORDER BY l_shipdate, {', '.join(LINE_KEY)} ROWS UNBOUNDED PRECEDING) AS running_quantity FROM lineitem
""")
def window_running_total_rows(spark, folder):
    df = load(spark, folder, "lineitem").select(*LINE_KEY, "l_shipdate", "l_quantity")
    return ordered.running_total(df, "l_quantity", ["l_shipdate", *LINE_KEY], out="running_quantity").select(*LINE_KEY, "running_quantity")


@query("""
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4)
  AS moving_avg FROM orders
""")
def window_moving_average_rows(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return rounded(ordered.moving_average(df, "o_totalprice", ["o_orderdate", "o_orderkey"], 5, ["o_orderpriority"]).select("o_orderkey", "moving_avg"), {"moving_avg": 4})


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n, max(o_totalprice) OVER w AS highest
FROM orders WINDOW w AS (PARTITION BY o_custkey)
""")
def window_group_values(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = ordered.group_value(df, ["o_custkey"], {"total": F.sum("o_totalprice"), "n": F.count(F.lit(1)), "highest": F.max("o_totalprice")})
    return found.select("o_orderkey", r("total", 2), "n", "highest")
