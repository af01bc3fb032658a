"""Queries for profiles, cleaning, projections, binning, dates and currency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import currency, names
from tablewright.operators import binning, cleaning, money, profile, projection
from tablewright.plans.registry import TRANSFORMATIONS
from tablewright.plans.steps import full_clean, run_steps

from .common import load, r, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def line_numbers(spark, folder):
    return load(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(template: str, columns) -> str:
    return "\nUNION ALL ".join(template.replace("$c", c) for c in columns)


# ---- profiles ---------------------------------------------------------------


@query(_each("""SELECT '$c' AS "column", count($c) AS count, round(avg($c), 6) AS mean, round(stddev_samp($c), 6) AS std, min($c) AS min,
  round(quantile_cont($c, 0.25), 6) AS q1, round(quantile_cont($c, 0.5), 6) AS median, round(quantile_cont($c, 0.75), 6) AS q3, max($c) AS max FROM lineitem""", NUMBERS))  # fmt: skip
def describe_numbers(spark, folder):
    return rounded(profile.describe(line_numbers(spark, folder)), dict.fromkeys(["mean", "std", "q1", "median", "q3"], 6))


GAPS = """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS price,
  o_orderpriority FROM orders"""


def gaps(spark, folder):
    return load(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"),
        "o_orderpriority",
    )


GAP_COLUMNS = ["o_orderkey", "status", "price", "o_orderpriority"]


@query(_each(f"""SELECT '$c' AS "column", count(*) - count($c) AS missing, round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 6) AS missing_percent FROM ({GAPS})""", GAP_COLUMNS))
def missing_cells(spark, folder):
    return rounded(profile.missing(gaps(spark, folder)), {"missing_percent": 6})


@query(_each(f"""SELECT '$c' AS "column", count(DISTINCT $c) AS "distinct" FROM ({GAPS})""", GAP_COLUMNS))
def distinct_cells(spark, folder):
    return profile.distinct_counts(gaps(spark, folder))


@query(_each("""SELECT * FROM (SELECT '$c' AS "column", $c AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, $c) AS position
  FROM part GROUP BY $c) WHERE position <= 5""", ["p_name", "p_brand", "p_type"]))  # fmt: skip
def top_values(spark, folder):
    return profile.top_values(load(spark, folder, "part")).withColumn("position", F.col("position").cast("long"))


@query(_each("""SELECT '$c' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (
  SELECT $c AS v, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem) GROUP BY 1)""",
  ["l_returnflag", "l_linestatus"]))
def categorical_profile(spark, folder):
    df = load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount")
    return profile.categorical_stats(df)


@query("""
SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicated_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax)
""")
def duplicate_rows(spark, folder):
    return profile.duplicate_counts(load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"))


MESSY = """SELECT c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_name END AS name,
  CASE WHEN c_nationkey < 3 THEN 'bad-date' WHEN c_nationkey < 6 THEN NULL ELSE '2024-01-' || lpad((c_nationkey)::VARCHAR, 2, '0') END AS signup_date,
  NULL::DOUBLE AS unused, c_nationkey AS nation FROM customer"""


def messy(spark, folder):
    key = F.col("c_nationkey")
    day = F.concat(F.lit("2024-01-"), F.lpad(key.cast("string"), 2, "0"))
    return load(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(key < 3, "bad-date").when(key >= 6, day).alias("signup_date"), F.lit(None).cast("double").alias("unused"), key.alias("nation"),
    )


@query(f"""
WITH m AS ({MESSY}), n AS (SELECT count(*) AS rows FROM m),
g AS (SELECT coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS d FROM (SELECT count(*) AS c FROM m GROUP BY segment, name, signup_date, unused, nation)),
s AS (SELECT count(*) FILTER (segment IS NULL OR trim(segment) = '') + count(*) FILTER (name IS NULL OR trim(name) = '')
        + count(*) FILTER (signup_date IS NULL) + count(*) AS missing, count(signup_date) AS dates, count(*) FILTER (signup_date = 'bad-date') AS bad FROM m)
SELECT rows, 5 AS columns, missing AS missing_cells, d AS duplicated_rows, bad AS invalid_dates, dates AS date_cells, 1 AS empty_columns,
       round(25.0::DOUBLE * (4 - missing / (rows * 5.0::DOUBLE) - d / rows::DOUBLE - bad / dates::DOUBLE - 0.2::DOUBLE), 2) AS quality_score,
       CASE WHEN round(25.0 * (4 - missing / (rows * 5.0) - d / rows - bad / dates - 0.2), 2) >= 90 THEN 'Excellent'
            WHEN round(25.0 * (4 - missing / (rows * 5.0) - d / rows - bad / dates - 0.2), 2) >= 75 THEN 'Good' ELSE 'Fair' END AS quality_grade
FROM n, g, s
""")
def data_quality_score(spark, folder):
    return profile.quality_score(messy(spark, folder))


@query("""
WITH a AS (SELECT l_returnflag, l_linestatus, nullif(l_tax, 0.0) AS tax FROM lineitem), b AS (SELECT DISTINCT * FROM a WHERE tax IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM a WHERE tax IS NULL) AS missing_before,
       (SELECT count(*) FROM a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS duplicates_before,
       (SELECT count(*) FROM b) AS rows_after, 0 AS missing_after, 0 AS duplicates_after,
       (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS rows_removed, 0 AS columns_removed
""")
def before_after_comparison(spark, folder):
    before = load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return profile.cleaning_comparison(before, cleaning.drop_missing(before, ["tax"]).distinct())


@query("\nUNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr({a}, {b}), 1.0), 3) AS correlation FROM lineitem" for a in NUMBERS for b in NUMBERS
))
def correlation_matrix(spark, folder):
    return profile.correlation(line_numbers(spark, folder))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def extreme_row(spark, folder):
    return profile.extreme_row(load(spark, folder, "orders"), "o_totalprice", True, ["o_orderkey"])


@query("""SELECT round(avg(p_retailprice), 6) AS average_p_retailprice, round(sum(p_retailprice), 2) AS total_p_retailprice, count(*) AS row_count,
  count(DISTINCT p_retailprice) AS distinct_p_retailprice FROM part""")  # fmt: skip
def single_values(spark, folder):
    return rounded(profile.single_values(load(spark, folder, "part"), "p_retailprice"), {"average_p_retailprice": 6, "total_p_retailprice": 2})


@query("SELECT DISTINCT p_type FROM part")
def distinct_list(spark, folder):
    return profile.distinct_values(load(spark, folder, "part"), "type")


@query("SELECT n_name, n_regionkey FROM nation WHERE lower(n_name) LIKE '%nation_1%' ORDER BY n_nationkey LIMIT 1")
def attribute_of_named_row(spark, folder):
    return profile.attribute_of(load(spark, folder, "nation"), "n_name", "nation_1", "n_regionkey", ["n_nationkey"])


@query(_each("""SELECT '$c' AS "column", count(*) AS rows, count($c) AS filled, count(DISTINCT $c) AS "distinct",
  round(count(*) FILTER (TRY_CAST($c AS DOUBLE) IS NOT NULL) / count(*)::DOUBLE, 6) AS numeric_ratio,
  round(count(*) FILTER (lower(trim($c::VARCHAR)) IN ('yes','no','y','n','true','false','0','1','on','off','enabled','disabled','available','not available','open','closed')) / count($c)::DOUBLE, 6) AS boolean_ratio,
  round(count(DISTINCT $c) / count($c)::DOUBLE, 6) AS unique_ratio, round((count(*) - count($c)) / count(*)::DOUBLE, 6) AS missing_ratio
  FROM lineitem""", ["l_linenumber", "l_returnflag", "l_quantity"]))  # fmt: skip
def column_ratios(spark, folder):
    found = profile.ratio_profile(load(spark, folder, "lineitem"), ["l_linenumber", "l_returnflag", "l_quantity"]).drop("datetime_ratio", "mean_length")
    return rounded(found, dict.fromkeys(["numeric_ratio", "boolean_ratio", "unique_ratio", "missing_ratio"], 6))


@query("""
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS "distinct", 'few' AS band FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 'moderate' FROM orders
UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey), 'continuous' FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 'discrete' FROM orders
UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'continuous' FROM orders
""")
def cardinality_bands(spark, folder):
    return profile.cardinality_bands(load(spark, folder, "orders"))


@query("""
SELECT 'delivery' AS "column", 3 AS "distinct", false AS boolean_like UNION ALL SELECT 'flag', count(DISTINCT o_orderstatus = 'F'), true FROM orders
""")
def boolean_columns(spark, folder):
    status = F.col("o_orderstatus")
    df = load(spark, folder, "orders").select(
        F.when(status == "F", "yes").when(status == "O", "no").otherwise("later").alias("delivery"), F.when(status == "F", "Y").otherwise("n ").alias("flag")
    )
    return profile.boolean_like(df)


# ---- cleaning ---------------------------------------------------------------


@query(f"SELECT o_orderkey, status, round(coalesce(price, (SELECT avg(price) FROM ({GAPS}))), 6) AS price FROM ({GAPS})")
def fill_mean(spark, folder):
    return rounded(cleaning.fill_missing(gaps(spark, folder), "mean", ["price"]).select("o_orderkey", "status", "price"), {"price": 6})


@query(f"""
SELECT o_orderkey, coalesce(status, (SELECT status FROM ({GAPS}) WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status,
       round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ({GAPS}))), 6) AS price FROM ({GAPS})
""")
def fill_smart(spark, folder):
    return rounded(cleaning.fill_missing(gaps(spark, folder), "smart").select("o_orderkey", "status", "price"), {"price": 6})


@query(f"SELECT o_orderkey, coalesce(status, 'none') AS status FROM ({GAPS})")
def fill_literal(spark, folder):
    return cleaning.fill_missing(gaps(spark, folder), "custom", ["status"], "none").select("o_orderkey", "status")


@query(f"""
SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS price FROM ({GAPS})
""")
def fill_forward(spark, folder):
    return cleaning.forward_fill(gaps(spark, folder), ["o_orderkey"], ["price"]).select("o_orderkey", "price")


@query(f"""
SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS price FROM ({GAPS})
""")
def fill_forward_by_group(spark, folder):
    return cleaning.forward_fill(gaps(spark, folder), ["o_orderkey"], ["price"], ["o_orderpriority"]).select("o_orderkey", "price")


@query(f"SELECT * FROM ({GAPS}) WHERE status IS NOT NULL AND price IS NOT NULL")
def drop_rows_with_gaps(spark, folder):
    return cleaning.drop_missing(gaps(spark, folder), ["status", "price"])


@query(f"SELECT status, price FROM ({GAPS}) WHERE status IS NOT NULL OR price IS NOT NULL")
def drop_empty_rows(spark, folder):
    return cleaning.drop_empty_rows(gaps(spark, folder).select("status", "price"))


@query(f"SELECT * FROM ({GAPS}) WHERE ((status IS NULL)::INT + (price IS NULL)::INT) / 4.0 <= 0.25")
def drop_sparse_rows(spark, folder):
    return cleaning.drop_sparse_rows(gaps(spark, folder), 0.25)


@query("""
SELECT p_partkey, nullif(trim(name), '') AS name FROM (
  SELECT p_partkey, CASE WHEN p_size < 5 THEN '   ' WHEN p_size < 10 THEN ' ' || p_name || '  ' ELSE p_name END AS name FROM part)
""")
def blank_to_null(spark, folder):
    size, name = F.col("p_size"), F.col("p_name")
    padded = F.when(size < 5, "   ").when(size < 10, F.concat(F.lit(" "), name, F.lit("  "))).otherwise(name)
    return cleaning.blank_to_null(load(spark, folder, "part").select("p_partkey", padded.alias("name")))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalise_text(spark, folder):
    return cleaning.normalise_text(load(spark, folder, "documents").select("doc_id", "text"))


@query(r"SELECT 'text' AS \"column\", count(*) FILTER (trim(regexp_replace(text, '\s+', ' ', 'g')) <> text) AS changed FROM documents".replace('\\"', '"'))
def text_changes(spark, folder):
    return cleaning.text_changes(load(spark, folder, "documents").select("text"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_whole_rows(spark, folder):
    return cleaning.remove_duplicates(load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_keep_first(spark, folder):
    return cleaning.remove_duplicates(load(spark, folder, "orders"), ["o_custkey"], "first", ["o_orderdate", "o_orderkey"])


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def dedup_keep_last(spark, folder):
    return cleaning.remove_duplicates(load(spark, folder, "orders"), ["o_custkey"], "last", ["o_orderdate", "o_orderkey"])


@query("SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE n = 1")
def dedup_keep_none(spark, folder):
    return cleaning.remove_duplicates(load(spark, folder, "orders"), ["o_custkey", "o_orderstatus"], False)


TAILED = "SELECT o_orderkey, o_totalprice * o_totalprice / 1e6 AS price FROM orders"
CUTS = f"SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM ({TAILED})"


def tailed(spark, folder):
    price = F.col("o_totalprice") * F.col("o_totalprice") / 1e6
    return load(spark, folder, "orders").select("o_orderkey", price.alias("price"))


@query(f"SELECT o_orderkey, round(least(greatest(price, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 6) AS price FROM ({TAILED}), ({CUTS})")
def outliers_cap(spark, folder):
    return rounded(cleaning.cap_outliers(tailed(spark, folder), ["price"], 0.5), {"price": 6})


@query(f"SELECT o_orderkey FROM ({TAILED}), ({CUTS}) WHERE price BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)")
def outliers_remove(spark, folder):
    return cleaning.remove_outliers(tailed(spark, folder), ["price"], 0.5).select("o_orderkey")


@query(f"SELECT o_orderkey, NOT (price BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS price_is_outlier FROM ({TAILED}), ({CUTS})")
def outliers_mark(spark, folder):
    return cleaning.mark_outliers(tailed(spark, folder), ["price"], 0.5).select("o_orderkey", "price_is_outlier")


@query("""
SELECT unnest([{'column': 'o_orderkey', 'kind': 'numeric'}, {'column': 'status', 'kind': 'categorical'}, {'column': 'text_price', 'kind': 'numeric'},
  {'column': 'day', 'kind': 'datetime'}, {'column': 'label', 'kind': 'text'}, {'column': 'nothing', 'kind': 'empty'}], recursive := true)
FROM (SELECT count(*) FROM orders)
""")
def column_kinds(spark, folder):
    return cleaning.kind_table(typed_as_text(spark, folder)).drop("mode")


def typed_as_text(spark, folder):
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("string").alias("text_price"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"),
        F.lit(None).cast("string").alias("nothing"),
    )


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus AS status, o_totalprice AS text_price, o_orderdate AS day FROM orders")
def infer_types(spark, folder):
    return cleaning.to_inferred_types(typed_as_text(spark, folder).drop("label", "nothing"))


@query(f"""
SELECT DISTINCT coalesce(status, 'Unknown') AS status, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM (SELECT DISTINCT status, price FROM ({GAPS}))))
  AS price FROM (SELECT DISTINCT status, price FROM ({GAPS}))
""")
def quick_clean(spark, folder):
    return cleaning.quick_clean(gaps(spark, folder).select("status", "price"))[0].distinct()


@query(f"""
SELECT order_key, status, round(price, 4) AS price, round(price * 83.5, 4) AS "price_INR" FROM (
  SELECT o_orderkey AS order_key, status, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ({GAPS}))) AS price,
         row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_orderkey) AS rn FROM ({GAPS}))
WHERE rn = 1 AND price > 60000
""")
def cleaning_steps(spark, folder):
    df = gaps(spark, folder).withColumn("pair", F.floor(F.col("o_orderkey") / 2)).withColumnRenamed("o_orderkey", "Order-Key").drop("o_orderpriority")
    run = run_steps(df, [
        {"op": "standardize_columns"}, {"op": "fill_nulls", "column": "price", "method": "median"},
        {"op": "convert_currency", "column": "price", "rate": 83.5, "to": "INR"}, {"op": "no_such_step"}, {"op": "fill_nulls", "column": "colour"},
        {"op": "remove_duplicates", "subset": ["pair"], "order_by": ["order_key"]},
        {"op": "filter_rows", "column": "price", "operator": "greater_than", "value": 60000},
    ])
    return rounded(run.table.drop("pair"), {"price": 4, "price_INR": 4})


@query(f"""
SELECT unnest([{{'step': 1, 'op': 'fill_nulls', 'status': 'done', 'rows_before': n, 'rows_after': n, 'cells_filled': m}},
               {{'step': 2, 'op': 'filter_rows', 'status': 'done', 'rows_before': n, 'rows_after': k, 'cells_filled': 0}},
               {{'step': 3, 'op': 'no_such_step', 'status': 'skipped', 'rows_before': k, 'rows_after': k, 'cells_filled': 0}}], recursive := true)
FROM (SELECT count(*) AS n, count(*) FILTER (status IS NULL) AS m, count(*) FILTER (price IS NULL OR price <> 60000) AS k FROM ({GAPS}) WHERE true)
""")
def cleaning_steps_report(spark, folder):
    run = run_steps(gaps(spark, folder), [{"op": "fill_nulls", "column": "status", "method": "mode"},
                                          {"op": "filter_rows", "column": "price", "operator": "not_equals", "value": 60000}, {"op": "no_such_step"}])
    return run.report().drop("error")


@query(f"""
SELECT order_key, status, price FROM (SELECT o_orderkey AS order_key,
  coalesce(status, (SELECT status FROM ({GAPS}) WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status,
  coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ({GAPS}))) AS price FROM ({GAPS}))
""")
def full_cleaning(spark, folder):
    df = gaps(spark, folder).withColumnRenamed("o_orderkey", "Order Key").drop("o_orderpriority")
    return full_clean(df.unionByName(df)).table


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_linenumber = 2 THEN (l_quantity * l_extendedprice) / l_extendedprice ELSE l_quantity END, 6)
  AS qty FROM lineitem
""")
def back_solve_operand(spark, folder):
    df = load(spark, folder, "lineitem").withColumns({
        "qty": F.when(F.col("l_linenumber") != 2, F.col("l_quantity")), "total": F.col("l_quantity") * F.col("l_extendedprice")})
    done = cleaning.back_solve(df, {"qty": "total / l_extendedprice"})
    return rounded(done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty"), {"qty": 6})


@query("""
SELECT unnest([{'column': '(any column)', 'changed': count(*) FILTER (p_size < 10 OR p_type = 'PROMO')}, {'column': 'p_size', 'changed': count(*) FILTER (p_size < 10)},
  {'column': 'p_type', 'changed': count(*) FILTER (p_type = 'PROMO')}], recursive := true) FROM part
""")
def change_counts(spark, folder):
    before = load(spark, folder, "part").select("p_partkey", "p_size", "p_type")
    after = before.withColumns({"p_size": F.when(F.col("p_size") >= 10, F.col("p_size")), "p_type": F.regexp_replace("p_type", "PROMO", "promo")})
    return cleaning.change_counts(before, after, ["p_partkey"])


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS name_part1, split_part(p_name, ' ', 2) AS name_part2, p_size::VARCHAR AS size FROM part")
def replay_transformations(spark, folder):
    recorded = [("rename_columns", {"mapping": {"p_name": "name", "p_size": "size"}}), ("split_column", {"column": "name", "delimiter": " "}),
                ("type_conversion", {"column": "size", "target_type": "string"}), ("drop_columns", {"columns": ["name"]})]
    return TRANSFORMATIONS.replay(load(spark, folder, "part").select("p_partkey", "p_name", "p_size"), recorded)


@query("""
SELECT 'removed' AS side, l_returnflag, l_linenumber FROM (SELECT l_returnflag, l_linenumber FROM lineitem EXCEPT ALL SELECT CASE WHEN l_quantity > 40 THEN 'Z' ELSE l_returnflag END, l_linenumber FROM lineitem)
UNION ALL SELECT 'added', f, l_linenumber FROM (SELECT CASE WHEN l_quantity > 40 THEN 'Z' ELSE l_returnflag END AS f, l_linenumber FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem)
""")
def row_difference(spark, folder):
    before = load(spark, folder, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    after = before.withColumn("l_returnflag", F.when(F.col("l_quantity") > 40, "Z").otherwise(F.col("l_returnflag")))
    return cleaning.row_difference(before.drop("l_quantity"), after.drop("l_quantity"))


@query("SELECT o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY md5(o_totalprice::VARCHAR || ':0'), o_totalprice LIMIT 500")
def column_sample(spark, folder):
    return profile.column_sample(load(spark, folder, "orders"), "o_totalprice", 500)


# ---- projections ------------------------------------------------------------


@query("SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#1'), '') || '/' || p_type || '/' || p_size AS label FROM part")
def merge_columns(spark, folder):
    df = load(spark, folder, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#1")))
    return projection.merge_columns(df, ["p_brand", "p_type", "p_size"], "/", "label").select("p_partkey", "label")


@query("SELECT p_partkey, split_part(p_brand, '#', 1) AS p_brand_part1, split_part(p_brand, '#', 2) AS p_brand_part2 FROM part")
def split_column(spark, folder):
    return projection.split_column(load(spark, folder, "part"), "p_brand", "#").select("p_partkey", "p_brand_part1", "p_brand_part2")


@query("""
SELECT 'text' AS "column", 'int' AS target, count(*) AS filled, count(*) FILTER (p_size < 20) AS failed FROM part
UNION ALL SELECT 'text', 'datetime', count(*), count(*) FROM part
""")
def conversion_failures(spark, folder):
    df = load(spark, folder, "part").select(F.when(F.col("p_size") < 20, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise(
        F.col("p_size").cast("string")).alias("text"))
    return projection.conversion_failures(df, "text", "int").unionByName(projection.conversion_failures(df, "text", "datetime"))


@query("""
SELECT p_partkey, round_even(p_size / 2.0, 0)::BIGINT AS half, p_size::DOUBLE AS size_number, CASE p_type WHEN 'PROMO' THEN true WHEN 'SMALL' THEN false END AS flag FROM part
""")
def type_conversion(spark, folder):
    kind = F.col("p_type")
    df = load(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") / 2.0).cast("string").alias("half"), F.col("p_size").cast("string").alias("size_number"),
        F.when(kind == "PROMO", "Yes").when(kind == "SMALL", "off").otherwise(kind).alias("flag"),
    )
    for column, target in (("half", "int"), ("size_number", "float"), ("flag", "bool")):
        df = projection.convert_type(df, column, target)
    return df


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + l_tax / 2, 6) AS net FROM lineitem")
def computed_column(spark, folder):
    df = projection.computed_column(load(spark, folder, "lineitem"), "net", "l_extendedprice * (1 - l_discount) + l_tax / 2")
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net"), {"net": 6})


@query("""
SELECT CASE WHEN abs(l_extendedprice - l_quantity * 2000) <= 15000 THEN 'Match' ELSE 'Mismatch' END AS near,
       CASE WHEN l_discount > l_tax THEN 'more' ELSE 'less' END AS side, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def check_columns(spark, folder):
    df = projection.check_column(load(spark, folder, "lineitem"), "near", "l_extendedprice", "l_quantity * 2000", tolerance=15000)
    df = projection.check_column(df, "side", "l_discount", "l_tax", ">", match="more", mismatch="less")
    return df.groupBy("near", "side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS nation_key, n_name AS name_of_nation FROM nation")
def standard_headers(spark, folder):
    return projection.standardise_names(load(spark, folder, "nation").select(F.col("n_nationkey").alias(" Nation-Key"), F.col("n_name").alias("Name (of) Nation")))


@query("""SELECT s_suppkey AS "FIELD_01", s_name AS "FIELD_02", s_nationkey AS "FIELD_03", s_acctbal AS "FIELD_04" FROM supplier""")
def anonymous_columns(spark, folder):
    return names.anonymise_columns(load(spark, folder, "supplier"))[0]


@query("""SELECT '{"p_partkey":' || p_partkey || ',"half":' || CASE WHEN p_size = 10 THEN 'null' ELSE (p_size / 2.0)::DOUBLE::VARCHAR END || ',"p_name":"' || p_name || '"}' AS json FROM part""")
def json_safe_rows(spark, folder):
    half = F.when(F.col("p_size") == 10, F.lit(float("nan"))).otherwise(F.col("p_size") / 2.0)
    return projection.json_safe(load(spark, folder, "part").select("p_partkey", half.alias("half"), "p_name"))


@query("""SELECT event_id, '{"k":' || (props ->> '$.k') || '}' AS props FROM events""")
def allowed_payload(spark, folder):
    payload = F.concat(F.lit('{"query_text":"secret","k":'), F.get_json_object("props", "$.k"), F.lit(',"rows":[1,2]}'))
    return projection.keep_allowed(load(spark, folder, "events").select("event_id", payload.alias("props")), "props", "k long")


# ---- binning and dates ------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'below 10' WHEN p_size BETWEEN 10 AND 20 THEN '10-20' WHEN p_size BETWEEN 20 AND 35 THEN '20-35'
  WHEN p_size > 45 THEN 'above 45' ELSE 'Out of Range' END AS p_size_Range FROM part
""")
def bin_by_tokens(spark, folder):
    df = binning.bin_column(load(spark, folder, "part"), "p_size", ["below 10", "10-20", "20 to 35", "above 45"])
    label = F.when(F.col("p_size_Range") == "20 to 35", "20-35").otherwise(F.col("p_size_Range"))
    return df.select("p_partkey", label.alias("p_size_Range"))


@query("""
WITH m AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 5 AS w, max(c_acctbal) AS hi FROM customer),
e AS (SELECT i, lo + i * w AS a, CASE WHEN i = 4 THEN hi ELSE lo + (i + 1) * w END AS b FROM m, range(5) t(i))
SELECT i AS bin_number, count(*) AS n FROM (
  SELECT (SELECT min(i) FROM e WHERE c_acctbal >= a AND c_acctbal <= b) AS i FROM customer) GROUP BY 1
""")
def bin_automatically(spark, folder):
    df = load(spark, folder, "customer")
    labels = binning.auto_ranges(df, "c_acctbal")
    numbered = F.coalesce(*[F.when(F.col("bin") == label, F.lit(i)) for i, label in enumerate(labels)])
    return binning.bin_counts(df, "c_acctbal").select(numbered.cast("long").alias("bin_number"), "n")


@query("""
SELECT l.label, count(*) AS n FROM part p JOIN (VALUES (0.0, 10.0, '0-10'), (11.0, 30.0, '11-30'), (31.0, 50.0, '31-50')) l(low, high, label)
  ON p.p_size BETWEEN l.low AND l.high GROUP BY 1
""")
def bin_by_range_table(spark, folder):
    ranges = F.broadcast(binning.range_table(load(spark, folder, "part"), ["0-10", "11-30", "31-50"]))
    sizes = load(spark, folder, "part").groupBy(F.col("p_size").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return sizes.join(ranges, (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy("label").agg(F.sum("c").alias("n"))


@query("""
SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day,
       dayname(o_orderdate) AS o_orderdate_weekday, quarter(o_orderdate)::INT AS o_orderdate_quarter, weekofyear(o_orderdate)::INT AS o_orderdate_week,
       monthname(o_orderdate) AS month_label FROM orders
""")
def date_features(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    parts = binning.date_features(df, "o_orderdate", ["year", "month", "day", "weekday", "quarter", "week"])
    return parts.withColumn("month_label", binning.month_label(F.col("o_orderdate"))).drop("o_orderdate")


@query(f"""SELECT 'signup_date' AS "column", count(signup_date) AS filled, count(*) FILTER (signup_date = 'bad-date') AS invalid,
  round(count(*) FILTER (signup_date <> 'bad-date') / count(signup_date)::DOUBLE, 6) AS valid_ratio FROM ({MESSY})""")  # fmt: skip
def date_validity(spark, folder):
    return rounded(binning.date_validity(messy(spark, folder), "signup_date"), {"valid_ratio": 6})


# ---- currency ---------------------------------------------------------------

PRICES = """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'US$ ' || printf('%.2f', p_retailprice) WHEN 'SMALL' THEN printf('%.2f', p_retailprice) || ' euros'
  WHEN 'LARGE' THEN 'Rs. ' || printf('%.2f', p_retailprice) WHEN 'MEDIUM' THEN 'on request' ELSE printf('%.2f', p_retailprice) END AS price,
  p_type, p_retailprice FROM part"""


def prices(spark, folder):
    kind, text = F.col("p_type"), F.format_string("%.2f", F.col("p_retailprice"))
    shown = (
        F.when(kind == "PROMO", F.concat(F.lit("US$ "), text)).when(kind == "SMALL", F.concat(text, F.lit(" euros")))
        .when(kind == "LARGE", F.concat(F.lit("Rs. "), text)).when(kind == "MEDIUM", "on request").otherwise(text)
    )
    return load(spark, folder, "part").select("p_partkey", shown.alias("price"), "p_type", "p_retailprice")


CODE = "CASE p_type WHEN 'PROMO' THEN 'USD' WHEN 'SMALL' THEN 'EUR' WHEN 'LARGE' THEN 'INR' END"


@query(f"SELECT p_partkey, {CODE} AS code, CASE WHEN p_type <> 'MEDIUM' THEN round(p_retailprice, 2) END AS amount FROM ({PRICES})")
def currency_detect(spark, folder):
    return prices(spark, folder).select("p_partkey", currency.currency_code(F.col("price")).alias("code"), currency.amount(F.col("price")).alias("amount"))


@query(f"""
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'USD ' || printf('%.2f', p_retailprice) WHEN 'SMALL' THEN 'EUR ' || printf('%.2f', p_retailprice)
  WHEN 'LARGE' THEN '₹' || format('{{:,.2f}}', p_retailprice) ELSE price END AS standard FROM ({PRICES})
""")
def currency_standardise(spark, folder):
    return prices(spark, folder).select("p_partkey", currency.standard_amount(F.col("price")).alias("standard"))


RATES = [("USD", "INR", 83.5), ("EUR", "INR", 90.25), ("GBP", "INR", 105.0)]


def rates(spark):
    return spark.createDataFrame(RATES, "`from` string, `to` string, rate double")


@query(f"""
SELECT p_partkey, changed, round(value, 4) AS value FROM (SELECT p_partkey, p_type IN ('PROMO', 'SMALL') AS changed,
  CASE p_type WHEN 'PROMO' THEN p_retailprice * 83.5 WHEN 'SMALL' THEN p_retailprice * 90.25 WHEN 'MEDIUM' THEN NULL ELSE p_retailprice END AS value FROM ({PRICES}))
""")
def currency_convert_text(spark, folder):
    df = money.convert_text(prices(spark, folder), "price", "INR", rates(spark), "inr")
    return df.select("p_partkey", F.col("inr_changed").alias("changed"), r(F.col("inr").try_cast("double"), 4, "value"))


@query("""
SELECT p_partkey, round(CASE code WHEN 'USD' THEN p_retailprice * 83.5 WHEN 'INR' THEN p_retailprice END, 4) AS inr FROM (
  SELECT p_partkey, p_retailprice, CASE WHEN p_size < 20 THEN 'USD' WHEN p_size < 40 THEN 'INR' ELSE 'XXX' END AS code FROM part)
""")
def currency_convert_by_rates(spark, folder):
    size = F.col("p_size")
    df = load(spark, folder, "part").select("p_partkey", "p_retailprice", F.when(size < 20, "usd").when(size < 40, "INR").otherwise("XXX").alias("code"), F.lit("INR").alias("target"))
    done = money.convert_by_rates(df, "p_retailprice", "code", "target", rates(spark), "inr")
    return rounded(done.select("p_partkey", "inr"), {"inr": 4})


@query("SELECT code AS code, 'INR' AS target, n FROM (SELECT 'XXX' AS code, count(*) AS n FROM part WHERE p_size >= 40)")
def currency_unconverted(spark, folder):
    size = F.col("p_size")
    df = load(spark, folder, "part").select("p_retailprice", F.when(size < 20, "usd").when(size < 40, "INR").otherwise("XXX").alias("code"), F.lit("INR").alias("target"))
    return money.unconverted(money.convert_by_rates(df, "p_retailprice", "code", "target", rates(spark), "inr"), "code", "target", "inr")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'FURNITURE' THEN 'GBP' WHEN 'MACHINERY' THEN 'HKD' WHEN 'HOUSEHOLD' THEN 'RUB' END AS code FROM customer""")
def currency_names(spark, folder):
    seg = F.col("c_mktsegment")
    named = F.when(seg == "BUILDING", " US  Dollars").when(seg == "FURNITURE", "pay in pounds, please").when(seg == "MACHINERY", "HK$").when(seg == "HOUSEHOLD", "Roubles")
    return load(spark, folder, "customer").select("c_custkey", currency.currency_from_name(named).alias("code"))
