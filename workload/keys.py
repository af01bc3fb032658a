"""Queries for column roles, keys across tables, places and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import matching, roles

from .common import load, r, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


CONTACTS = """SELECT c_custkey AS customer_id, c_nationkey AS nation_id, c_acctbal AS account_balance, c_mktsegment AS segment,
  c_name || '@mail.example' AS mail, '+1 555 ' || lpad(c_custkey::VARCHAR, 7, '0') AS phone, '2024-01-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') AS joined,
  c_nationkey / 25.0::DOUBLE AS discount FROM customer"""


def contacts(spark, folder):
    key = F.col("c_nationkey")
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), key.alias("nation_id"), F.col("c_acctbal").alias("account_balance"), F.col("c_mktsegment").alias("segment"),
        F.concat(F.col("c_name"), F.lit("@mail.example")).alias("mail"), F.concat(F.lit("+1 555 "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"),
        F.concat(F.lit("2024-01-"), F.lpad((key + 1).cast("string"), 2, "0")).alias("joined"), (key / 25.0).alias("discount"),
    )


@query(f"""
WITH t AS ({CONTACTS}), n AS (SELECT count(*)::DOUBLE AS rows FROM t)
SELECT "column", role, round(confidence, 4)::DOUBLE AS confidence, rule FROM (
  SELECT 'customer_id' AS "column", 'primary_key' AS role, 1.0 AS confidence, 'primary_key' AS rule
  UNION ALL SELECT 'nation_id', 'foreign_key_candidate', 0.6, 'foreign_key_candidate'
  UNION ALL SELECT 'account_balance', 'currency', 0.55, 'currency'
  UNION ALL SELECT 'segment', 'category', 1 - count(DISTINCT segment) / (SELECT rows FROM n), 'category' FROM t
  UNION ALL SELECT 'mail', 'email', count(*) FILTER (regexp_matches(mail, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+')) / (SELECT rows FROM n), 'email' FROM t
  UNION ALL SELECT 'phone', 'phone', count(*) FILTER (regexp_matches(phone, '^\\+?[\\d\\s\\-().]{{7,20}}$')) / (SELECT rows FROM n), 'phone' FROM t
  UNION ALL SELECT 'joined', CASE WHEN d > 0.85 THEN 'category' ELSE 'date' END, greatest(d, 0.85), CASE WHEN d > 0.85 THEN 'category' ELSE 'date' END
    FROM (SELECT 1 - count(DISTINCT joined) / (SELECT rows FROM n) AS d FROM t)
  UNION ALL SELECT 'discount', 'percentage', 1.0, 'percentage')
""")
def column_roles(spark, folder):
    return roles.column_roles(contacts(spark, folder), "contacts").select("column", "role", r("confidence", 4), "rule")


@query()
def column_role_candidates(spark, folder):
    return roles.column_candidates(contacts(spark, folder), "contacts").select("column", "role", "confidence", "rule", F.map_keys("evidence").alias("evidence_keys"))


# What the words of the headers point to; the values decide whether that holds.
NAMED = "(VALUES (1, 'customer_id', 'identifier'), (2, 'nation_id', 'identifier'), (3, 'account_balance', 'customer_entity'), (4, 'segment', 'category'), (5, 'mail', 'email'), (6, 'phone', 'phone'), (7, 'joined', NULL), (8, 'discount', 'numeric_metric')) h(position, \"column\", named)"


@query(f"""
WITH t AS ({CONTACTS}), u AS (UNPIVOT (SELECT customer_id::VARCHAR AS customer_id, nation_id::VARCHAR AS nation_id, account_balance::VARCHAR AS account_balance, segment, mail, phone, joined, discount::VARCHAR AS discount FROM t)
  ON customer_id, nation_id, account_balance, segment, mail, phone, joined, discount INTO NAME "column" VALUE v),
m AS (SELECT "column", count(TRY_CAST(v AS DOUBLE)) / count(*)::DOUBLE AS numbers, count(TRY_CAST(v AS DATE)) / count(*)::DOUBLE AS dates, count(DISTINCT v) / count(*)::DOUBLE AS unique_ratio FROM u GROUP BY 1)
SELECT position::INT AS position, "column", 'c' || position AS column_id,
  CASE WHEN dates >= 0.8 AND numbers < 0.9 THEN 'date' WHEN numbers >= 0.9 THEN 'numeric_metric' ELSE named END AS role,
  1.0::DOUBLE AS confidence, round(unique_ratio, 3) AS unique_ratio FROM m JOIN {NAMED} USING ("column")
""")
def semantic_roles(spark, folder):
    return roles.semantic_roles(contacts(spark, folder))


@query("""
SELECT unnest([{'column': 'doc_id', 'operation': 'identifier'}, {'column': 'text', 'operation': 'free_text'}, {'column': 'lang', 'operation': 'categorical_normalization'},
  {'column': 'source', 'operation': 'categorical_normalization'}, {'column': 'n_chars', 'operation': 'numeric_measure'}], recursive := true) FROM (SELECT count(*) FROM documents)
""")
def column_operations(spark, folder):
    return roles.column_operations(load(spark, folder, "documents"))


@query("""
WITH t AS (SELECT o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS b, o_orderkey::VARCHAR AS c, CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS d FROM orders)
SELECT 'a' AS column_a, 'c' AS column_b, 1.0::DOUBLE AS equal_ratio UNION ALL
SELECT 'b', 'd', round(avg((b IS NOT DISTINCT FROM d)::INT), 4) FROM t
""")
def duplicate_columns(spark, folder):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    df = load(spark, folder, "orders").select(key.alias("a"), customer.alias("b"), key.cast("string").alias("c"), F.when(key % 100 != 0, customer).alias("d"))
    return roles.duplicate_columns(df)


@query("""
WITH t AS (SELECT row_number() OVER () AS r, o_custkey AS k, o_orderkey AS o FROM orders),
v AS (SELECT r, i, CASE WHEN i % 4 = 3 AND o % (i + 50) = 0 THEN NULL WHEN i % 4 = 2 THEN (k % (i // 8 + 1))::VARCHAR ELSE ((k * 31 + o) % (i // 4 * 7 + 3))::VARCHAR END AS v
      FROM t, (SELECT unnest(range(200)) AS i))
SELECT 'c' || a.i AS column_a, 'c' || b.i AS column_b, round(avg((a.v IS NOT DISTINCT FROM b.v)::INT), 4) AS equal_ratio
FROM v a JOIN v b ON a.r = b.r AND a.i < b.i GROUP BY a.i, b.i HAVING avg((a.v IS NOT DISTINCT FROM b.v)::INT) >= 0.98
""")
def duplicate_columns_wide(spark, folder):
    """200 columns: groups of equal ones, of nearly equal ones, and others."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")

    def column(i):
        value = (k % (i // 8 + 1) if i % 4 == 2 else (k * 31 + o) % (i // 4 * 7 + 3)).cast("string")
        return (F.when(o % (i + 50) != 0, value) if i % 4 == 3 else value).alias(f"c{i}")

    return roles.duplicate_columns(load(spark, folder, "orders").select(*[column(i) for i in range(200)]))


#: Whole tables; a key's name ends in "key" or "_id" here.
TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
SUFFIXES = ("key", "_id")


def links_sql(tables=None):
    cells = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {i} AS i, {c}::VARCHAR AS v FROM {t}" for t, columns in (tables or TABLES).items() for i, c in enumerate(columns.split()))
    return f"""
WITH d AS (SELECT t, c, i, v, count(*) AS n FROM ({cells}) GROUP BY t, c, i, v),
e AS (SELECT t, c, i, sum(n) AS total, sum(n) FILTER (v IS NOT NULL) AS filled, count(v) AS n FROM d GROUP BY t, c, i),
k AS (SELECT *, total > 1 AND round((n / total::DOUBLE) * (filled / total::DOUBLE) * 0.5, 4) >= 0.45 AS key_like,
             i > 0 AND (c LIKE '%key' OR c LIKE '%\\_id' ESCAPE '\\' OR (c LIKE '%id' AND length(c) > 2)) AS candidate FROM e),
s AS (SELECT a.t AS st, a.c AS sc, b.t AS tt, b.c AS tc, count(*) AS shared FROM (SELECT d.* FROM d JOIN k USING (t, c) WHERE candidate) a
      JOIN d b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT st AS source_dataset, sc AS source_column, tt AS target_dataset, tc AS target_column, round(shared / a.n::DOUBLE, 4) AS confidence
FROM s JOIN k a ON a.t = st AND a.c = sc JOIN k b ON b.t = tt AND b.c = tc WHERE shared / a.n::DOUBLE >= 0.8 AND (b.key_like OR lower(sc) = lower(tc))"""


@query(links_sql())
def key_relationships(spark, folder):
    return roles.relationships({t: load(spark, folder, t) for t in TABLES}, suffixes=SUFFIXES)


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT count(*) AS source_values, count(c.k) AS shared, round(count(c.k) / count(*)::DOUBLE, 6) AS overlap FROM o LEFT JOIN c USING (k)
""")
def key_value_overlap(spark, folder):
    found = roles.value_overlap(load(spark, folder, "orders"), "o_custkey", load(spark, folder, "customer").filter("c_acctbal > 0"), "c_custkey")
    return rounded(found, {"overlap": 6})


@query("""
SELECT 'orders' AS dataset, 'o_custkey' AS "column", 'foreign_key' AS role, 1.0::DOUBLE AS confidence FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'orders', 'o_orderkey', 'primary_key', 1.0 FROM (SELECT count(*) FROM orders)
""")
def key_roles_upgraded(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    links = roles.relationships({"orders": orders, "customer": load(spark, folder, "customer").select("c_custkey")}, {"orders": ["o_custkey"]})
    return roles.upgrade_foreign_keys(roles.column_roles(orders, "orders"), links).select("dataset", "column", "role", "confidence")


# ---- places -----------------------------------------------------------------

GAZETTEER = """SELECT 'City ' || n_name AS city, 'Region ' || r_name AS region, n_name AS country, n_nationkey * 3.0::DOUBLE - 36 AS latitude, n_nationkey * 13.0::DOUBLE - 160 AS longitude
  FROM nation JOIN region ON n_regionkey = r_regionkey"""
VISITS = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'City NATION_' || c_nationkey END AS city, CASE WHEN c_custkey % 4 = 1 THEN 'nation_' || c_nationkey WHEN c_custkey % 4 = 3 THEN 'X' END AS country,
  CASE WHEN c_custkey % 4 = 2 THEN c_nationkey * 3.0::DOUBLE - 36 + 0.1 END AS lat, CASE WHEN c_custkey % 4 = 2 THEN c_nationkey * 13.0::DOUBLE - 160 - 0.2 END AS lon FROM customer"""


def gazetteer(spark, folder):
    joined = load(spark, folder, "nation").join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return joined.select(
        F.concat(F.lit("City "), "n_name").alias("city"), F.concat(F.lit("Region "), "r_name").alias("region"), F.col("n_name").alias("country"),
        (key * 3.0 - 36).alias("latitude"), (key * 13.0 - 160).alias("longitude"),
    )


def visits(spark, folder):
    key, nation = F.col("c_custkey") % 4, F.col("c_nationkey")
    name = nation.cast("string")
    return load(spark, folder, "customer").select(
        "c_custkey", F.when(key == 0, F.concat(F.lit("City NATION_"), name)).alias("city"),
        F.when(key == 1, F.concat(F.lit("nation_"), name)).when(key == 3, "X").alias("country"),
        F.when(key == 2, nation * 3.0 - 36 + 0.1).alias("lat"), F.when(key == 2, nation * 13.0 - 160 - 0.2).alias("lon"),
    )


PLACE_COLUMNS = {"city": "city", "country": "country", "latitude": "lat", "longitude": "lon"}


@query(f"""
WITH g AS ({GAZETTEER}), v AS ({VISITS})
SELECT c_custkey, coalesce(v.city, g.city) AS city, coalesce(v.country, g.country) AS country, round(coalesce(lat, g.latitude), 6) AS lat, round(coalesce(lon, g.longitude), 6) AS lon,
  CASE WHEN g.city IS NULL THEN 0 WHEN c_custkey % 4 = 2 THEN 2 ELSE 3 END AS cells_filled
FROM v LEFT JOIN g ON CASE c_custkey % 4 WHEN 0 THEN lower(v.city) = lower(g.city) WHEN 1 THEN lower(v.country) = lower(g.country) WHEN 2 THEN abs(lat - g.latitude) < 0.5 ELSE false END
""")
def places_filled(spark, folder):
    done = matching.fill_places(visits(spark, folder), PLACE_COLUMNS, gazetteer(spark, folder))
    return rounded(done, {"lat": 6, "lon": 6})


@query(f"""
WITH g AS ({GAZETTEER}), p AS (SELECT DISTINCT lat, lon FROM ({VISITS}) WHERE lat IS NOT NULL),
d AS (SELECT lat, lon, country, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(g.latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - lon) / 2), 2)))) AS km FROM p, g)
SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, arg_min(country, km) AS country, round(min(km), 6) AS km FROM d GROUP BY d.lat, d.lon HAVING min(km) <= 50
""")
def places_nearest(spark, folder):
    points = visits(spark, folder).filter("lat is not null").select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).distinct()
    found = matching.nearest_places(points, gazetteer(spark, folder))
    return found.select(r("latitude", 4, "lat"), r("longitude", 4, "lon"), "place.country", r("place.distance_km", 6, "km"))


@query("""SELECT p_brand AS name, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'House ' || p_brand ELSE p_brand END AS resolved FROM part""")
def alias_lookup(spark, folder):
    brands = load(spark, folder, "part").select(F.col("p_brand").alias("name"))
    known = brands.distinct().filter(F.col("name").isin("Brand#1", "Brand#2"))
    aliases = known.select(F.upper("name").alias("alias"), F.concat(F.lit("House "), "name").alias("real_name"))
    return matching.resolve_aliases(brands, aliases)
