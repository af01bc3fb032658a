"""Queries for text, categories, personal data, JSON and question tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators import categories, insights, matching, renaming
from tablewright.sources.readers import explode_records

from .common import QUERY_LOG, load, query_log, r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


NORM = r"trim(regexp_replace(regexp_replace(lower($t), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
PLAIN = "trim(regexp_replace(lower($t), '[^a-z0-9]+', ' ', 'g'))"


def norm(c):
    return NORM.replace("$t", c)


def plain(c):
    return PLAIN.replace("$t", c)


# ---- categories -------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Unknown' END AS answer_standard FROM orders
""")
def category_truth_words(spark, folder):
    s = F.col("o_orderstatus")
    word = F.when(s == "F", F.when(F.col("o_orderkey") % 2 == 0, "Yess").otherwise(" TRUE")).when(s == "O", F.when(F.col("o_orderkey") % 2 == 0, "nooo").otherwise("0"))
    df = load(spark, folder, "orders").select("o_orderkey", word.otherwise("perhaps").alias("answer"))
    return categories.standardise(df, {"answer": "boolean"}).drop("answer")


COUNTRY = ["Idnia", "u.a.e", "SINGAPOR", "Untied States", "Rusia", "wakanda  land", "n/a", "Canadaa", "Frnce", "china", "indiana"]


@query("""
WITH names(i, raw, std) AS (VALUES (0, 'Idnia', 'India'), (1, 'u.a.e', 'United Arab Emirates'), (2, 'SINGAPOR', 'Singapore'), (3, 'Untied States', 'United States'),
  (4, 'Rusia', 'Russia'), (5, 'wakanda  land', 'Wakanda Land'), (6, 'n/a', 'Unknown'), (7, 'Canadaa', 'Canada'), (8, 'Frnce', 'Frnce'), (9, 'china', 'China'), (10, 'indiana', 'India'))
SELECT raw AS source, std AS target, count(*) AS n, 'country' AS "column" FROM customer JOIN names ON c_nationkey % 11 = i GROUP BY ALL
""")
def category_countries(spark, folder):
    raw = F.get(F.array(*[F.lit(c) for c in COUNTRY]), F.col("c_nationkey") % 11)
    return categories.value_mapping(load(spark, folder, "customer").select(raw.alias("country")), {"country": "country"})


@query("""
WITH v(i, city, c2, region, r2, gender, g2) AS (VALUES (0, 'Bombay', 'Mumbai', 'apac', 'Asia', 'M', 'Male'), (1, ' new   delhi', 'New Delhi', 'EU', 'Europe', 'femalle', 'Female'),
  (2, 'oslo', 'Oslo', 'Middle  East', 'Middle East', 'trans', 'Transgender'), (3, 'none', 'Unknown', '', 'Unknown', 'nb', 'Non-binary'), (4, 'NYC', 'New York', 'arctic zone', 'Arctic Zone', 'robot', 'Unknown'))
SELECT c_custkey, c2 AS city_standard, r2 AS region_standard, g2 AS gender_standard FROM customer JOIN v ON c_nationkey % 5 = i
""")
def category_places_and_genders(spark, folder):
    pick = lambda *words: F.get(F.array(*[F.lit(w) for w in words]), F.col("c_nationkey") % 5)
    df = load(spark, folder, "customer").select(
        "c_custkey", pick("Bombay", " new   delhi", "oslo", "none", "NYC").alias("city"), pick("apac", "EU", "Middle  East", "", "arctic zone").alias("region"),
        pick("M", "femalle", "trans", "nb", "robot").alias("gender"),
    )
    return categories.standardise(df, {"city": "city", "region": "region", "gender": "gender"}).drop("city", "region", "gender")


@query("""
SELECT 'c_mktsegment' AS "column", c_mktsegment AS source, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS target, count(*) AS n FROM customer GROUP BY ALL
""")
def category_title_case(spark, folder):
    return categories.value_mapping(load(spark, folder, "customer"), {"c_mktsegment": "text"})


@query("""
SELECT p_type, label, count(*) AS n FROM (SELECT p_type, CASE p_type WHEN 'PROMO' THEN 'sale' WHEN 'SMALL' THEN 'size' WHEN 'LARGE' THEN 'size' WHEN 'ECONOMY' THEN 'none' ELSE 'Other' END AS label
  FROM (SELECT p_type FROM part)) GROUP BY ALL
""")
def category_mapping_applied(spark, folder):
    parts = load(spark, folder, "part")
    mapping = parts.select(F.col("p_type").alias("source")).distinct().withColumn(
        "target", F.when(F.col("source") == "PROMO", "sale").when(F.col("source").isin("SMALL", "LARGE"), "size").when(F.col("source") == "ECONOMY", "none"))
    done = categories.apply_mapping(parts.select("p_type"), "p_type", mapping.filter("target is not null"), "label")
    return done.groupBy("p_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Yes' WHEN 'FURNITURE' THEN 'No' ELSE 'Unknown' END AS has_garden_standard, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c_mktsegment_standard FROM customer
""")
def category_gate(spark, folder):
    seg = F.col("c_mktsegment")
    word = F.when(seg == "BUILDING", "y").when(seg == "FURNITURE", "NO").otherwise("later")
    df = load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", word.alias("has_garden"))
    return categories.categorise(df, ["has_garden", "c_mktsegment", "c_name", "c_acctbal"])[0].drop("c_name", "c_acctbal", "c_mktsegment", "has_garden")


# ---- sentiment --------------------------------------------------------------

MOOD_POSITIVE, MOOD_NEGATIVE = ["the", "der", "les", "ing"], ["tion", "ung", "que", "los"]
LISTED = {w: f"contains(lower(text), '{w}')::INT" for w in MOOD_POSITIVE + MOOD_NEGATIVE}
MOOD = f"""
WITH t AS (SELECT *, {' + '.join(LISTED[w] for w in MOOD_POSITIVE)} AS p, {' + '.join(LISTED[w] for w in MOOD_NEGATIVE)} AS n FROM documents),
s AS (SELECT *, CASE WHEN n > p THEN 'Negative' WHEN p > n THEN 'Positive' ELSE 'Neutral' END AS label,
  CASE WHEN n > p THEN greatest(-1.0::DOUBLE, -0.35::DOUBLE - 0.1::DOUBLE * n) WHEN p > n THEN least(1.0::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * p) ELSE 0.0::DOUBLE END AS score FROM t)
"""


def mood(spark, folder):
    docs = load(spark, folder, "documents")
    return docs.withColumn("s", text.sentiment(F.col("text"), MOOD_POSITIVE, MOOD_NEGATIVE)).select("doc_id", "lang", "s.label", "s.score")


@query(MOOD + "SELECT doc_id, label, round(score, 6) AS score FROM s")
def sentiment_labels(spark, folder):
    return mood(spark, folder).select("doc_id", "label", r("score", 6))


ROLLUP = """count(*) AS reviews, count(*) FILTER (label = 'Positive') AS positive, count(*) FILTER (label = 'Neutral') AS neutral, count(*) FILTER (label = 'Negative') AS negative, 0 AS mixed,
  round(avg(score), 3) AS average_score, round(count(*) FILTER (label = 'Positive') / count(*)::DOUBLE * 100, 1) AS satisfaction"""


@query(MOOD + f"SELECT CASE lang WHEN 'en' THEN 'Unknown' ELSE lang END AS entity, {ROLLUP} FROM s GROUP BY 1")
def sentiment_by_entity(spark, folder):
    labelled = mood(spark, folder).withColumn("lang", F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")))
    return insights.sentiment_rollup(labelled, "lang")


@query(MOOD + f"SELECT {ROLLUP} FROM s")
def sentiment_overall(spark, folder):
    return insights.sentiment_rollup(mood(spark, folder))


# ---- personal data ----------------------------------------------------------


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)([\p{L}\p{N}_])([.%+-][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,})($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])([A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,})($|[^\p{L}\p{N}_])', '\1\4<EMAIL>\3\6', 'g'),
  '(?i)https?://\S+|www\.\S+', '<URL>', 'g'), '(^|[^\p{L}\p{N}_])(\+?\d[\d\s().-]{7,}\d)($|[^\p{L}\p{N}_])', '\1<PHONE>\3', 'g') AS text FROM documents
""")
def mask_personal_data(spark, folder):
    return load(spark, folder, "documents").select("doc_id", text.masked(F.col("text")).alias("text"))


@query(r"""
SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}($|[^\p{L}\p{N}_])')) AS emails,
  count(*) FILTER (regexp_matches(text, '(^|[^\p{L}\p{N}_])\d[\d\s().-]{7,}\d($|[^\p{L}\p{N}_])')) AS phones, count(*) FILTER (regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])https?://\S')) AS urls FROM documents GROUP BY 1
""")
def personal_data_by_source(spark, folder):
    flagged = load(spark, folder, "documents").withColumn("f", text.personal_data(F.col("text")))
    return flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("f.email").alias("emails"), F.count_if("f.phone").alias("phones"), F.count_if("f.url").alias("urls")
    )


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?i)(^|[^\p{L}\p{N}_])article($|[^\p{L}\p{N}_])', '\1C1\2', 'g'), '(?i)(^|[^\p{L}\p{N}_])nav($|[^\p{L}\p{N}_])', '\1C2\2', 'g') AS html FROM pages""")
def rename_known_names(spark, folder):
    return load(spark, folder, "pages").select("page_id", text.renamed(F.col("html"), {"nav": "C2", "article": "C1"}).alias("html"))


@query("""SELECT o_orderkey, 'Paid by C' || o_custkey || ', not "C' || (o_custkey + 1) || '"; x' || c_name AS note FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_custkey < (SELECT max(c_custkey) FROM customer)""")
def rename_all_customers(spark, folder):
    """As many names as there are customers."""
    customers = load(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"))
    names = customers.select("name", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("alias"))
    near = customers.select((F.col("c_custkey") - 1).alias("c_custkey"), F.upper("name").alias("next_name"))
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    notes = orders.join(customers, "c_custkey").join(near, "c_custkey").select(
        "o_orderkey", F.concat(F.lit("Paid by "), "name", F.lit(', not "'), "next_name", F.lit('"; x'), "name").alias("note"))
    return renaming.rename_names(notes, "note", names)


@query(r"""
SELECT count(*) FILTER (regexp_full_match(o_orderpriority, '[a-z0-9][a-z0-9_.:-]*')) AS safe_words,
  count(*) FILTER (regexp_full_match(lower(o_orderpriority), '[a-z0-9][a-z0-9_.:-]*')) AS safe_lower FROM orders
""")
def safe_tokens(spark, folder):
    word = F.col("o_orderpriority")
    return load(spark, folder, "orders").agg(
        F.count_if(text.safe_token(word)).alias("safe_words"), F.count_if(text.safe_tokens(F.array(F.lower(word)))).alias("safe_lower")
    )


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","missing":null,"size":' || p_size || '}') AS hash FROM part""")
def stable_record_hash(spark, folder):
    return load(spark, folder, "part").select("p_partkey", text.stable_hash(size=F.col("p_size"), brand=F.col("p_brand"), missing=F.lit(None).cast("string")).alias("hash"))


@query("""
WITH d AS (SELECT event_id, event_type, value, (props ->> '$.k') AS k, user_id % 3 AS m FROM events)
SELECT '{"a":"str","k":"int","l":["int",' || CASE m WHEN 0 THEN '"float"' WHEN 1 THEN '{"' || event_type || '":"bool"}' ELSE '' END || '],"x":' || CASE WHEN value > 20 THEN '"null"' ELSE '"str"' END || '}' AS shape, count(*) AS n
FROM d GROUP BY 1
""".replace("ELSE '' END || ']", "ELSE '[]' END || ']"))
def json_shapes(spark, folder):
    m = F.col("user_id") % 3
    last = F.when(m == 0, F.col("value").cast("decimal(20,3)").cast("string")).when(m == 1, F.concat(F.lit('{"'), "event_type", F.lit('" : true}'))).otherwise("[ ]")
    doc = F.concat(F.lit('{"a":"\\\\\\": {'), F.col("event_type"), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit(',"l":[1, '), last, F.lit('],"x":'), F.when(F.col("value") > 20, "null").otherwise('"}"'), F.lit("}"))
    return load(spark, folder, "events").groupBy(text.json_shape(doc).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, (props ->> '$.k')::BIGINT AS k, NULL::VARCHAR AS note FROM events""")
def json_to_columns(spark, folder):
    return explode_records(load(spark, folder, "events"), "props", "k long, note string", ("event_id",))


# ---- question tagging -------------------------------------------------------

QUESTIONS = """SELECT conv_id, turn, ['Show rows with price above 30 and stock below 5', 'What is the average total by "Region"?', 'Clean null values then list them',
 'Add column margin', 'customer satisfaction of restaurants in Delhi', 'is rating at least 4.5 or not'][((conv_id + turn) % 6)::INT + 1] || ' ' || text AS q FROM conversations"""
LEADS = ["Show rows with price above 30 and stock below 5", 'What is the average total by "Region"?', "Clean null values then list them",
         "Add column margin", "customer satisfaction of restaurants in Delhi", "is rating at least 4.5 or not"]


def questions(spark, folder):
    lead = F.get(F.array(*[F.lit(q) for q in LEADS]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    return load(spark, folder, "conversations").select("conv_id", "turn", F.concat(lead, F.lit(" "), F.col("text")).alias("q"))


def _like(pattern):
    return "regexp_matches(p, '" + pattern.replace("'", "''") + "')"


@query(f"""
WITH t AS (SELECT conv_id, turn, {plain('q')} AS p FROM ({QUESTIONS}))
SELECT conv_id, turn, CASE WHEN {_like(text.INTENT_HINTS['operation'])} THEN 'operation' WHEN {_like(text.INTENT_HINTS['sentiment'])} THEN 'sentiment'
  WHEN {_like(text.INTENT_HINTS['cleaning'])} THEN 'cleaning' WHEN {_like(text.INTENT_HINTS['analytics'])} AND NOT {_like(text.INTENT_HINTS['filter'])} THEN 'analytics'
  WHEN {_like(text.INTENT_HINTS['filter'])} THEN 'filter' ELSE 'unknown' END AS intent,
  CASE WHEN contains(p, ' then ') THEN 'SEQUENTIAL' WHEN contains(p, ' and ') AND contains(p, ' or ') THEN 'MIXED' WHEN contains(p, ' and ') THEN 'AND'
       WHEN contains(p, ' or ') THEN 'OR' ELSE 'SINGLE' END AS logical_structure FROM t
""")
def question_intents(spark, folder):
    return questions(spark, folder).select("conv_id", "turn", text.intent(F.col("q")).alias("intent"), text.logical_structure(F.col("q")).alias("logical_structure"))


# DuckDB knows ASCII word borders only; other letters are made one.
ASCII_Q = r"regexp_replace(q, '[^\x00-\x7F]', 'x', 'g')"
OPERATOR_LIST = ", ".join(f"CASE WHEN regexp_matches({ASCII_Q}, '{p.replace('(?iU)', '(?i)')}') THEN '{n}' END" for n, p in text.OPERATOR_HINTS.items())
COUNTED = " + ".join(f"len(regexp_extract_all(p, '{p}'))" for p in text.COMPARISON_PATTERNS)
HINTED = " + ".join(f"contains(p, '{h}')::INT" for h in text.BOOLEAN_HINTS)


@query(f"""
WITH t AS (SELECT conv_id, turn, q, {plain('q')} AS p FROM ({QUESTIONS}))
SELECT conv_id, turn, array_to_string(list_filter([{OPERATOR_LIST}], lambda x: x IS NOT NULL), ',') AS operators, {COUNTED} AS comparisons, {HINTED} AS booleans FROM t
""")
def question_operators(spark, folder):
    q = F.col("q")
    return questions(spark, folder).select(
        "conv_id", "turn", F.array_join(text.operators(q), ",").alias("operators"), text.comparison_count(q).cast("long").alias("comparisons"),
        text.boolean_hints(q).cast("long").alias("booleans"),
    )


@query()
def question_features(spark, folder):
    return questions(spark, folder).select("conv_id", "turn", text.question_features(F.col("q")).alias("f")).select("conv_id", "turn", "f.*")


WORDS = {d: " + ".join(f"contains(c, '{w}')::INT" for w in ws) for d, ws in text.DOMAIN_WORDS.items()}


@query(f"""
WITH t AS (SELECT conv_id, turn, lower(q) AS c FROM ({QUESTIONS})), s AS (SELECT *, {WORDS['myntra']} AS m, {WORDS['finance']} AS f, {WORDS['restaurant']} AS r FROM t),
w AS (SELECT *, CASE WHEN m + f + r > 0 THEN least(0.99, greatest(m, f, r) / greatest(2, m + f + r)::DOUBLE) ELSE 0 END AS share,
  CASE WHEN contains(c, 'myntra') THEN 'myntra' WHEN contains(c, 'finance') THEN 'finance' WHEN contains(c, 'restaurant') THEN 'restaurant' END AS named FROM s)
SELECT conv_id, turn, coalesce(named, CASE WHEN m >= f AND m >= r THEN 'myntra' WHEN f >= r THEN 'finance' ELSE 'restaurant' END) AS domain,
  round(CASE WHEN named IS NOT NULL THEN greatest(share, 0.96) ELSE share END, 4)::DOUBLE AS confidence, CASE WHEN named IS NOT NULL THEN greatest(share, 0.96) ELSE share END < 0.72 AS fallback FROM w
""")
def question_domains(spark, folder):
    return questions(spark, folder).select("conv_id", "turn", text.domain(F.col("q")).alias("d")).select("conv_id", "turn", "d.*")


# ---- similarity -------------------------------------------------------------


def bag(c):
    return f"list_distinct(list_filter(string_split({norm(c)}, ' '), lambda x: x <> ''))"


PROBES = """SELECT id AS probe_id, CASE WHEN id % 3 = 0 THEN user_query || '!' WHEN id % 3 = 1 THEN user_query || ' please' ELSE substr(user_query, 11) END AS user_query, organization_id FROM log"""


def probes(spark, folder, log=None):
    q, i = F.col("user_query"), F.col("id")
    return (log or query_log(spark, folder)).select(
        i.alias("probe_id"), F.when(i % 3 == 0, F.concat(q, F.lit("!"))).when(i % 3 == 1, F.concat(q, F.lit(" please"))).otherwise(F.substring(q, 11, 1 << 20)).alias("user_query"), "organization_id",
    )


@query(f"""
WITH log AS ({QUERY_LOG}), probes AS ({PROBES}), a AS (SELECT DISTINCT {norm('user_query')} AS n, {bag('user_query')} AS w FROM probes), b AS (SELECT DISTINCT {norm('user_query')} AS n, {bag('user_query')} AS w FROM log),
j AS (SELECT a.n AS left_text, b.n AS right_text, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM a, b)
SELECT left_text, right_text, round(i / (x + y - i)::DOUBLE, 6) AS jaccard FROM j WHERE i / (x + y - i)::DOUBLE >= 0.8
""")
def word_overlap_pairs(spark, folder):
    found = matching.word_overlap(probes(spark, folder), query_log(spark, folder), "user_query", "user_query", 0.8)
    return found.select("left_text", "right_text", r("jaccard", 6))


@query()
def similar_questions(spark, folder):
    return matching.similar_questions(probes(spark, folder), query_log(spark, folder).filter("success"), "probe_id", 0.9)
