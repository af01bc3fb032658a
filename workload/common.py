"""Input tables of the queries, and logs derived from them.

Each derived table exists twice: as a Spark function and as a SQL text with
the same rows, for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(column: str | Column, digits: int, name: str | None = None) -> Column:
    """Rounded double, so that the order of a sum does not show."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits).alias(name or (column if isinstance(column, str) else "value"))


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[r(c, digits[c]) if c in digits else F.col(f"`{c}`") for c in df.columns])


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# ---- query log from the user turns of conversations --------------------------

INTENTS = ["filter", "analytics", "cleaning", "operation", "sentiment"]


def query_log(spark, folder) -> DataFrame:
    turns = load(spark, folder, "conversations").filter("role = 'user'")
    conv, turn = F.col("conv_id"), F.col("turn")
    names = F.array(*[F.lit(i) for i in INTENTS])
    at = F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 60)
    return turns.select(
        (conv * 100 + turn).alias("id"), F.concat(F.lit("d"), (conv % 7).cast("string")).alias("dataset_id"),
        F.when(conv % 5 != 0, F.concat(F.lit("o"), (conv % 3).cast("string"))).alias("organization_id"),
        F.concat(F.lit("s"), (conv % 7 % 4).cast("string")).alias("schema_hash"), F.col("text").alias("user_query"),
        F.get(names, ((conv + turn) % 5).cast("int")).alias("intent"),
        F.when((conv + turn) % 6 != 0, F.concat(F.lit("SELECT "), conv.cast("string"))).alias("generated_sql"),
        F.concat(F.lit('{"steps":'), turn.cast("string"), F.lit("}")).alias("python_pipeline"),
        (F.length("text") * 1.5 + (conv * 100 + turn) % 13).cast("double").alias("execution_time_ms"), ((conv + turn) % 9 != 0).alias("success"),
        F.when(conv % 4 != 0, (turn + conv) % 4 - 2).cast("long").alias("feedback_score"),
        F.concat(F.lit("v"), (turn % 2).cast("string")).alias("planner_version"), at.alias("created_at"),
    )


QUERY_LOG = """
  SELECT conv_id * 100 + turn AS id, 'd' || (conv_id % 7) AS dataset_id,
         CASE WHEN conv_id % 5 <> 0 THEN 'o' || (conv_id % 3) END AS organization_id, 's' || (conv_id % 7 % 4) AS schema_hash,
         text AS user_query,
         ['filter', 'analytics', 'cleaning', 'operation', 'sentiment'][((conv_id + turn) % 5)::INT + 1] AS intent,
         CASE WHEN (conv_id + turn) % 6 <> 0 THEN 'SELECT ' || conv_id END AS generated_sql,
         '{"steps":' || turn || '}' AS python_pipeline,
         (length(text) * 1.5 + (conv_id * 100 + turn) % 13)::DOUBLE AS execution_time_ms, (conv_id + turn) % 9 <> 0 AS success,
         CASE WHEN conv_id % 4 <> 0 THEN (turn + conv_id) % 4 - 2 END AS feedback_score, 'v' || (turn % 2) AS planner_version,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created_at
  FROM conversations WHERE role = 'user'
"""


def datasets(spark, folder) -> DataFrame:
    k = load(spark, folder, "conversations").select((F.col("conv_id") % 7).alias("k")).distinct()
    kinds = F.array(F.lit("csv"), F.lit("json"), F.lit("xlsx"))
    return k.select(
        F.concat(F.lit("d"), F.col("k").cast("string")).alias("dataset_id"), F.concat(F.lit("o"), (F.col("k") % 3).cast("string")).alias("organization_id"),
        F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("schema_hash"), F.get(kinds, (F.col("k") % 3).cast("int")).alias("source_type"),
    )


DATASETS = """
  SELECT 'd' || k AS dataset_id, 'o' || (k % 3) AS organization_id, 's' || (k % 4) AS schema_hash,
         ['csv', 'json', 'xlsx'][(k % 3)::INT + 1] AS source_type
  FROM (SELECT DISTINCT conv_id % 7 AS k FROM conversations)
"""


def invalidations(spark, folder) -> DataFrame:
    """Rules of several scopes from the system turns."""
    turns = load(spark, folder, "conversations").filter("role = 'system'")
    conv = F.col("conv_id")
    names = F.array(*[F.lit(i) for i in INTENTS])
    return turns.select(
        F.when(conv % 3 == 0, conv * 100 + 1).alias("query_history_id"),
        F.when(conv % 2 == 0, F.concat(F.lit("s"), (conv % 4).cast("string"))).otherwise(F.lit("s3")).alias("schema_hash"),
        F.when(conv % 5 < 2, F.get(names, (conv % 5).cast("int"))).alias("intent"),
        F.when(conv % 4 == 1, F.concat(F.lit("v"), (conv % 2).cast("string"))).alias("planner_version"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 1800).alias("invalidated_at"),
    )


INVALIDATIONS = """
  SELECT CASE WHEN conv_id % 3 = 0 THEN conv_id * 100 + 1 END AS query_history_id,
         CASE WHEN conv_id % 2 = 0 THEN 's' || (conv_id % 4) ELSE 's3' END AS schema_hash,
         CASE WHEN conv_id % 5 < 2 THEN ['filter', 'analytics', 'cleaning', 'operation', 'sentiment'][(conv_id % 5)::INT + 1] END AS intent,
         CASE WHEN conv_id % 4 = 1 THEN 'v' || (conv_id % 2) END AS planner_version,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 1800) AS invalidated_at
  FROM conversations WHERE role = 'system'
"""

# ---- learning events from documents and labels -------------------------------


def learning_events(spark, folder) -> DataFrame:
    docs = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    n, i = F.col("n_chars"), F.col("doc_id")
    names = F.array(*[F.lit(x) for x in INTENTS])
    intent = F.when(n % 97 == 0, "Bad Intent").otherwise(F.get(names, (n % 5).cast("int")))
    good = F.coalesce(F.col("quality") == 1, F.lit(True))
    tools = F.when(n % 3 == 0, F.array(F.lit("sql.filter"), F.lit("sql.validate"))).when(n % 3 == 1, F.array(F.lit("sql.group_by"))).otherwise(
        F.array(F.lit("clean.fill"), F.lit("clean.dedupe"), F.lit("sql.validate")))
    filters = F.when(n % 2 == 0, F.lit('[{"column":"a","operator":"equals","value":"1"}]')).otherwise(F.lit("[]"))
    return docs.select(
        F.concat(F.lit("e"), i.cast("string")).alias("event_id"), intent.alias("intent"),
        F.array(F.concat(F.lit("role_"), F.col("source")), F.concat(F.lit("lang_"), F.col("lang"))).alias("semantic_roles"),
        F.when(n % 2 == 0, F.array(F.lit("equals"))).otherwise(F.array().cast("array<string>")).alias("operators"),
        F.when(n % 89 == 0, "XOR").when(n % 4 == 0, "AND").otherwise("SINGLE").alias("logical_structure"), tools.alias("tool_sequence"),
        (0.94 + (n % 7) / 100.0).alias("score"), good.alias("success"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("critic_passed"),
        F.lit(True).alias("result_validation_passed"), F.when(i % 31 != 0, F.lit(True)).alias("plan_completeness_passed"),
        F.lit(True).alias("privacy_validation_passed"), F.lit(True).alias("no_unresolved_ambiguity"), F.lit(True).alias("no_critical_repair"),
        F.when(i % 17 == 0, 1).otherwise(0).alias("repair_count"), F.lit("teacher_execution").alias("plan_source"),
        F.lit(None).cast("string").alias("plan_template_id"), F.substring(F.sha2(F.col("source"), 256), 1, 16).alias("dataset_semantic_signature"),
        F.concat(F.lit('{"filters":'), filters, F.lit(',"group_by":["b"]}')).alias("plan_summary"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + i), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"),
    )


LEARNING_EVENTS = """
  SELECT 'e' || d.doc_id AS event_id,
         CASE WHEN n_chars % 97 = 0 THEN 'Bad Intent'
              ELSE ['filter', 'analytics', 'cleaning', 'operation', 'sentiment'][(n_chars % 5)::INT + 1] END AS intent,
         ['role_' || source, 'lang_' || lang] AS semantic_roles,
         CASE WHEN n_chars % 89 = 0 THEN 'XOR' WHEN n_chars % 4 = 0 THEN 'AND' ELSE 'SINGLE' END AS logical_structure,
         CASE WHEN n_chars % 3 = 0 THEN ['sql.filter', 'sql.validate'] WHEN n_chars % 3 = 1 THEN ['sql.group_by']
              ELSE ['clean.fill', 'clean.dedupe', 'sql.validate'] END AS tool_sequence,
         CASE WHEN n_chars % 2 = 0 THEN ['equals'] ELSE [] END AS operators,
         0.94 + (n_chars % 7)::DOUBLE / 100.0 AS score, coalesce(quality = 1, true) AS success, coalesce(toxic = 0, true) AS critic_passed,
         CASE WHEN d.doc_id % 31 <> 0 THEN true END AS plan_completeness_passed, CASE WHEN d.doc_id % 17 = 0 THEN 1 ELSE 0 END AS repair_count,
         '{"filters":' || CASE WHEN n_chars % 2 = 0 THEN '[{"column":"a","operator":"equals","value":"1"}]' ELSE '[]' END
           || ',"group_by":["b"]}' AS plan_summary,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
