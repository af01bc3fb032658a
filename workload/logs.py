"""Queries for the query log, plan reuse, learning events and corpora."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators import corpus, matching, querylog

from .common import (
    DATASETS, INTENTS, INVALIDATIONS, LEARNING_EVENTS, QUERY_LOG, datasets, invalidations, learning_events, load, query_log, r, rounded,
)
from .texts import PROBES, bag, norm, probes

QUERIES, ORACLES = {}, {}
WITH = f"WITH log AS ({QUERY_LOG}), sets AS ({DATASETS}), rules AS ({INVALIDATIONS})"
NOW = dt.datetime(2024, 2, 15)
NOW_SQL = "TIMESTAMP '2024-02-15 00:00:00'"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


# ---- scopes and exports -----------------------------------------------------


@query(WITH + """
SELECT log.id, log.dataset_id, log.intent FROM log LEFT JOIN sets ON log.dataset_id = sets.dataset_id
WHERE (log.organization_id = 'o1' OR sets.organization_id = 'o1') AND success ORDER BY created_at DESC, id DESC LIMIT 40
""")
def log_scope(spark, folder):
    return querylog.scoped_log(query_log(spark, folder), datasets(spark, folder), "o1", success=True, limit=40).select("id", "dataset_id", "intent")


@query(WITH + """
SELECT intent, user_query AS question, generated_sql AS "sql", python_pipeline AS pipeline, execution_time_ms, feedback_score AS feedback, source_type AS dataset_type
FROM log LEFT JOIN sets USING (dataset_id)
""")
def log_training_table(spark, folder):
    return querylog.training_table(query_log(spark, folder), datasets(spark, folder))


@query(WITH + """
SELECT a.id AS probe_id, arg_max(b.id, (b.created_at, b.id)) AS matched_id, arg_max(b.generated_sql, (b.created_at, b.id)) AS generated_sql
FROM log a JOIN log b ON a.user_query = b.user_query AND a.dataset_id = b.dataset_id AND b.success GROUP BY a.id HAVING arg_max(b.id, (b.created_at, b.id)) IS NOT NULL
""".replace("arg_max(b.generated_sql, (b.created_at, b.id))", "any_value(b.generated_sql)"))
def log_exact_reuse(spark, folder):
    log = query_log(spark, folder)
    asked = log.select(F.col("id").alias("probe_id"), "user_query", "dataset_id")
    return querylog.exact_reuse(asked, log, "probe_id")


FLAGGED = """SELECT log.*, id IN (SELECT query_history_id FROM rules WHERE query_history_id IS NOT NULL) OR EXISTS (SELECT 1 FROM rules r WHERE r.query_history_id IS NULL
  AND (r.schema_hash IS NULL OR r.schema_hash = log.schema_hash) AND (r.intent IS NULL OR r.intent = log.intent) AND (r.planner_version IS NULL OR r.planner_version = log.planner_version)
  AND log.created_at <= r.invalidated_at) AS invalidated FROM log"""


@query(WITH + f"SELECT id, invalidated FROM ({FLAGGED})")
def log_invalidated(spark, folder):
    return querylog.invalidated(query_log(spark, folder), invalidations(spark, folder)).select("id", "invalidated")


REUSE = WITH + f"""
, own AS (SELECT log.* EXCLUDE (schema_hash), sets.schema_hash FROM log JOIN sets USING (dataset_id) WHERE success),
flagged AS ({FLAGGED.replace('log.*', 'own.*').replace('= log.', '= own.').replace('AND log.', 'AND own.').replace('FROM log', 'FROM own')}),
asked AS (SELECT p.*, sets.schema_hash FROM (SELECT id AS probe_id, dataset_id, CASE WHEN id % 3 = 0 THEN user_query ELSE user_query || '?' END AS user_query,
  CASE WHEN id % 5 <> 1 THEN intent END AS intent, CASE WHEN id % 2 = 0 THEN planner_version END AS planner_version FROM log) p LEFT JOIN sets USING (dataset_id)),
c AS (
  SELECT probe_id, a.dataset_id AS asked_for, 1 AS tier, f.* FROM asked a JOIN flagged f ON a.schema_hash = f.schema_hash AND a.user_query = f.user_query
  UNION ALL SELECT probe_id, a.dataset_id, 2, f.* FROM asked a JOIN flagged f ON a.schema_hash = f.schema_hash AND a.intent = f.intent AND (a.planner_version IS NULL OR a.planner_version = f.planner_version)),
n AS (SELECT *, row_number() OVER (PARTITION BY probe_id, tier ORDER BY created_at DESC, id DESC) AS place FROM c),
k AS (SELECT *, NOT invalidated AND created_at >= {NOW_SQL} - INTERVAL 30 DAY AS fresh FROM n),
t AS (SELECT probe_id, tier, bool_and(invalidated) AS all_invalid, min(place) FILTER (fresh) AS p FROM k GROUP BY 1, 2),
s AS (SELECT t.*, CASE WHEN p IS NOT NULL THEN 'ok' WHEN all_invalid THEN 'invalidated' ELSE 'expired' END AS status, k.id, k.dataset_id, k.asked_for, k.generated_sql,
  round(greatest(0, least(1, ((CASE t.tier WHEN 1 THEN 0.9 ELSE 0.6 END) + (CASE WHEN feedback_score > 0 THEN 0.1 WHEN feedback_score < 0 THEN -0.45 ELSE 0 END))::DOUBLE
    * (1 - 0.15 * least(greatest(epoch({NOW_SQL} - created_at) / 86400.0, 0) / 30, 1))::DOUBLE)), 4) AS confidence FROM t LEFT JOIN k ON t.probe_id = k.probe_id AND t.tier = k.tier AND t.p = k.place),
b AS (SELECT probe_id, bool_or(status = 'invalidated') AS inv, bool_or(status = 'expired') AS exp, min(tier) FILTER (status = 'ok' AND confidence >= 0.5) AS tier FROM s GROUP BY 1)
SELECT a.probe_id, CASE WHEN b.tier IS NOT NULL THEN 'hit' WHEN inv THEN 'invalidated' WHEN exp THEN 'expired' ELSE 'miss' END AS outcome,
  CASE b.tier WHEN 1 THEN CASE WHEN s.dataset_id = a.dataset_id THEN 'same_dataset' ELSE 'same_schema_shape' END WHEN 2 THEN 'same_intent' END AS matched_on,
  s.confidence, s.id AS matched_id, s.dataset_id AS source_dataset_id, s.generated_sql
FROM asked a LEFT JOIN b USING (probe_id) LEFT JOIN s ON s.probe_id = a.probe_id AND s.tier = b.tier
"""


@query(REUSE)
def plan_reuse(spark, folder):
    log, i = query_log(spark, folder), F.col("id")
    asked = log.select(
        i.alias("probe_id"), "dataset_id", F.when(i % 3 == 0, F.col("user_query")).otherwise(F.concat("user_query", F.lit("?"))).alias("user_query"),
        F.when(i % 5 != 1, F.col("intent")).alias("intent"), F.when(i % 2 == 0, F.col("planner_version")).alias("planner_version"),
    )
    return querylog.plan_reuse(asked, log, datasets(spark, folder), invalidations(spark, folder), NOW)


ASCII_LOG = WITH + """, plain AS (SELECT * REPLACE (regexp_replace(user_query, '[^ -~]', '', 'g') AS user_query) FROM log)"""


@query(ASCII_LOG + f"""
, probes AS ({PROBES.replace('FROM log', 'FROM plain')}), p AS (SELECT probe_id, {norm('user_query')} AS n, {bag('user_query')} AS w FROM probes),
l AS (SELECT *, {norm('user_query')} AS n, {bag('user_query')} AS w FROM plain WHERE success),
j AS (SELECT p.probe_id, p.n, l.id, l.user_query, coalesce(l.feedback_score, 0) AS feedback, l.created_at, l.n AS m,
  len(list_intersect(p.w, l.w)) / len(list_distinct(list_concat(p.w, l.w)))::DOUBLE AS j FROM p, l WHERE len(list_intersect(p.w, l.w)) / len(list_distinct(list_concat(p.w, l.w)))::DOUBLE >= 0.7),
s AS (SELECT *, CASE WHEN n = m THEN 1.0 ELSE round(0.5 * (1.0::DOUBLE - levenshtein(n, m) / greatest(length(n), length(m))::DOUBLE) + 0.5 * j, 4) END::DOUBLE AS score FROM j)
SELECT probe_id, n AS norm, score, id AS matched_id, user_query AS matched_query, feedback AS feedback_score FROM s WHERE score >= 0.9
QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, feedback DESC, created_at DESC, id) = 1
""")
def similar_questions_by_edits(spark, folder):
    # DuckDB counts bytes in an edit distance, so the texts are cut to ASCII.
    plain = query_log(spark, folder).withColumn("user_query", F.regexp_replace("user_query", "[^ -~]", ""))
    return matching.similar_questions(probes(spark, folder, plain), plain.filter("success"), "probe_id", 0.9, native=True)


@query(ASCII_LOG + f"""
, probes AS ({PROBES.replace('FROM log', 'FROM plain')}), p AS (SELECT probe_id, organization_id, {norm('user_query')} AS n, {bag('user_query')} AS w FROM probes),
l AS (SELECT *, {norm('user_query')} AS n, {bag('user_query')} AS w FROM plain WHERE success),
j AS (SELECT p.probe_id, p.n, l.id, l.user_query, coalesce(l.feedback_score, 0) AS feedback, l.created_at, l.n AS m,
  len(list_intersect(p.w, l.w)) / len(list_distinct(list_concat(p.w, l.w)))::DOUBLE AS j FROM p, l WHERE p.organization_id IS NOT DISTINCT FROM l.organization_id AND len(list_intersect(p.w, l.w)) / len(list_distinct(list_concat(p.w, l.w)))::DOUBLE >= 0.7),
s AS (SELECT *, CASE WHEN n = m THEN 1.0 ELSE round(0.5 * (1.0::DOUBLE - levenshtein(n, m) / greatest(length(n), length(m))::DOUBLE) + 0.5 * j, 4) END::DOUBLE AS score FROM j)
SELECT probe_id, n AS norm, score, id AS matched_id, user_query AS matched_query, feedback AS feedback_score FROM s WHERE score >= 0.9
QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, feedback DESC, created_at DESC, id) = 1
""")
def similar_questions_in_scope(spark, folder):
    # DuckDB counts bytes in an edit distance, so the texts are cut to ASCII.
    plain = query_log(spark, folder).withColumn("user_query", F.regexp_replace("user_query", "[^ -~]", ""))
    return matching.similar_questions(probes(spark, folder, plain), plain.filter("success"), "probe_id", 0.9, native=True, scope=["organization_id"])


@query()
def best_reusable_sql(spark, folder):
    return querylog.best_with(probes(spark, folder), query_log(spark, folder), "probe_id", "generated_sql", 0.9)


@query(ASCII_LOG + f"""
, probes AS ({PROBES.replace('FROM log', 'FROM plain')}), p AS (SELECT probe_id, {norm('user_query')} AS n, {bag('user_query')} AS w FROM probes),
l AS (SELECT *, {norm('user_query')} AS n, {bag('user_query')} AS w FROM plain WHERE success AND python_pipeline LIKE '%1%'),
j AS (SELECT p.probe_id, p.n, l.id, l.python_pipeline, coalesce(l.feedback_score, 0) AS feedback, l.created_at, l.n AS m,
  len(list_intersect(p.w, l.w)) / len(list_distinct(list_concat(p.w, l.w)))::DOUBLE AS j FROM p, l WHERE len(list_intersect(p.w, l.w)) / len(list_distinct(list_concat(p.w, l.w)))::DOUBLE >= 0.7),
s AS (SELECT *, CASE WHEN n = m THEN 1.0 ELSE round(0.5 * (1.0::DOUBLE - levenshtein(n, m) / greatest(length(n), length(m))::DOUBLE) + 0.5 * j, 4) END::DOUBLE AS score FROM j)
SELECT probe_id, id AS matched_id, score, python_pipeline FROM s WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, feedback DESC, created_at DESC, id) = 1
""")
def best_reusable_pipeline(spark, folder):
    # DuckDB counts bytes in an edit distance, so the texts are cut to ASCII.
    plain = query_log(spark, folder).withColumn("user_query", F.regexp_replace("user_query", "[^ -~]", ""))
    own = plain.withColumn("python_pipeline", F.when(F.contains("python_pipeline", F.lit("1")), F.col("python_pipeline")))
    return querylog.best_with(probes(spark, folder, plain), own, "probe_id", "python_pipeline", 0.9, native=True)


@query(WITH + """
, per AS (SELECT intent, count(*) AS n, count(*) FILTER (success) AS successful FROM log GROUP BY 1)
SELECT intent, n, successful, round(successful * 100.0::DOUBLE / n, 1) AS success_rate FROM (SELECT * FROM per UNION ALL SELECT '(all)', sum(n)::BIGINT, sum(successful)::BIGINT FROM per)
""")
def log_command_stats(spark, folder):
    return querylog.command_stats(query_log(spark, folder))


@query(WITH + """
SELECT intent, count(*) AS n, quantile_cont(execution_time_ms, 0.5) AS median,
  list_sort(list(execution_time_ms))[greatest(1, ceil(count(*) * 0.95)::INT)] AS p95 FROM log GROUP BY 1
""")
def log_latency(spark, folder):
    return querylog.latency_summary(query_log(spark, folder), by=["intent"])


@query("SELECT count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS median, list_sort(list(l_extendedprice))[ceil(count(*) * 0.95)::INT] AS p95 FROM lineitem")
def log_latency_overall(spark, folder):
    return querylog.latency_summary(load(spark, folder, "lineitem"), "l_extendedprice")


@query(WITH + """SELECT 'queries' AS log_table, count(*) AS n FROM log UNION ALL SELECT 'datasets', count(*) FROM sets UNION ALL SELECT 'invalidations', count(*) FROM rules""")
def log_status(spark, folder):
    return querylog.log_status({"queries": query_log(spark, folder), "datasets": datasets(spark, folder), "invalidations": invalidations(spark, folder)})


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def log_compaction(spark, folder):
    return querylog.latest_per_key(load(spark, folder, "events"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type")


RUNS = """SELECT *, CASE WHEN value > 20 THEN value::INT END AS row_count, CASE WHEN value > 10 THEN 3 END AS column_count, event_type <> 'error' AS success,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 END AS feedback_score, CASE WHEN value > 50 THEN 0.9::DOUBLE END AS plan_completeness, CASE WHEN value < 5 THEN 0.1::DOUBLE END AS repair_penalty FROM events"""


@query(f"""
SELECT event_id, CASE WHEN NOT success THEN 0.0::DOUBLE ELSE round(greatest(0, least(1,
  coalesce(plan_completeness, CASE WHEN row_count IS NOT NULL OR column_count IS NOT NULL THEN 1.0 ELSE 0.5 END)::DOUBLE * 0.25::DOUBLE
  + CASE WHEN row_count IS NOT NULL OR column_count IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE * 0.25::DOUBLE + 0.8::DOUBLE * 0.15::DOUBLE + 0.9::DOUBLE * 0.15::DOUBLE + 0.1::DOUBLE + 0.8::DOUBLE * 0.05::DOUBLE
  + CASE WHEN feedback_score > 0 THEN 0.8 WHEN feedback_score < 0 THEN 0.2 ELSE 0.5 END::DOUBLE * 0.05::DOUBLE
  + CASE WHEN row_count > 0 THEN 0.03 WHEN row_count = 0 THEN -0.05 ELSE 0 END::DOUBLE + CASE WHEN column_count > 0 THEN 0.02 ELSE 0 END::DOUBLE - coalesce(repair_penalty, 0))), 4) END AS quality FROM ({RUNS})
""")
def run_quality(spark, folder):
    v, kind, none = F.col("value"), F.col("event_type"), F.lit(None).cast("double")
    df = load(spark, folder, "events").withColumns({
        "row_count": F.when(v > 20, F.rint(v).cast("int")), "column_count": F.when(v > 10, 3), "success": kind != "error",
        "feedback_score": F.when(kind == "click", 1).when(kind == "view", -1), "plan_completeness": F.when(v > 50, 0.9), "repair_penalty": F.when(v < 5, 0.1),
        **{c: none for c in ("result_validation", "semantic_binding", "critic_score", "execution_score", "output_contract", "fallback_penalty", "ambiguity_penalty")},
    })
    return df.select("event_id", querylog.run_quality().alias("quality"))


# ---- learning events --------------------------------------------------------

EV = f"WITH ev AS ({LEARNING_EVENTS})"
REASON = """CASE WHEN logical_structure NOT IN ('SINGLE', 'AND', 'OR', 'MIXED') THEN 'invalid_logical_structure' WHEN NOT regexp_full_match(intent, '[a-z0-9][a-z0-9_.:-]*') THEN 'unsafe_intent'
  WHEN NOT success THEN 'execution_failed' WHEN NOT critic_passed THEN 'critic_failed' WHEN plan_completeness_passed IS NOT TRUE THEN 'plan_completeness_failed'
  WHEN repair_count > 0 THEN 'repaired_example_rejected' WHEN score < 0.95 THEN 'quality_below_threshold' END"""


@query(EV + f"SELECT {REASON} AS reason, count(*) AS n FROM ev GROUP BY 1")
def corpus_gate_reasons(spark, folder):
    return learning_events(spark, folder).groupBy(corpus.event_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


FAMILY = """sha256(to_json({'intent': intent, 'logical_structure': logical_structure, 'operators': operators,
  'plan_shape': {'action': 'null', 'filters': len(operators), 'keys': 2, 'tools': 0},
  'semantic_roles': semantic_roles, 'source_kind': 'experience', 'tool_graph': tool_sequence})::VARCHAR)"""
SPLIT = "CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END"
HASHED = "(('0x' || substr(sha256(f), 1, 12))::BIGINT)::DOUBLE / 281474976710655::DOUBLE AS h"
GATED = EV + f""", g AS (SELECT *, {FAMILY} AS f FROM ev WHERE ({REASON}) IS NULL)"""


@query(GATED + f"""
, b AS (SELECT *, count(*) OVER (PARTITION BY f) AS family_size, row_number() OVER (PARTITION BY f ORDER BY score DESC, created_at DESC, event_id DESC) AS place, {HASHED} FROM g)
SELECT f AS family_fingerprint, event_id AS source_id, round(score, 6) AS quality_score, family_size, {SPLIT} AS split FROM b WHERE place = 1
""")
def corpus_best_of_family(spark, folder):
    records = corpus.event_records(learning_events(spark, folder)).filter("rejected is null")
    best = corpus.best_of_family(records).withColumn("split", corpus.stable_split(F.col("family_fingerprint")))
    return best.select("family_fingerprint", "source_id", r("quality_score", 6), "family_size", "split")


@query(f"SELECT doc_id, {SPLIT} AS split FROM (SELECT doc_id, {HASHED} FROM (SELECT doc_id, sha256(text) AS f FROM documents))")
def corpus_stable_split(spark, folder):
    return load(spark, folder, "documents").select("doc_id", corpus.stable_split(F.sha2("text", 256)).alias("split"))


SMALL_CAPS = corpus.CorpusPolicy(per_intent=40, per_tools=60)


# Records are taken one by one in quality order, as the caps say.
CAPPED = GATED.replace("WITH ev", "WITH RECURSIVE ev", 1) + f"""
, b AS (SELECT *, count(*) OVER (PARTITION BY f) AS family_size, row_number() OVER (PARTITION BY f ORDER BY score DESC, created_at DESC, event_id DESC) AS place, {HASHED} FROM g),
o AS (SELECT *, {SPLIT} AS split, array_to_string(tool_sequence, '|') AS tools, row_number() OVER (ORDER BY score DESC, created_at DESC, event_id DESC) AS k FROM b WHERE place = 1),
w AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS ti, []::VARCHAR[] AS tt, '' AS reason
  UNION ALL SELECT k, CASE WHEN reason = '' THEN list_append(ti, intent) ELSE ti END, CASE WHEN reason = '' THEN list_append(tt, tools) ELSE tt END, reason
  FROM (SELECT o.k, ti, tt, intent, tools, CASE WHEN len(list_filter(ti, lambda x: x = intent)) >= 40 THEN 'intent_cap' WHEN len(list_filter(tt, lambda x: x = tools)) >= 60 THEN 'tool_graph_cap' ELSE '' END AS reason
        FROM w JOIN o ON o.k = w.k + 1)),
c AS (SELECT o.*, w.reason FROM o JOIN w USING (k))
"""
BUILT = "event_id AS source_id, intent, split, round(score, 6) AS quality_score, family_size"


def small_corpus(spark, folder):
    return corpus.build_corpus(corpus.event_records(learning_events(spark, folder), SMALL_CAPS), policy=SMALL_CAPS)


@query(CAPPED + f"SELECT {BUILT} FROM c WHERE reason = ''")
def corpus_build(spark, folder):
    return small_corpus(spark, folder)[0].select("source_id", "intent", "split", r("quality_score", 6), "family_size")


@query(CAPPED + f"SELECT {BUILT} FROM c WHERE reason = '' ORDER BY split, score DESC, event_id LIMIT 60")
def corpus_export(spark, folder):
    ordered = corpus.export_order(small_corpus(spark, folder)[0], 60)
    return ordered.select("source_id", "intent", "split", r("quality_score", 6), "family_size")


@query(CAPPED + f"""
SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM ev UNION ALL SELECT 'duplicate_family' FROM b WHERE place > 1 UNION ALL SELECT reason FROM c WHERE reason <> '')
WHERE reason IS NOT NULL GROUP BY 1
""")
def corpus_rejections(spark, folder):
    return small_corpus(spark, folder)[1]


@query(GATED + f"""
SELECT (SELECT count(*) FROM ev) AS experience_count, count(DISTINCT f) AS eligible_experience_count, (SELECT count(*) FROM ev) - count(DISTINCT f) AS rejected_experience_count,
  0::BIGINT AS candidate_strategy_count, 0::BIGINT AS trusted_strategy_count, 'teacher_execution' AS last_plan_source, count(*) > 0 AND (SELECT count(*) FROM (SELECT {REASON} AS reason FROM ev) WHERE reason LIKE 'unsafe%') = 0 AS privacy_gate_passed FROM g
""")
def learning_status(spark, folder):
    return corpus.learning_status(learning_events(spark, folder))[0]


def whole_corpus(spark, folder):
    best = corpus.best_of_family(corpus.event_records(learning_events(spark, folder)).filter("rejected is null"))
    return best.withColumn("split", corpus.stable_split(F.col("family_fingerprint")))


WHOLE = GATED + f""", c AS (SELECT *, {SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY score DESC, created_at DESC, event_id DESC) AS place, {HASHED} FROM g) WHERE place = 1)"""


@query(WHOLE + """
SELECT 'intent' AS dimension, intent AS key, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'tool_graph', array_to_string(tool_sequence, '|'), count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'steps', len(tool_sequence)::VARCHAR, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'predicates', len(operators)::VARCHAR, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'plan_source', 'teacher_execution', count(*) FROM c UNION ALL SELECT 'split', split, count(*) FROM c GROUP BY ALL
""")
def corpus_distributions(spark, folder):
    return corpus.corpus_distributions(whole_corpus(spark, folder))


SUMMARY = WHOLE + """, i AS (SELECT max(n) AS mi, count(*) AS ic FROM (SELECT count(*) AS n FROM c GROUP BY intent)), t AS (SELECT max(n) AS mt, count(*) AS tc FROM (SELECT count(*) AS n FROM c GROUP BY tool_sequence)),
s AS (SELECT count(*) AS eligible_examples, count(DISTINCT f) AS family_count, ic AS intent_count, tc AS tool_graph_count, round(mi / count(*)::DOUBLE, 4) AS largest_intent_share,
  round(mt / count(*)::DOUBLE, 4) AS largest_tool_graph_share, round(sum(len(tool_sequence)) / count(*)::DOUBLE, 4) AS average_tool_steps, round(count(*) FILTER (len(tool_sequence) = 1) * 100.0::DOUBLE / count(*), 2) AS single_step_pct,
  round(100.0::DOUBLE - round(count(*) FILTER (len(tool_sequence) = 1) * 100.0::DOUBLE / count(*), 2), 2) AS multi_step_pct, round(avg(score), 4) AS average_quality, count(*) FILTER (split = 'train') AS train_count,
  count(*) FILTER (split = 'validation') AS validation_count, count(*) FILTER (split = 'test') AS test_count FROM c, i, t GROUP BY ic, tc, mi, mt)
"""


@query(SUMMARY + "SELECT * FROM s")
def corpus_summary(spark, folder):
    return corpus.corpus_summary(whole_corpus(spark, folder))


@query(SUMMARY + """
SELECT eligible_examples, round(greatest(0, least(1, 0.30::DOUBLE * least(1, eligible_examples / 500.0::DOUBLE) + 0.20::DOUBLE * least(1, family_count / 50.0::DOUBLE) + 0.15::DOUBLE * least(1, intent_count / 10.0::DOUBLE)
  + 0.20::DOUBLE * least(1, average_quality / 0.96::DOUBLE) + 0.075::DOUBLE * greatest(0, 1 - largest_intent_share / 0.4::DOUBLE) + 0.075::DOUBLE * greatest(0, 1 - largest_tool_graph_share / 0.4::DOUBLE))), 4) AS readiness_score,
  eligible_examples >= 500 AND intent_count >= 10 AS ready, array_to_string(list_filter([CASE WHEN eligible_examples < 500 THEN 'eligible_examples_below_threshold' END, CASE WHEN family_count < 50 THEN 'family_count_below_threshold' END,
  CASE WHEN intent_count < 10 THEN 'intent_count_below_threshold' END, CASE WHEN average_quality < 0.96 THEN 'quality_below_readiness_threshold' END,
  CASE WHEN largest_intent_share > 0.4 THEN printf('largest_intent_share=%.3f', largest_intent_share) END, CASE WHEN largest_tool_graph_share > 0.4 THEN printf('largest_tool_graph_share=%.3f', largest_tool_graph_share) END],
  lambda x: x IS NOT NULL), ',') AS reasons FROM s
""")
def corpus_readiness(spark, folder):
    return corpus.readiness(corpus.corpus_summary(whole_corpus(spark, folder))).select("eligible_examples", "readiness_score", "ready", "reasons")


@query(EV + """
, c AS (SELECT * FROM ev WHERE success), k AS (SELECT count(DISTINCT x) AS k FROM (SELECT unnest(semantic_roles) AS x FROM c))
SELECT count(*) AS row_count, count(DISTINCT intent)::INT AS intent_diversity, count(DISTINCT logical_structure)::INT AS predicate_diversity, least(1.0::DOUBLE, k / 8.0::DOUBLE) AS role_coverage,
  round(count(*) FILTER (NOT critic_passed) / count(*)::DOUBLE, 4) AS ambiguity_rate, round(avg(score), 4) AS average_quality,
  avg(score) >= 0.95 AND count(*) FILTER (NOT critic_passed) / count(*)::DOUBLE <= 0.1 AS ready, '' AS notes FROM c, k GROUP BY k
""")
def corpus_semantic_readiness(spark, folder):
    targets = learning_events(spark, folder).filter("success").select(
        "intent", "logical_structure", "semantic_roles", (~F.col("critic_passed")).alias("ambiguous"), F.col("score").alias("quality"))
    return corpus.semantic_readiness(targets)


@query(EV + """
, g AS (SELECT intent, logical_structure, array_to_string(tool_sequence, '|') AS tools, count(*) AS evidence_count, round(avg(score), 4) AS average_quality, max(created_at) AS last_seen_at,
  array_to_string(list_sort(list_distinct(flatten(list(semantic_roles)))), ',') AS roles FROM ev WHERE success GROUP BY ALL)
SELECT *, CASE WHEN evidence_count < 7 THEN 'validated' ELSE 'trusted' END AS lifecycle_state FROM g WHERE evidence_count >= 2
""")
def strategies_discovered(spark, folder):
    found = corpus.discover_strategies(learning_events(spark, folder))
    return found.select("intent", "logical_structure", F.array_join("tool_sequence", "|").alias("tools"), F.array_join("semantic_roles", ",").alias("roles"),
                        "evidence_count", "average_quality", "lifecycle_state", "last_seen_at")


def skill_runs(spark, folder):
    events = load(spark, folder, "events")
    return events.select(
        F.concat(F.lit("learned."), F.col("event_type")).alias("skill_id"), F.col("ts").alias("at"), F.col("event_id").alias("run_id"),
        (F.col("value") > 8).alias("success"), F.round(F.least(F.lit(1.0), F.col("value") / 25), 3).alias("score"),
    )


@query("""
WITH RECURSIVE e AS (SELECT 'learned.' || event_type AS skill_id, ts, event_id, value > 8 AS success, round(least(1.0, value / 25), 3) AS score,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
d AS (SELECT skill_id, i, round((CASE WHEN success THEN 0.04 ELSE -0.06 END::DOUBLE + (score - 0.5) * 0.08::DOUBLE) * 10000)::BIGINT AS step, CASE WHEN score > 0 THEN score WHEN success THEN 1 ELSE 0 END::DOUBLE AS seen FROM e),
w AS (SELECT skill_id, 0::BIGINT AS i, 5000::BIGINT AS c, 0.0::DOUBLE AS m FROM d WHERE i = 1
  UNION ALL SELECT w.skill_id, d.i, least(9900, greatest(500, w.c + d.step)), CASE WHEN d.i = 1 THEN d.seen * 10000 ELSE floor((w.m * (d.i - 1) + d.seen * 10000) / d.i + 0.5) END
  FROM w JOIN d ON d.skill_id = w.skill_id AND d.i = w.i + 1),
q AS (SELECT skill_id, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, max(ts) AS last_seen_at FROM e GROUP BY 1),
z AS (SELECT q.*, l.c / 10000.0::DOUBLE AS confidence, l.m / 10000.0::DOUBLE AS average_quality_score FROM q JOIN (SELECT skill_id, arg_max(c, i) AS c, arg_max(m, i) AS m FROM w GROUP BY 1) l USING (skill_id))
SELECT *, CASE WHEN failure_count >= 3 AND failure_count > success_count THEN 'demoted' WHEN success_count >= 7 AND average_quality_score >= 0.9 THEN 'trusted'
       WHEN success_count >= 4 AND average_quality_score >= 0.85 THEN 'validated' WHEN success_count >= 2 THEN 'candidate' ELSE 'bootstrap' END AS state FROM z
""")
def skill_states(spark, folder):
    return corpus.skill_states(skill_runs(spark, folder))


def strategy_rows(spark, folder):
    found = corpus.discover_strategies(learning_events(spark, folder)).withColumn("state", F.lit("candidate"))
    skills = found.select(
        F.regexp_replace("strategy_id", "^strategy\\.", "learned.").alias("skill_id"), (F.col("evidence_count") % 9).alias("success_count"),
        (F.col("evidence_count") % 5).alias("failure_count"), F.col("average_quality").alias("average_quality_score"),
    )
    return found, skills.withColumn("state", corpus.lifecycle(F.col("success_count"), F.col("failure_count"), F.col("average_quality_score")))


@query(EV + """
, g AS (SELECT count(*) AS n, round(avg(score), 4) AS q FROM ev WHERE success GROUP BY intent, logical_structure, array_to_string(tool_sequence, '|') HAVING count(*) >= 2),
b AS (SELECT n, q, intent FROM (SELECT intent, count(*) AS n, round(avg(score), 4) AS q FROM ev WHERE success GROUP BY intent, logical_structure, array_to_string(tool_sequence, '|')) WHERE n >= 2)
SELECT CASE WHEN n % 3 = 0 THEN 'strategy_lifecycle_not_trusted' WHEN q < 0.95 THEN 'strategy_quality_below_threshold' WHEN intent = 'Bad Intent' THEN 'unsafe_intent' END AS reason, count(*) AS n FROM b GROUP BY 1
""")
def strategy_gate_reasons(spark, folder):
    found = corpus.discover_strategies(learning_events(spark, folder))
    state = F.when(F.col("evidence_count") % 3 == 0, "candidate").otherwise("trusted")
    rows = found.withColumns({"state": state, "plan_template_id": F.lit(None).cast("string"), "created_at": F.col("last_seen_at")})
    return corpus.strategy_records(rows).groupBy(F.col("rejected").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# The state of a strategy is the higher of its own and its learned skill's.
RANKS = "['bootstrap', 'observed', 'candidate', 'promoted', 'validated', 'trusted']"
STATUS = EV + """
, g AS (SELECT intent, logical_structure, array_to_string(tool_sequence, '|') AS tools, count(*) AS n, round(avg(score), 4) AS q FROM ev WHERE success GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT *, n % 9 AS s, n % 5 AS f, CASE WHEN n < 7 THEN 'validated' ELSE 'trusted' END AS own FROM g),
t AS (SELECT *, CASE WHEN f >= 3 AND f > s THEN 'demoted' WHEN s >= 7 AND q >= 0.9 THEN 'trusted' WHEN s >= 4 AND q >= 0.85 THEN 'validated' WHEN s >= 2 THEN 'candidate' ELSE 'bootstrap' END AS skill FROM k),
u AS (SELECT *, own AS lifecycle, greatest(n, s + f) AS evidence, CASE WHEN own = 'validated' THEN 'trusted' END AS next_stage FROM t),
v AS (SELECT intent, tools, logical_structure, lifecycle, skill AS registry_lifecycle, evidence AS evidence_count, s AS success_count, f AS failure_count, q AS average_quality, next_stage,
  CASE WHEN next_stage = 'trusted' THEN 7 END AS required_evidence, CASE WHEN next_stage = 'trusted' THEN 0.9 END::DOUBLE AS required_quality,
  list_filter([CASE WHEN f >= 3 AND f > s THEN 'failure_tolerance_exceeded' END, CASE WHEN next_stage = 'trusted' AND evidence < 7 THEN 'need_' || (7 - evidence) || '_more_evidence' END,
    CASE WHEN next_stage = 'trusted' AND q < 0.9 THEN 'quality_below_0.90' END], lambda x: x IS NOT NULL) AS promotion_blockers FROM u)
"""


@query(STATUS + "SELECT * EXCLUDE (tools, logical_structure) FROM v")
def strategy_status(spark, folder):
    return corpus.strategy_status(*strategy_rows(spark, folder)).drop("strategy_id", "learned_skill_id")


@query(STATUS + "SELECT lifecycle, count(*) AS n, round(avg(evidence_count), 4) AS average_evidence, round(avg(average_quality), 4) AS average_quality FROM v GROUP BY 1")
def strategy_status_rollup(spark, folder):
    return corpus.status_rollup(corpus.strategy_status(*strategy_rows(spark, folder)))


@query(EV + """
, s AS (SELECT intent, ['workflow', 'workflow'][1] AS plan_kind, CASE WHEN len(operators) > 0 THEN 'category|measure' ELSE 'measure' END AS roles,
  CASE WHEN len(operators) > 0 THEN 'equals:number' ELSE '' END AS structure, logical_structure, array_to_string(tool_sequence, '|') AS tools, score FROM ev)
SELECT intent, plan_kind, roles, structure, logical_structure, tools, count(*) AS support_count, round(avg(score), 4) AS average_quality FROM s GROUP BY ALL
""")
def plan_templates(spark, folder):
    events = learning_events(spark, folder).withColumns({
        "plan": F.col("plan_summary"), "column_roles": F.create_map(F.lit("a"), F.lit("category"), F.lit("b"), F.lit("measure"))})
    found = corpus.plan_templates(events)
    return found.select("intent", "plan_kind", F.array_join("required_roles", "|").alias("roles"), F.array_join("predicate_structure", ",").alias("structure"),
                        "logical_structure", F.array_join("tool_sequence", "|").alias("tools"), "support_count", "average_quality")


@query("""
SELECT split, count(*) AS n, count(*) FILTER (contains(lower(text), 'the and') OR contains(lower(text), 'mail1.example.com')) AS leaks FROM (
  SELECT text, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END AS split FROM documents) GROUP BY 1
""")
def corpus_leaks(spark, folder):
    lang = F.col("lang")
    rows = load(spark, folder, "documents").withColumn("split", F.when(lang == "en", "train").when(lang == "fr", "validation").otherwise("test"))
    return corpus.leak_counts(rows, "text", "split", ["The AND", "mail1.example.com"])


def corpus_lines(spark, folder):
    """Corpus lines of mixed quality, made from the events."""
    n = F.length("user_query")
    gates = '"execution_success":true,"critic_passed":true,"result_validation_passed":true,"plan_completeness_passed":%s,"privacy_validation_passed":true,"no_unresolved_ambiguity":true,"no_critical_repair":true'
    meta = F.concat(F.lit('{"quality":'), F.when(n % 7 == 0, "0.5").otherwise("0.97"), F.lit(","), F.lit(gates % "true"), F.lit(',"repair_count":0}'))
    intent = F.when(n % 5 == 0, "poetry").otherwise(F.col("intent"))
    source = F.concat(F.lit('{"intent":"'), intent, F.lit('","note":"'), F.when(n % 11 == 0, "sheet_name").otherwise("ok"), F.lit('"}'))
    output = F.concat(
        F.lit('{"intent":"'), intent, F.lit('","semantic_bindings":{},"predicate_graph":{"operators":["AND"],"logical_structure":"AND"},"aggregation":{"required":true},"ranking":{"direction":"desc"},"limit":'),
        F.when(n % 13 == 0, '"ten"').otherwise("null"), F.lit(',"requires_fallback":false,"confidence":'), F.when(n % 17 == 0, "1.5").otherwise("0.9"), F.lit("}"),
    )
    line = F.when(n % 19 == 0, "not json").otherwise(F.concat(F.lit('{"input":'), source, F.lit(',"output":'), output, F.lit(',"metadata":'), meta, F.lit("}")))
    return query_log(spark, folder).select("id", line.alias("line"), output.alias("output"), F.when(F.col("id") % 2 == 0, "train").otherwise("validation").alias("split"))


@query(WITH + """
, t AS (SELECT CASE WHEN id % 2 = 0 THEN 'train' ELSE 'validation' END AS split, length(user_query) AS n FROM log),
s AS (SELECT split, n % 19 <> 0 AS readable, n % 19 <> 0 AND n % 7 <> 0 AS eligible, n % 19 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 AS privacy_valid,
  n % 19 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 AND n % 5 <> 0 AS converted, n % 19 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 AND n % 5 <> 0 AND n % 13 <> 0 AND n % 17 <> 0 AS valid FROM t)
SELECT split, count(*) AS total, count(*) FILTER (readable) AS readable, count(*) FILTER (eligible) AS eligible, count(*) FILTER (privacy_valid) AS privacy_valid,
  count(*) FILTER (converted) AS converted, count(*) FILTER (valid) AS valid FROM s GROUP BY 1
""")
def audit_funnel(spark, folder):
    return corpus.audit_funnel(corpus.audit_rows(corpus_lines(spark, folder)))


@query(WITH + """
SELECT CASE WHEN n % 19 = 0 THEN 'OTHER_SAFE_REASON' WHEN n % 7 = 0 THEN 'INELIGIBLE_EVENT' WHEN n % 11 = 0 THEN 'PRIVACY_GATE_FAILED' WHEN n % 5 = 0 THEN 'UNSUPPORTED_INTENT'
  WHEN n % 13 = 0 OR n % 17 = 0 THEN 'INVALID_TARGET_SCHEMA' END AS reason, count(*) AS n FROM (SELECT length(user_query) AS n FROM log) GROUP BY 1
""")
def audit_reasons(spark, folder):
    return corpus.audit_rows(corpus_lines(spark, folder)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + """
SELECT id, CASE WHEN n % 5 = 0 THEN 'unsupported_intent' WHEN n % 13 = 0 THEN 'invalid_limit' WHEN n % 17 = 0 THEN 'invalid_confidence' END AS reason FROM (SELECT id, length(user_query) AS n FROM log)
""")
def target_shapes(spark, folder):
    return corpus_lines(spark, folder).select("id", corpus.target_reason(F.col("output")).alias("reason"))


# ---- evaluation and retrieval -----------------------------------------------


def expected_plans(spark, folder):
    return learning_events(spark, folder).select(
        F.col("event_id").alias("item_id"), F.array(F.col("intent"), F.lit("k")).alias("predicate_keys"), "semantic_roles", F.col("tool_sequence").alias("tool_graph"), "logical_structure"
    )


def predicted_plans(spark, folder):
    e = learning_events(spark, folder)
    return e.select(
        F.col("event_id").alias("item_id"), F.array("intent").alias("predicate_keys"), F.slice("semantic_roles", 1, 1).alias("semantic_roles"),
        F.when(F.col("success"), F.col("tool_sequence")).otherwise(F.array(F.lit("invalid.tool"), F.lit("sql.validate"))).alias("tool_graph"),
        F.when(F.col("critic_passed"), F.col("logical_structure")).otherwise("OR").alias("logical_structure"), F.col("success").alias("plan_valid"),
    )


@query(EV + """
, t AS (SELECT *, CASE WHEN success THEN tool_sequence ELSE ['invalid.tool', 'sql.validate'] END AS p FROM ev),
s AS (SELECT count(*) AS items, avg(success::INT) AS plan_validity, avg((critic_passed OR logical_structure = 'OR')::INT) AS structure_accuracy, sum(len(p))::DOUBLE AS np, sum(len(tool_sequence))::DOUBLE AS ne,
  sum(len(list_filter(p, lambda x: list_contains(tool_sequence, x))))::DOUBLE AS h, sum(len(list_filter(p, lambda x: starts_with(x, 'invalid.'))))::DOUBLE AS bad FROM t)
SELECT items, 0.0::DOUBLE AS exact_match, round(plan_validity, 6) AS plan_validity, 0.5::DOUBLE AS predicate_coverage, 0.5::DOUBLE AS role_coverage, round(structure_accuracy, 6) AS structure_accuracy,
  round(2 * (h / np) * (h / ne) / (h / np + h / ne), 6) AS tool_f1, round(bad / np, 6) AS invalid_tool_rate FROM s
""")
def plan_metrics(spark, folder):
    found = corpus.plan_metrics(predicted_plans(spark, folder), expected_plans(spark, folder))
    return rounded(found, dict.fromkeys(["exact_match", "plan_validity", "predicate_coverage", "role_coverage", "structure_accuracy", "tool_f1", "invalid_tool_rate"], 6))


@query(EV + """SELECT count(*) AS items, round(avg(success::INT), 6) AS valid_rate, round(avg((success AND true)::INT), 6) AS intent_accuracy,
  round(avg((success AND critic_passed)::INT), 6) AS logical_structure_accuracy FROM ev""")  # fmt: skip
def field_accuracy(spark, folder):
    e = learning_events(spark, folder)
    expected = e.select(F.col("event_id").alias("item_id"), "intent", "logical_structure")
    predicted = e.select(F.col("event_id").alias("item_id"), "intent", F.when(F.col("critic_passed"), F.col("logical_structure")).alias("logical_structure"), F.col("success").alias("valid"))
    found = corpus.field_accuracy(predicted, expected, fields=["intent", "logical_structure"])
    return rounded(found, dict.fromkeys(["valid_rate", "intent_accuracy", "logical_structure_accuracy"], 6))


@query(EV + """
, t AS (SELECT *, CASE WHEN success THEN tool_sequence ELSE ['sql.validate'] END AS p FROM ev)
SELECT count(*) AS cases, 0 AS missing_tool, count(*) FILTER (p <> tool_sequence) AS wrong_tool_order, count(*) FILTER (list_sort(p) <> list_sort(tool_sequence)) AS wrong_tool,
  count(*) FILTER (score < 0.96) AS missing_predicate, count(*) FILTER (NOT critic_passed) AS wrong_semantic_role_binding, count(*) FILTER (tool_sequence[1] = 'sql.group_by' AND NOT success) AS wrong_aggregation,
  count(*) FILTER (len(tool_sequence) > 1 AND len(p) < len(tool_sequence)) AS incomplete_multi_step_plan, count(*) FILTER (NOT success) AS correct_intent_wrong_executable_plan,
  count(*) FILTER (repair_count > 0) AS unsupported_or_fallback FROM t
""")
def failure_modes(spark, folder):
    e = learning_events(spark, folder)
    pairs = e.select(
        F.when(F.col("success"), F.col("tool_sequence")).otherwise(F.array(F.lit("sql.validate"))).alias("predicted_tools"), F.col("tool_sequence").alias("expected_tools"),
        F.when(F.col("score") < 0.96, 0.5).otherwise(1.0).alias("predicate_coverage"), F.when(F.col("critic_passed"), 1.0).otherwise(0.5).alias("role_coverage"),
        F.col("success").alias("has_group_by"), F.lit(True).alias("intent_correct"), F.col("success").alias("tool_valid"),
        F.when(F.col("repair_count") > 0, "fallback").otherwise("model").alias("plan_source"),
    )
    return querylog.failure_modes(pairs)


RETRIEVE_NOW = dt.datetime(2024, 6, 1)


def experience_records(spark, folder):
    e = learning_events(spark, folder)
    return e.select(
        F.col("event_id").alias("record_id"), F.to_timestamp("created_at").alias("created_at"), "intent", F.substring(F.sha2("logical_structure", 256), 1, 8).alias("signature"),
        F.col("dataset_semantic_signature").alias("dataset_signature"), F.col("semantic_roles").alias("roles"), F.col("logical_structure").alias("structure"),
        F.col("tool_sequence").alias("tools"), "success", "score", F.when(~F.col("critic_passed"), "critic").alias("failure_reason"), F.lit(None).cast("string").alias("template_id"),
    )


@query(EV + """
, r AS (SELECT event_id AS record_id, replace(created_at, '+00:00', '')::TIMESTAMP AS ts, intent, logical_structure AS s, semantic_roles, tool_sequence, success, score, critic_passed FROM ev),
q AS (SELECT conv_id * 100 + turn AS question_id, ['filter', 'analytics', 'cleaning', 'operation', 'sentiment'][((conv_id + turn) % 5)::INT + 1] AS intent,
  ['role_src' || (conv_id % 20), 'lang_en'] AS roles, ['sql.validate'] AS tools FROM conversations),
p AS (SELECT question_id, record_id, ts, least(0.99::DOUBLE, CASE WHEN q.intent = r.intent THEN 0.25 ELSE 0 END::DOUBLE + least(0.18::DOUBLE, 0.12::DOUBLE * len(list_intersect(semantic_roles, q.roles))) + CASE WHEN s = 'AND' THEN 0.08 ELSE 0 END::DOUBLE
  + least(0.12::DOUBLE, 0.12::DOUBLE * len(list_intersect(tool_sequence, q.tools))) + CASE WHEN success THEN 0.08 ELSE 0 END::DOUBLE - CASE WHEN NOT critic_passed THEN 0.05 ELSE 0 END::DOUBLE
  + greatest(0, least(0.08::DOUBLE, score * 0.08::DOUBLE)) + greatest(0, 0.08::DOUBLE - least(0.08::DOUBLE, epoch(TIMESTAMP '2024-06-01' - ts) / 86400.0::DOUBLE / 365.0::DOUBLE * 0.08::DOUBLE))) AS score FROM q, r),
k AS (SELECT question_id, record_id, ts, round(score, 4) AS score FROM p WHERE score > 0.04)
SELECT question_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ts DESC, record_id) AS place FROM k) WHERE place <= 5
""")
def retrieve_experiences(spark, folder):
    turns = load(spark, folder, "conversations")
    names = F.array(*[F.lit(i) for i in ("filter", "analytics", "cleaning", "operation", "sentiment")])
    asked = turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.get(names, ((F.col("conv_id") + F.col("turn")) % 5).cast("int")).alias("intent"),
        F.lit("none").alias("signature"), F.lit("none").alias("dataset_signature"), F.array(F.concat(F.lit("role_src"), (F.col("conv_id") % 20).cast("string")), F.lit("lang_en")).alias("roles"),
        F.lit("AND").alias("structure"), F.array(F.lit("sql.validate")).alias("tools"),
    )
    found = querylog.retrieve(asked, experience_records(spark, folder), "experience", RETRIEVE_NOW)
    return found.select("question_id", F.col("place").cast("long").alias("place"), "score")


def asked_features(spark, folder):
    conv, turn = F.col("conv_id"), F.col("turn")
    sha = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    tools = F.when(turn % 2 == 0, F.array(F.lit("sql.validate"), F.lit("sql.filter"))).otherwise(F.array(F.lit("clean.fill")))
    return load(spark, folder, "conversations").select(
        (conv * 100 + turn).alias("question_id"), F.get(F.array(*[F.lit(i) for i in INTENTS]), ((conv + turn) % 5).cast("int")).alias("intent"),
        sha(F.get(F.array(F.lit("AND"), F.lit("SINGLE"), F.lit("XOR")), (conv % 3).cast("int")), 8).alias("signature"), sha(F.concat(F.lit("src"), (conv % 20).cast("string")), 16).alias("dataset_signature"),
        F.array(F.concat(F.lit("role_src"), (conv % 20).cast("string")), F.lit("lang_en")).alias("roles"),
        F.get(F.array(F.lit("AND"), F.lit("SINGLE"), F.lit("OR")), (turn % 3).cast("int")).alias("structure"), tools.alias("tools"),
    )


def learned_records(spark, folder):
    tools = F.col("tool_sequence")
    state = F.get(F.array(F.lit("promoted"), F.lit("validated"), F.lit("trusted")), F.size(tools) - 1)
    return learning_events(spark, folder).select(
        F.col("event_id").alias("record_id"), F.to_timestamp("created_at").alias("created_at"), "intent", F.substring(F.sha2("logical_structure", 256), 1, 8).alias("signature"),
        F.col("dataset_semantic_signature").alias("dataset_signature"), F.col("semantic_roles").alias("roles"), F.col("logical_structure").alias("structure"), tools.alias("tools"),
        F.col("score").alias("quality"), (F.size("operators") + F.size(tools)).alias("support"), state.alias("state"), F.get("semantic_roles", 0).alias("requested_role"), F.get(tools, 0).alias("preferred"),
    )


ASKED = EV + """
, r AS (SELECT event_id AS record_id, replace(created_at, '+00:00', '')::TIMESTAMP AS ts, intent, substr(sha256(logical_structure), 1, 8) AS signature, substr(sha256(semantic_roles[1][6:]), 1, 16) AS dataset_signature,
  semantic_roles AS roles, logical_structure AS structure, tool_sequence AS tools, score AS quality, len(operators) + len(tool_sequence) AS support, ['promoted', 'validated', 'trusted'][len(tool_sequence)] AS state FROM ev),
q AS (SELECT conv_id * 100 + turn AS question_id, ['filter', 'analytics', 'cleaning', 'operation', 'sentiment'][((conv_id + turn) % 5)::INT + 1] AS intent,
  substr(sha256(['AND', 'SINGLE', 'XOR'][(conv_id % 3)::INT + 1]), 1, 8) AS signature, substr(sha256('src' || (conv_id % 20)), 1, 16) AS dataset_signature, ['role_src' || (conv_id % 20), 'lang_en'] AS roles,
  ['AND', 'SINGLE', 'OR'][(turn % 3)::INT + 1] AS structure, CASE WHEN turn % 2 = 0 THEN ['sql.validate', 'sql.filter'] ELSE ['clean.fill'] END AS tools FROM conversations)
"""


def _best(parts: list[str], least: str) -> str:
    total = " + ".join(f"({p})::DOUBLE" for p in parts)
    return ASKED + f"""
, k AS (SELECT question_id, record_id, ts, round(least(0.99, score), 4) AS score FROM (SELECT question_id, record_id, ts, {total} AS score FROM q, r) WHERE score > {least})
SELECT question_id, place, record_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ts DESC, record_id) AS place FROM k) WHERE place <= 5"""


def _same(name, weight):
    return f"CASE WHEN r.{name} = q.{name} THEN {weight} ELSE 0 END"


def _common(name, most):
    return f"least({most}, 0.12 * len(list_intersect(r.{name}, q.{name})))"


def best_records(spark, folder, kind):
    found = querylog.retrieve(asked_features(spark, folder), learned_records(spark, folder), kind, RETRIEVE_NOW)
    return found.select("question_id", F.col("place").cast("long").alias("place"), "record_id", "score")


@query(_best([_same("intent", 0.3), _same("structure", 0.16), _common("roles", 0.2), _common("tools", 0.14), "least(0.08, quality * 0.08)", "least(0.08, support * 0.02)",
              "CASE WHEN state IN ('validated', 'trusted') THEN 0.08 ELSE 0 END", "CASE WHEN state = 'trusted' THEN 0.05 ELSE 0 END"], "0.05"))
def retrieve_templates(spark, folder):
    return best_records(spark, folder, "template")


@query(_best([_same("intent", 0.25), _same("structure", 0.15), _common("roles", 0.18), _common("tools", 0.12), _same("signature", 0.2), "least(0.08, quality * 0.05)"], "0.04"))
def retrieve_lessons(spark, folder):
    return best_records(spark, folder, "lesson")


@query(_best([_same("intent", 0.25), _same("signature", 0.35), _common("roles", 0.18), _common("tools", 0.14), "least(0.1, quality * 0.1)", "least(0.05, support * 0.01)",
              "CASE WHEN state = 'promoted' THEN 0.05 ELSE 0 END"], "0.04"))
def retrieve_strategies(spark, folder):
    return best_records(spark, folder, "strategy")


@query(_best([_same("intent", 0.28), _same("dataset_signature", 0.18), "CASE WHEN list_contains(q.roles, r.roles[1]) THEN 0.2 ELSE 0 END", "CASE WHEN list_contains(q.tools, r.tools[1]) THEN 0.08 ELSE 0 END"], "0.04"))
def retrieve_corrections(spark, folder):
    return best_records(spark, folder, "correction")


@query(f"""
WITH s AS (SELECT DISTINCT (CASE WHEN p_size % 5 = 0 THEN 'filter.multi_' WHEN p_size % 5 = 1 THEN 'clean.' WHEN p_size % 5 = 2 THEN 'analytics.' WHEN p_size % 5 = 3 THEN 'transform.' ELSE 'privacy.' END || p_size) AS id,
  CASE WHEN p_size % 3 = 0 THEN ['boolean_capability', 'numeric_metric'] WHEN p_size % 3 = 1 THEN ['date', 'city', 'rating_metric'] ELSE ['text'] END AS roles, 'pandas.' || CASE WHEN p_size % 2 = 0 THEN 'Filter' ELSE 'groupby' END AS tool,
  CASE WHEN p_size % 4 = 0 THEN ['sum', 'top'] ELSE ['fill'] END AS hints, CASE WHEN p_size % 7 = 0 THEN 'A chain of Steps' ELSE 'One thing' END AS description, 0.75::DOUBLE + (p_size % 30) / 100.0::DOUBLE AS confidence FROM part),
q AS (SELECT conv_id * 100 + turn AS question_id, ['filter', 'analytics', 'cleaning', 'operation', 'sentiment'][((conv_id + turn) % 5)::INT + 1] AS intent, CASE WHEN conv_id % 2 = 0 THEN ['date', 'boolean_capability', 'numeric_metric'] ELSE ['city', 'date', 'text', 'rating_metric'] END AS roles,
  CASE WHEN turn % 2 = 0 THEN ['filter'] ELSE ['merge'] END AS tool_hints, CASE WHEN conv_id % 3 = 0 THEN ['top'] ELSE ['fill', 'x'] END AS operation_hints, ['AND', 'SEQUENTIAL', 'SINGLE'][(turn % 3)::INT + 1] AS structure, conv_id % 3 AS predicates, turn % 2 AS booleans, conv_id % 4 AS comparisons FROM conversations),
p AS (SELECT question_id, id, (CASE WHEN id LIKE 'filter.%' AND intent IN ('filter', 'analytics') THEN 0.18 ELSE 0 END)::DOUBLE + (CASE WHEN id LIKE 'clean.%' AND intent IN ('cleaning', 'operation') THEN 0.18 ELSE 0 END)::DOUBLE
  + (CASE WHEN id LIKE 'analytics.%' AND intent IN ('analytics', 'filter') THEN 0.14 ELSE 0 END)::DOUBLE + (CASE WHEN id LIKE 'transform.%' AND intent IN ('cleaning', 'operation') THEN 0.14 ELSE 0 END)::DOUBLE
  + (CASE WHEN id LIKE 'privacy.%' AND intent = 'operation' THEN 0.08 ELSE 0 END)::DOUBLE + least(0.28, 0.12 * len(list_intersect(s.roles, q.roles)))::DOUBLE
  + (CASE WHEN len(list_filter(tool_hints, lambda h: contains(lower(tool), h))) > 0 THEN 0.12 ELSE 0 END)::DOUBLE + (CASE WHEN len(list_intersect(hints, operation_hints)) > 0 THEN 0.12 ELSE 0 END)::DOUBLE
  + (CASE WHEN structure IN ('AND', 'MIXED') AND contains(id, 'multi') THEN 0.08 ELSE 0 END)::DOUBLE + (CASE WHEN structure = 'SEQUENTIAL' AND (contains(lower(description), 'step') OR contains(lower(description), 'chain')) THEN 0.08 ELSE 0 END)::DOUBLE
  + (CASE WHEN predicates > 1 AND id LIKE 'filter.%' THEN 0.06 ELSE 0 END)::DOUBLE + (CASE WHEN booleans > 0 AND list_contains(s.roles, 'boolean_capability') THEN 0.08 ELSE 0 END)::DOUBLE
  + (CASE WHEN comparisons > 0 AND len(list_intersect(s.roles, ['rating_metric', 'numeric_metric', 'currency_metric'])) > 0 THEN 0.06 ELSE 0 END)::DOUBLE + greatest(0, least(0.1, confidence - 0.8))::DOUBLE AS score FROM q, s),
k AS (SELECT question_id, id, round(least(0.99, score), 4) AS score FROM p WHERE score > 0.03)
SELECT question_id, place, id AS skill_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS place FROM k) WHERE place <= 5
""")
def retrieve_skills(spark, folder):
    size, conv, turn = F.col("p_size"), F.col("conv_id"), F.col("turn")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    chosen = lambda values, n: F.get(words(*values), n.cast("int"))
    skills = load(spark, folder, "part").select(
        F.concat(chosen(["filter.multi_", "clean.", "analytics.", "transform.", "privacy."], size % 5), size.cast("string")).alias("id"),
        F.when(size % 3 == 0, words("boolean_capability", "numeric_metric")).when(size % 3 == 1, words("date", "city", "rating_metric")).otherwise(words("text")).alias("roles"),
        F.concat(F.lit("pandas."), chosen(["Filter", "groupby"], size % 2)).alias("tool"), F.when(size % 4 == 0, words("sum", "top")).otherwise(words("fill")).alias("hints"),
        F.when(size % 7 == 0, "A chain of Steps").otherwise("One thing").alias("description"), (F.lit(0.75) + (size % 30) / 100.0).alias("confidence"),
    ).distinct()
    asked = load(spark, folder, "conversations").select(
        (conv * 100 + turn).alias("question_id"), chosen(INTENTS, (conv + turn) % 5).alias("intent"),
        F.when(conv % 2 == 0, words("date", "boolean_capability", "numeric_metric")).otherwise(words("city", "date", "text", "rating_metric")).alias("roles"),
        F.when(turn % 2 == 0, words("filter")).otherwise(words("merge")).alias("tool_hints"), F.when(conv % 3 == 0, words("top")).otherwise(words("fill", "x")).alias("operation_hints"),
        chosen(["AND", "SEQUENTIAL", "SINGLE"], turn % 3).alias("structure"), (conv % 3).alias("predicates"), (turn % 2).alias("booleans"), (conv % 4).alias("comparisons"),
    )
    found = querylog.retrieve_skills(asked, skills)
    return found.select("question_id", F.col("place").cast("long").alias("place"), "skill_id", "score")


@query("""SELECT count(*) AS texts, count(*) FILTER (contains(lower(text), 'john smith')) AS leaks FROM documents""")
def forbidden_literals(spark, folder):
    hit = F.col("text").rlike(text.literal_patterns(["John Smith"]))
    return load(spark, folder, "documents").agg(F.count(F.lit(1)).alias("texts"), F.count_if(hit).alias("leaks"))
