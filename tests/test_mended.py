"""Results which were once lost or wrong."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import predicates
from tablewright.operators import binning, categories, corpus, matching, profile, querylog
from tablewright.plans import report
from tablewright.sources import readers, writers

NOW = dt.datetime(2024, 3, 1)
LOG = ("id long, dataset_id string, organization_id string, user_query string, intent string, generated_sql string, success boolean, feedback_score int, "
       "planner_version string, created_at timestamp, schema_hash string")  # fmt: skip


@pytest.mark.parametrize("shared,left,right", [(14, 25, 14), (7, 10, 7), (3, 5, 3), (9, 10, 9), (29, 50, 29), (23, 40, 23)])
def test_overlap_exactly_at_the_bound(spark, shared, left, right):
    words = [f"w{i}" for i in range(left)]
    a = spark.createDataFrame([(1, " ".join(words))], "id long, t string")
    b = spark.createDataFrame([(2, " ".join(words[-right:]))], "id long, t string")
    assert matching.word_overlap(a, b, "id", "t", shared / left).count() == 1


def test_overlap_equals_brute_force(spark):
    pick = random.Random(1)
    texts = [" ".join(pick.sample("a b c d e f g h i j k l".split(), pick.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for minimum in (0.3, 0.5, 0.56, 0.7, 0.9):
        found = {(r.left_text, r.right_text) for r in matching.word_overlap(df, df, "id", "t", minimum).collect()}
        sets = {t: set(t.split()) for t in texts}
        assert found == {(x, y) for x in sets for y in sets if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= minimum}


def test_reuse_looks_at_all_entries(spark):
    rows = [(i, "d", None, "q", "filter", f"SELECT {i}", True, None, "v", NOW - dt.timedelta(days=10 - i), "x") for i in range(1, 8)]
    rules = spark.createDataFrame([(i, None, None, None, NOW) for i in range(2, 8)], "query_history_id long, schema_hash string, intent string, planner_version string, invalidated_at timestamp")
    sets = spark.createDataFrame([("d", "o", "s", "csv")], "dataset_id string, organization_id string, schema_hash string, source_type string")
    probes = spark.createDataFrame([("p", "d", "q", None, None)], "probe_id string, dataset_id string, user_query string, intent string, planner_version string")
    log = spark.createDataFrame(rows, LOG)
    found = querylog.plan_reuse(probes, log, sets, rules, NOW).first()
    assert (found.outcome, found.matched_id) == ("hit", 1)
    assert querylog.plan_reuse(probes, log, sets, rules, NOW, newest=5).first().outcome == "invalidated"


def test_records_of_other_intents_are_scored(spark):
    schema = ("record_id string, created_at timestamp, intent string, signature string, dataset_signature string, roles array<string>, structure string, tools array<string>, "
              "success boolean, score double, failure_reason string, template_id string")  # fmt: skip
    alike = ("twin", NOW, "analytics", "s", "d", ["r"], "AND", ["t"], True, 1.0, None, "x")
    nothing = ("alone", NOW, "other", "s2", "d2", [], "OR", [], True, 1.0, None, None)
    questions = spark.createDataFrame([("q", "filter", "s", "d", ["r"], "AND", ["t"]), ("blank", None, None, None, None, None, None)],
                                      "question_id string, intent string, signature string, dataset_signature string, roles array<string>, structure string, tools array<string>")
    found = {(r.question_id, r.record_id): r.score for r in querylog.retrieve(questions, spark.createDataFrame([alike, nothing], schema), "experience", NOW).collect()}
    assert set(found) == {("q", "twin"), ("q", "alone"), ("blank", "twin"), ("blank", "alone")} and found["q", "twin"] > found["q", "alone"]


def test_caps_are_off_unless_asked_for(spark):
    rows = [(f"s{i}", "filter", ["a"], 0.99, "2024") for i in range(250)]
    df = spark.createDataFrame(rows, "source_id string, intent string, tool_sequence array<string>, quality_score double, created_at string")
    policy = corpus.CorpusPolicy()
    assert corpus.capped(df, policy.per_intent, policy.per_tools).filter("cap_reason is null").count() == 250
    assert corpus.capped(df, 100, None).filter("cap_reason is null").count() == 100


@pytest.mark.parametrize("values", [[0.5, 3.0, 123456.4], [0.5, 7.0, 1234567.5], [0.0011, 0.0015, 0.0019], [1.0, 2.0, 3.0], [-3.3, 0.1, 9.9]])
def test_automatic_bins_hold_every_row(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.bin for r in binning.bin_counts(df, "v").collect()} <= set(binning.auto_ranges(df, "v"))
    assert binning.bin_counts(df, "v").agg(F.sum("n")).first()[0] == len(values)


def test_yes_no_columns(spark):
    df = spark.createDataFrame([("open", "t", "yes", ""), ("closed", "f", "n/a", "none"), ("open", "Ye", "NO", None)], "door string, mark string, answer string, gap string")
    found = {r.column: r.boolean_like for r in profile.boolean_like(df).collect()}
    assert (found["door"], found["mark"], found["answer"], found["gap"]) == (False, True, True, False)
    table, _ = categories.categorise(df, ["door", "mark", "answer"])
    assert [tuple(r)[4:] for r in table.collect()] == [("Open", "Yes", "Yes"), ("Closed", "No", "Unknown"), ("Open", "Yes", "No")]


def test_a_falling_quantity_is_no_falling_revenue(spark):
    days = spark.range(200).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"), (10000 * F.pow(F.lit(0.97), F.col("id"))).alias("quantity"))
    for column, advised in (("quantity", False), ("revenue", True)):
        df = days.withColumnRenamed("quantity", column)
        advice = report.build_report(df, ["trend", "recommendations"], value=column, period=F.date_trunc("month", "day"))["recommendations"].collect()
        assert any(r.category == "Revenue" for r in advice) is advised


def test_numbers_json_cannot_write(spark, tmp_path):
    df = spark.range(1).selectExpr("'a' AS split", "double('Infinity') AS v", "array(double('NaN'), 1D) AS l", "named_struct('x', double('-Infinity')) AS s", "map('k', float('NaN')) AS m")
    writers.write_jsonl(df, f"{tmp_path}/out")
    line = spark.read.text(f"{tmp_path}/out").first()[0]
    assert json.loads(line) == {"v": None, "l": [None, 1.0], "s": {"x": None}, "m": {"k": None}}


def test_the_first_event_of_an_id_wins(spark, tmp_path):
    lines = [json.dumps({"event_id": "a", "created_at": f"2024-01-{i:02d}"}) for i in range(9, 0, -1)] + ['{"created_at": "2023"}', '{"created_at": "2022"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines), encoding="utf-8")
    found = readers.read_event_log(spark, str(tmp_path / "log.jsonl"), "event_id string, created_at string", key="event_id").collect()
    assert sorted((r.event_id or "", r.created_at) for r in found) == [("", "2022"), ("", "2023"), ("a", "2024-01-09")]


def test_matches_stay_in_their_scope(spark):
    log = spark.createDataFrame([(1, "o1", "total sales by region", 0, NOW), (2, "o2", "total sales by region", 5, NOW), (3, None, "total sales by region and the month of the year", 0, NOW)],
                                "id long, organization_id string, user_query string, feedback_score int, created_at timestamp")
    probes = spark.createDataFrame([(10, "o1", "Total sales by region"), (11, "o3", "total sales by region"), (12, None, "total sales by region and the month of the years")],
                                   "probe_id long, organization_id string, user_query string")
    found = matching.similar_questions(probes, log, "probe_id", 0.8, native=True, scope=["organization_id"]).collect()
    assert {(r.probe_id, r.matched_id) for r in found} == {(10, 1), (12, 3)}
    assert {r.probe_id for r in matching.similar_questions(probes, log, "probe_id", 0.8, native=True).collect()} == {10, 11, 12}
    same_size = matching.similar_questions(probes, log, "probe_id", 1.0, scorer=lambda a, b: (F.length(a) == F.length(b)).cast("double"), overlap=0.9)
    assert {r.probe_id for r in same_size.collect()} == {10, 11}
    with pytest.raises(ValueError):
        matching.similar_questions(probes, log, "probe_id", overlap=0.5)


def test_text_equals_text(spark):
    df = spark.createDataFrame([("00123",), ("123",), ("9",), ("x",)], "code string")
    chosen = lambda operator, value: {r.code for r in df.filter(predicates.plan_condition(df, {"column": "code", "operator": operator, "value": value})).collect()}
    assert chosen("equals", "123") == {"123"} and chosen("greater_than", 30) == {"00123", "123"}
