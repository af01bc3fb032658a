"""The registered queries against their SQL, and the shape of their plans."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from workload import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    verdict = check.compare(spark, name, QUERIES[name], ORACLES.get(name), FOLDER, connection)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "plan_flagship", "plan_group_metrics", "describe_numbers", "data_quality_score", "cleaning_steps", "outliers_cap", "currency_convert_text", "plan_reuse",
    "log_invalidated", "places_filled", "key_value_overlap", "corpus_best_of_family", "retrieve_experiences", "audit_funnel", "question_features", "recommendations",
])
def test_plans_stay_native(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["plan_group_metrics"](spark, FOLDER))
    assert "GreaterThan(l_shipdate" in plan and "Not(EqualTo(l_returnflag" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "l_comment" not in schema and "l_suppkey" not in schema and "l_tax" not in schema


def test_top_n_is_cut_before_the_shuffle(spark):
    for name in ("plan_top_n_per_partition", "dedup_keep_first", "log_compaction", "corpus_best_of_family"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, FOLDER)), name


def test_average_filter_is_a_scalar_subquery(spark):
    plan = plan_of(QUERIES["plan_below_average"](spark, FOLDER))
    assert "Subquery" in plan and "Join" not in plan


def test_library_has_no_local_checkpoints_or_row_udfs():
    root = Path(__file__).resolve().parent.parent / "tablewright"
    for source in root.rglob("*.py"):
        code = source.read_text(encoding="utf-8")
        assert "localCheckpoint" not in code and "crossJoin" not in code and "@F.udf" not in code, source
