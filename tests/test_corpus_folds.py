"""Caps in quality order and folds over runs against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import corpus, graph


def records(spark, rows):
    """(source, intent, tools, quality)"""
    made = [(s, i, t, float(q), "") for s, i, t, q in rows]
    df = spark.createDataFrame(made, "source_id string, intent string, t string, quality_score double, created_at string")
    return df.withColumn("tool_sequence", F.array("t")).drop("t").repartition(3)


def plain_caps(rows, per_intent, per_tools):
    intents, tools, out = Counter(), Counter(), {}
    for s, i, t, q in sorted(rows, key=lambda r: (r[3], r[0]), reverse=True):
        out[s] = "intent_cap" if intents[i] >= per_intent else "tool_graph_cap" if tools[t] >= per_tools else None
        if out[s] is None:
            intents[i] += 1
            tools[t] += 1
    return out


def reasons(df, per_intent, per_tools):
    return {r["source_id"]: r["cap_reason"] for r in corpus.capped(df, per_intent, per_tools).collect()}


def chain(n, name="", start=0):
    """Each record waits for the one before: i0-t0, t0-i1, i1-t1, t1-i2, …"""
    return [(f"{name}s{k:04d}", f"{name}i{(k + 1) // 2}", f"{name}t{k // 2}", 10**6 - start - k) for k in range(n)]


@pytest.mark.parametrize("window_rows", [0, 50_000])
@pytest.mark.parametrize("per_intent, per_tools", [(3, 4), (1, 1), (7, 2)])
def test_caps_by_brute_force(spark, monkeypatch, window_rows, per_intent, per_tools):
    monkeypatch.setattr(corpus, "WINDOW_ROWS", window_rows)
    pick = random.Random(per_intent)
    rows = [(f"s{k:03d}", f"i{pick.randrange(5)}", f"t{pick.randrange(6)}", pick.randrange(40)) for k in range(150)]
    assert reasons(records(spark, rows), per_intent, per_tools) == plain_caps(rows, per_intent, per_tools)


def test_long_chains_are_settled_in_few_rounds(spark, monkeypatch):
    """A chain of n records needs n rounds of the local rule."""
    rounds, tasks = [], []
    total, last = corpus.running_total, corpus._in_order
    monkeypatch.setattr(corpus, "running_total", lambda *a: rounds.append(1) or total(*a))
    monkeypatch.setattr(corpus, "_in_order", lambda *a: tasks.append(1) or last(*a))
    pick = random.Random(3)
    rows = chain(300) + chain(90, "b", 7) + [(f"r{k:03d}", f"x{pick.randrange(9)}", f"t{pick.randrange(40)}", pick.randrange(10**6)) for k in range(200)]
    assert reasons(records(spark, rows), 1, 1) == plain_caps(rows, 1, 1)
    assert len(rounds) <= 2 * math.ceil(math.log2(len(rows))) and len(tasks) == 1


def test_taken_records_count_only_for_those_after_them(spark, monkeypatch):
    monkeypatch.setattr(corpus, "_settled", lambda state, i, t: corpus._in_order(state, i, t))
    pick = random.Random(4)
    rows = [(f"s{k:03d}", f"i{pick.randrange(4)}", f"t{pick.randrange(4)}", pick.randrange(900)) for k in range(120)]
    assert reasons(records(spark, rows), 3, 2) == plain_caps(rows, 3, 2)


def test_one_cap_only_and_no_records(spark):
    rows = [(f"s{k}", "i", f"t{k % 2}", k) for k in range(9)]
    assert reasons(records(spark, rows), 4, None) == plain_caps(rows, 4, 10**9)
    assert reasons(records(spark, rows), None, 2) == plain_caps(rows, 10**9, 2)
    assert reasons(records(spark, rows).limit(0), 1, 1) == {}


def test_export_order_and_limit(spark):
    df = spark.createDataFrame([("b", "train", 0.9), ("a", "train", 0.9), ("c", "test", 0.1), ("d", "train", 1.0)], "source_id string, split string, quality_score double")
    assert [r["source_id"] for r in corpus.export_order(df).collect()] == ["c", "d", "a", "b"]
    assert [r["source_id"] for r in corpus.export_order(df, 2).collect()] == ["c", "d"]


def plain_states(runs):
    out = {}
    for skill in {r[0] for r in runs}:
        x, mean = 5000, 0.0
        for n, (_, _, _, success, score) in enumerate(sorted((r for r in runs if r[0] == skill), key=lambda r: (r[1], r[2])), 1):
            x = min(9900, max(500, x + round(((0.04 if success else -0.06) + ((score - 0.5) * 0.08 if score is not None else 0)) * 10000)))
            seen = score if score is not None and score > 0 else 1.0 if success else 0.0
            mean = seen * 10000 if n == 1 else float(math.floor((mean * (n - 1) + seen * 10000) / n + 0.5))
        out[skill] = (x / 10000, mean / 10000)
    return out


@pytest.mark.parametrize("rows_a_fold", [3, 4096])
def test_folds_equal_a_loop(spark, monkeypatch, rows_a_fold):
    monkeypatch.setattr(corpus, "FOLD_ROWS", rows_a_fold)
    pick = random.Random(8)
    runs = [(pick.choice(["hot"] * 8 + ["b", "c"]), k // 3, k, pick.random() < 0.7, pick.choice([None, 0.0, round(pick.random(), 3), round(pick.random() / 5, 5)])) for k in range(900)] + [("one", 1, 1, False, 0.333)]
    df = spark.createDataFrame(runs, "skill_id string, at long, run_id long, success boolean, score double").repartition(6)
    states = corpus.skill_states(df)
    found = {r["skill_id"]: (r["confidence"], r["average_quality_score"]) for r in states.collect()}
    assert found == plain_states(runs)
    assert "Python" not in states._jdf.queryExecution().executedPlan().toString()


def test_the_mean_stands_still_after_enough_runs(spark):
    """What the first MEAN_RUNS runs leave cannot be moved any more."""
    runs = spark.range(corpus.MEAN_RUNS + 5_000).select(F.lit("s").alias("skill_id"), F.col("id").alias("place"), F.when(F.col("id") < 15_000, 0.25).otherwise(1.0).alias("observed"))
    mean = 0.25 * 10000
    for n in range(2, corpus.MEAN_RUNS + 5_001):
        mean = math.floor((mean * (n - 1) + (0.25 if n <= 15_000 else 1.0) * 10000) / n + 0.5)
    assert corpus.running_quality(runs).first()["average_quality_score"] == mean / 10000


def test_connected_groups(spark, rows):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20) if i != 7], "a string, b string")
    assert rows(graph.components(links, "a", "b")) == [(f"n{i:02d}", "n00" if i < 8 else "n08") for i in range(21)]
