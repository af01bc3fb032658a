"""Threshold lists against scoring every record for every question."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import retrieval

NOW = dt.datetime(2024, 3, 1)
RECORD = ("record_id string, created_at timestamp, intent string, signature string, dataset_signature string, roles array<string>, structure string, tools array<string>, quality double, support int, state string, "
          "requested_role string, preferred string, template_id string, success boolean, score double, failure_reason string")  # fmt: skip
QUESTION = "question_id long, intent string, signature string, dataset_signature string, roles array<string>, structure string, tools array<string>"


def plain_score(kind, r, q):
    same = lambda f, w: w if r[f] is not None and r[f] == q[f] else 0.0
    shared = lambda f, most: min(most, 0.12 * len(set(r[f] or []) & set(q[f] or [])))
    among = lambda f, of, w: w if r[f] is not None and r[f] in (q[of] or []) else 0.0
    if kind == "experience":
        days = (NOW - r["created_at"]).total_seconds() / 86400
        return (same("intent", 0.25) + same("signature", 0.35) + same("dataset_signature", 0.12) + shared("roles", 0.18) + same("structure", 0.08) + shared("tools", 0.12) + 0.06 * (r["template_id"] is not None)
                + 0.08 * bool(r["success"]) + max(0, min(0.08, r["score"] * 0.08)) + max(0, 0.08 - min(0.08, days / 365 * 0.08)) - 0.05 * (r["failure_reason"] is not None))
    if kind == "template":
        return (same("intent", 0.3) + same("structure", 0.16) + shared("roles", 0.2) + shared("tools", 0.14) + min(0.08, r["quality"] * 0.08) + min(0.08, r["support"] * 0.02)
                + 0.08 * (r["state"] in ("validated", "trusted")) + 0.05 * (r["state"] == "trusted"))
    if kind == "lesson":
        return same("intent", 0.25) + same("structure", 0.15) + shared("roles", 0.18) + shared("tools", 0.12) + same("signature", 0.2) + min(0.08, r["quality"] * 0.05)
    if kind == "strategy":
        return same("intent", 0.25) + same("signature", 0.35) + shared("roles", 0.18) + shared("tools", 0.14) + min(0.1, r["quality"] * 0.1) + min(0.05, r["support"] * 0.01) + 0.05 * (r["state"] == "promoted")
    return same("intent", 0.28) + same("dataset_signature", 0.18) + among("requested_role", "roles", 0.2) + among("preferred", "tools", 0.08)


def made(pick, n, m):
    some = lambda values, most: None if pick.random() < 0.05 else [pick.choice(values) for _ in range(pick.randrange(most))]
    features = lambda: {
        "intent": pick.choice(["a", "a", "b", None]), "signature": pick.choice(["x", "y", "z"]), "dataset_signature": pick.choice(["d", None]), "roles": some(["r1", "r2", "r3"], 5),
        "structure": pick.choice(["AND", "OR"]), "tools": some(["t1", "t2"], 4),
    }
    records = [{
        "record_id": f"r{i:03d}", "created_at": NOW - dt.timedelta(days=pick.choice([0, 1, 30, 500])), **features(), "quality": pick.choice([0.0, 0.5, 1.0, 3.0]), "support": pick.randrange(9),
        "state": pick.choice(["observed", "validated", "trusted", "promoted"]), "requested_role": pick.choice(["r1", "r9", None]), "preferred": pick.choice(["t1", None]),
        "template_id": pick.choice(["t", None]), "success": pick.random() < 0.5, "score": pick.choice([-1.0, 0.1, 0.5, 1.0, 2.0]), "failure_reason": pick.choice(["f", None, None]),
    } for i in range(n)]
    return records, [{"question_id": i, **features()} for i in range(m)]


@pytest.mark.parametrize("top", [1, 4])
@pytest.mark.parametrize("kind", list(retrieval.RECORD_KINDS))
def test_best_records_by_brute_force(spark, kind, top):
    records, asked = made(random.Random(f"{kind}{top}"), 150, 25)
    table = spark.createDataFrame([tuple(r.values()) for r in records], RECORD).repartition(4)
    found = {}
    for r in retrieval.retrieve(spark.createDataFrame([tuple(q.values()) for q in asked], QUESTION), table, kind, NOW, top=top).orderBy("question_id", "place").collect():
        found.setdefault(r["question_id"], []).append((r["record_id"], r["score"], r["place"]))
    least = retrieval.RECORD_KINDS[kind].least
    for q in asked:
        scored = [(round(min(plain_score(kind, r, q), 0.99) + 1e-9, 4), r) for r in records if plain_score(kind, r, q) > least + 1e-9]
        scored.sort(key=lambda x: (-x[0], -x[1]["created_at"].timestamp(), x[1]["record_id"]))
        assert found.get(q["question_id"], []) == [(r["record_id"], s, i) for i, (s, r) in enumerate(scored[:top], 1)]


def test_what_is_scored_does_not_grow_with_the_records(spark, monkeypatch):
    """All records share one intent and structure; few pairs are scored."""
    seen = []
    value = retrieval.Same.value
    monkeypatch.setattr(retrieval.Same, "value", lambda self: seen.append(self.name) or value(self))
    best = retrieval.ranked
    sizes = []
    monkeypatch.setattr(retrieval, "ranked", lambda df, order, keys, n: sizes.append(df.count()) or best(df, order, keys, n))
    for rows in (400, 4000):
        table = spark.range(rows).select(
            F.format_string("r%06d", "id").alias("record_id"), F.lit(NOW).alias("created_at"), F.lit("a").alias("intent"), F.col("id").cast("string").alias("signature"),
            F.array(F.lit("r1")).alias("roles"), F.array(F.lit("t1")).alias("tools"), (F.col("id") / 10000).alias("quality"), F.lit(1).alias("support"), F.lit("x").alias("state"))
        asked = spark.createDataFrame([(i, "a", str(i), None, ["r1"], "AND", ["t1"]) for i in range(10)], QUESTION)
        assert retrieval.retrieve(asked, table, "strategy", NOW).count() == 50
    # What is scored at last: at most ten records for each of ten questions.
    assert sizes[2] <= 200 and sizes[5] <= 200 and seen


def test_no_records_no_questions_and_too_many_skills(spark, monkeypatch):
    records, asked = made(random.Random(1), 3, 2)
    table, questions = spark.createDataFrame([tuple(r.values()) for r in records], RECORD), spark.createDataFrame([tuple(q.values()) for q in asked], QUESTION)
    assert retrieval.retrieve(questions, table.limit(0), "lesson", NOW).count() == 0 and retrieval.retrieve(questions.limit(0), table, "lesson", NOW).count() == 0
    skills = spark.createDataFrame([(f"filter.{i}", ["r1"], "t", ["h"], "", 0.9) for i in range(4)], "id string, roles array<string>, tool string, hints array<string>, description string, confidence double")
    asked = spark.createDataFrame([(1, "filter", ["r1"], [""], ["h"], "AND", 2, 0, 0)], "question_id long, intent string, roles array<string>, tool_hints array<string>, operation_hints array<string>, structure string, predicates int, booleans int, comparisons int")
    found = [tuple(r) for r in retrieval.retrieve_skills(asked, skills, top=2).collect()]
    assert found == [(1, "filter.0", 0.7, 1), (1, "filter.1", 0.7, 2)]
    monkeypatch.setattr(retrieval, "MOST_SKILLS", 3)
    with pytest.raises(ValueError):
        retrieval.retrieve_skills(asked, skills)
