"""Roles, keys, text functions, query log, reuse and corpora."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import names, text
from tablewright.operators import corpus, matching, querylog, roles
from tablewright.sources import catalog, readers, writers
from tablewright.streaming import event_log


# ---- roles and keys ----------------------------------------------------------


def test_value_overlap(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k long")
    assert roles.value_overlap(ids(1, 2, 3), "k", ids(1, 2, 3, 4, 5), "k").first().overlap == 1.0
    assert roles.value_overlap(ids(1, 2, 3), "k", ids(1, 2, 99), "k").first().overlap == pytest.approx(0.6667, abs=1e-4)


def test_relationships(spark, rows):
    orders = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 10)], "OrderID long, CustomerID long")
    customers = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c"), (40, "d")], "CustomerID long, Name string")
    links = roles.relationships({"orders": orders, "customers": customers})
    assert rows(links) == [("orders", "CustomerID", "customers", "CustomerID", 1.0)]
    upgraded = roles.upgrade_foreign_keys(roles.column_roles(orders, "orders"), links)
    assert {r.column: r.role for r in upgraded.collect()} == {"OrderID": "primary_key", "CustomerID": "foreign_key"}


def test_column_roles(spark):
    data = [(i, f"u{i}@x.org", f"+1 555 000{i:04d}", "2024-01-0%d" % (i % 5 + 1), 9.5 * i, i / 10, "AB"[i % 2]) for i in range(1, 9)]
    df = spark.createDataFrame(data, "user_id long, mail string, phone string, created_on string, total_price double, discount double, grade string")
    found = {r.column: (r.role, r.confidence) for r in roles.column_roles(df, "d").collect()}
    assert found["user_id"] == ("primary_key", 1.0) and found["mail"] == ("email", 1.0) and found["phone"] == ("phone", 1.0)
    assert found["created_on"] == ("date", 1.0) and found["total_price"] == ("currency", 0.85) and found["discount"] == ("percentage", 1.0)
    assert found["grade"] == ("category", 0.75)


def test_duplicate_columns(spark, rows):
    df = spark.range(100).select(F.col("id").alias("a"), F.col("id").cast("string").alias("b"), F.when(F.col("id") != 5, F.col("id")).alias("c"), (F.col("id") * 2).alias("d"))
    assert rows(roles.duplicate_columns(df)) == [("a", "b", 1.0), ("a", "c", 0.99), ("b", "c", 0.99)]


def test_semantic_roles_and_aliases(spark):
    data = [("Aroma", "Kolkata", 4.3, "Yes", "No"), ("Spice", "Kolkata", 4.8, "No", "Yes"), ("Dosa", "Delhi", 3.9, "Yes", "Yes")]
    df = spark.createDataFrame(data, "RestaurantName string, Area string, Rating double, OnlineTableBooking string, OnlineDelivery string")
    found = {r.column: (r.column_id, r.role) for r in roles.semantic_roles(df).collect()}
    assert found["RestaurantName"] == ("c1", "restaurant_entity") and found["Area"] == ("c2", "geographic_area") and found["Rating"] == ("c3", "rating_metric")
    assert found["OnlineDelivery"][1] == "delivery_capability" and found["OnlineTableBooking"][1] == "table_booking_capability"
    hidden, back = names.anonymise_columns(df, "c", 0)
    assert hidden.columns == ["c1", "c2", "c3", "c4", "c5"]
    assert names.restore_names({"group_by": ["c2"], "filters": [{"column": "c3"}]}, back) == {"group_by": ["Area"], "filters": [{"column": "Rating"}]}


def test_schema_fingerprint_ignores_order_and_case(spark):
    a, b = spark.createDataFrame([(1, "x")], "A int, b string"), spark.createDataFrame([("x", 1)], "B string, a int")
    assert names.schema_fingerprint(a) == names.schema_fingerprint(b)


# ---- text --------------------------------------------------------------------


def test_masks(spark):
    c = F.col("v")
    df = spark.createDataFrame([("mail é.bob@x.org or call +1 (499) 555-6503 see https://a.b/c and www.q.com x12345678901y",)], "v string")
    assert df.select(text.masked(c)).first()[0] == "mail é<EMAIL> or call <PHONE> see <URL> and <URL> x12345678901y"
    assert df.select(text.renamed(c, {"call": "C1", "call +1": "C2"})).first()[0].startswith("mail é.bob@x.org or C2 (499)")


def test_similarity_equals_the_plain_rule(spark):
    pairs = [("Show total sales by region", "show the total sales by region!"), ("a b", ""), ("Same, text", "same text"), ("x y z", "p q r")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.comparable(F.col("a")).alias("na"), text.comparable(F.col("b")).alias("nb"))
    for r in df.select("na", "nb", text.similarity(F.col("na"), F.col("nb")).alias("s")).collect():
        wa, wb = set(r.na.split()), set(r.nb.split())
        plain = 0.0 if not r.na or not r.nb else 1.0 if r.na == r.nb else round(
            0.5 * difflib.SequenceMatcher(None, r.na, r.nb).ratio() + 0.5 * len(wa & wb) / len(wa | wb), 4)
        assert r.s == pytest.approx(plain, abs=1e-9)


def test_similar_questions_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    past = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 25))) for _ in range(80)]
    # A third of the log is one text with one changing word.
    past += [" ".join(["same", "question", "asked", "over", "and", "again", "about", "the", "sales", "of", "item", str(i)]) for i in range(40)]
    asked = [p + " now" if i % 2 else p.replace(" ", "  ").upper() for i, p in enumerate(past)]
    log = spark.createDataFrame([(i, p, i % 3 - 1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i, p in enumerate(past)],
                                "id long, user_query string, feedback_score int, created_at timestamp")
    probes = spark.createDataFrame(list(enumerate(asked)), "p long, user_query string")
    found = {r.probe_id: (round(r.score, 4), r.matched_id) for r in matching.similar_questions(probes, log, "p", 0.9).collect()}
    for p, question in enumerate(asked):
        a = " ".join(question.lower().split())
        best = None
        for i, b in enumerate(past):
            wa, wb = set(a.split()), set(b.split())
            s = 1.0 if a == b else round(0.5 * difflib.SequenceMatcher(None, a, b).ratio() + 0.5 * len(wa & wb) / len(wa | wb), 4)
            if s >= 0.9 and (best is None or (s, i % 3 - 1, i) > best):
                best = (s, i % 3 - 1, i)
        # A score on the edge of the fourth decimal may round either way.
        score, matched = found.get(p, (None, None))
        assert matched == (best[2] if best else None) and (best is None or abs(score - best[0]) < 1.01e-4), (question, best)


def test_question_tags(spark):
    asked = {"Add column margin": "operation", "clean nulls": "cleaning", "average price by region": "analytics", "show average price": "filter",
             "sentiment of reviews": "sentiment", "hello": "unknown"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.i for r in df.select("q", text.intent(F.col("q")).alias("i")).collect()} == asked
    one = spark.createDataFrame([('Show rows where "Price" is above 30 and stock at least 5',)], "q string").select(text.question_features(F.col("q")).alias("f")).first().f
    assert one.logical_structure == "AND" and one.operators == ["greater_than_equal", "greater_than", "equals"] and one.comparison_count == 2


def test_json_shape(spark):
    doc = '{"a": "x, \\"y\\": 1", "b": [1, 2.5, true, null], "c": {"d": -3}}'
    shape = spark.createDataFrame([(doc,)], "v string").select(text.json_shape(F.col("v"))).first()[0].replace(" ", "")
    assert shape == '{"a":"str","b":["int","float","bool","null"],"c":{"d":"int"}}'
    others = spark.createDataFrame([(i, d) for i, d in enumerate(['{"a":1e5,"b":-2.5E-3}', "17", '"x"', "[]", "no json"])], "i int, v string")
    assert [r.s for r in others.orderBy("i").select(text.json_shape(F.col("v")).alias("s")).collect()] == ['{"a":"float","b":"float"}', '"int"', '"str"', "[]", None]


# ---- query log and reuse -----------------------------------------------------

NOW = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def log(spark):
    at = lambda days: NOW - dt.timedelta(days=days)
    data = [
        (1, "d1", "o1", "total by region", "analytics", "SELECT 1", True, None, "v1", at(1)),
        (2, "d2", None, "rows above 5", "filter", "SELECT 2", True, -1, "v1", at(2)),
        (3, "d1", "o1", "old question", "cleaning", "SELECT 3", True, None, "v1", at(45)),
        (4, "d1", "o1", "failed question", "filter", None, False, None, "v1", at(1)),
        (5, "d3", "o2", "bad plan", "operation", "SELECT 5", True, 1, "v2", at(3)),
        (6, "d3", "o2", "fresh plan", "operation", "SELECT 6", True, 1, "v2", at(1)),
    ]
    schema = ("id long, dataset_id string, organization_id string, user_query string, intent string, generated_sql string, success boolean, "
              "feedback_score int, planner_version string, created_at timestamp")  # fmt: skip
    return spark.createDataFrame(data, schema).withColumn("schema_hash", F.lit("x"))


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame([("d1", "o1", "s1", "csv"), ("d2", "o1", "s1", "json"), ("d3", "o2", "s3", "csv"), ("d4", "o1", "s1", "csv")],
                                 "dataset_id string, organization_id string, schema_hash string, source_type string")


RULES = "query_history_id long, schema_hash string, intent string, planner_version string, invalidated_at timestamp"


def test_reuse_outcomes(spark, log, sets):
    rules = spark.createDataFrame([(None, "s3", None, None, NOW - dt.timedelta(days=2))], RULES)
    asked = [("same", "d1", "total by region", None, None), ("shape", "d4", "total by region", None, None), ("intent", "d1", "other words", "analytics", "v1"),
             ("version", "d1", "other words", "analytics", "v9"), ("old", "d1", "old question", None, None), ("failed", "d1", "failed question", None, None),
             ("disliked", "d2", "rows above 5", None, None), ("invalid", "d3", "bad plan", None, None), ("fresh", "d3", "fresh plan", None, None), ("nowhere", "dX", "total by region", None, None)]
    probes = spark.createDataFrame(asked, "probe_id string, dataset_id string, user_query string, intent string, planner_version string")
    found = {r.probe_id: (r.outcome, r.matched_on) for r in querylog.plan_reuse(probes, log, sets, rules, NOW).collect()}
    assert found == {
        "same": ("hit", "same_dataset"), "shape": ("hit", "same_schema_shape"), "intent": ("hit", "same_intent"), "version": ("miss", None), "old": ("expired", None),
        "failed": ("miss", None), "disliked": ("miss", None), "invalid": ("invalidated", None), "fresh": ("hit", "same_dataset"), "nowhere": ("miss", None),
    }


def test_exports(log, sets, spark, tmp_path):
    table = querylog.training_table(log, sets) if "python_pipeline" in log.columns else querylog.training_table(
        log.withColumns({"python_pipeline": F.lit('{"a":1}'), "execution_time_ms": F.lit(1.5)}), sets)
    assert table.columns == ["intent", "question", "sql", "pipeline", "execution_time_ms", "feedback", "dataset_type"] and table.count() == 6
    writers.write_parquet(table, f"{tmp_path}/p")
    writers.write_csv(table, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/p").columns == spark.read.option("header", True).csv(f"{tmp_path}/c").columns
    assert querylog.scoped_log(log, sets, "o1", limit=2).count() == 2


def test_latency_nearest_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 21)], "execution_time_ms double")
    assert tuple(querylog.latency_summary(df).first()) == (20, 10.5, 19.0)


def test_run_quality(spark):
    columns = ["plan_completeness", "result_validation", "semantic_binding", "critic_score", "execution_score", "output_contract", "repair_penalty", "fallback_penalty", "ambiguity_penalty"]
    df = spark.createDataFrame([(True, 10, 3, 1), (False, 10, 3, 1), (True, None, None, None)], "success boolean, row_count int, column_count int, feedback_score int")
    df = df.withColumns({c: F.lit(None).cast("double") for c in columns})
    assert [r[0] for r in df.select(querylog.run_quality()).collect()] == [0.985, 0.0, 0.67]


def _plain_score(kind, r, q):
    same = lambda f, w: w if r.get(f) is not None and r.get(f) == q.get(f) else 0.0
    shared = lambda f, most: min(most, 0.12 * len(set(r[f]) & set(q[f])))
    if kind == "template":
        s = same("intent", 0.3) + same("structure", 0.16) + shared("roles", 0.2) + shared("tools", 0.14) + min(0.08, r["quality"] * 0.08) + min(0.08, r["support"] * 0.02)
        return s + (0.08 if r["state"] in ("validated", "trusted") else 0) + (0.05 if r["state"] == "trusted" else 0)
    if kind == "lesson":
        return same("intent", 0.25) + same("structure", 0.15) + shared("roles", 0.18) + shared("tools", 0.12) + same("signature", 0.2) + min(0.08, r["quality"] * 0.05)
    if kind == "strategy":
        s = same("intent", 0.25) + same("signature", 0.35) + shared("roles", 0.18) + shared("tools", 0.14) + min(0.1, r["quality"] * 0.1) + min(0.05, r["support"] * 0.01)
        return s + (0.05 if r["state"] == "promoted" else 0)
    s = same("intent", 0.28) + same("dataset_signature", 0.18)
    return s + (0.2 if r["requested_role"] in q["roles"] else 0) + (0.08 if r["preferred"] in q["tools"] else 0)


@pytest.mark.parametrize("kind", ["template", "lesson", "strategy", "correction"])
def test_retrieval_equals_brute_force(spark, kind):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    record = lambda i: {
        "record_id": f"r{i:03d}", "created_at": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "intent": pick("a", "a", "b"), "signature": pick("x", "y"),
        "dataset_signature": pick("d", "e"), "roles": [pick("r1", "r2", "r3")], "structure": pick("AND", "OR"), "tools": [pick("t1", "t2")], "quality": round(rng.random(), 2),
        "support": rng.randint(1, 9), "state": pick("observed", "validated", "trusted", "promoted"), "requested_role": pick("r1", "r9"), "preferred": pick("t1", "t9"),
    }
    records = [record(i) for i in range(200)]
    asked = [{"question_id": i, "intent": pick("a", "b"), "signature": pick("x", "z"), "dataset_signature": pick("d", "f"), "roles": ["r1", pick("r2", "r5")],
              "structure": pick("AND", "OR"), "tools": [pick("t1", "t2")]} for i in range(30)]
    schema = ("record_id string, created_at timestamp, intent string, signature string, dataset_signature string, roles array<string>, structure string, tools array<string>, "
              "quality double, support int, state string, requested_role string, preferred string")  # fmt: skip
    table = spark.createDataFrame([tuple(r.values()) for r in records], schema)
    questions = spark.createDataFrame([tuple(q.values()) for q in asked], "question_id long, intent string, signature string, dataset_signature string, roles array<string>, structure string, tools array<string>")
    found = {}
    for r in querylog.retrieve(questions, table, kind, NOW).orderBy("question_id", "place").collect():
        found.setdefault(r.question_id, []).append(round(r.score, 4))
    for q in asked:
        plain = sorted((min(0.99, _plain_score(kind, r, q)) for r in records if r["intent"] == q["intent"]), reverse=True)[:5]
        assert found[q["question_id"]] == pytest.approx(plain, abs=1.01e-4)


# ---- corpus ------------------------------------------------------------------

GOOD = {"event_id": "e1", "intent": "filter", "semantic_roles": ["boolean", "numeric_measure"], "operators": ["equals"], "logical_structure": "AND",
        "tool_sequence": ["sql.filter", "sql.validate"], "score": 0.97, "success": True, "critic_passed": True, "result_validation_passed": True,
        "plan_completeness_passed": True, "privacy_validation_passed": True, "no_unresolved_ambiguity": True, "no_critical_repair": True, "repair_count": 0,
        "plan_source": "teacher_execution", "plan_template_id": None, "dataset_semantic_signature": "a" * 16, "plan_summary": '{"filters":[{"column":"x"}]}',
        "created_at": "2024-01-01T00:00:00+00:00"}
EVENT = ("event_id string, intent string, semantic_roles array<string>, operators array<string>, logical_structure string, tool_sequence array<string>, score double, "
         "success boolean, critic_passed boolean, result_validation_passed boolean, plan_completeness_passed boolean, privacy_validation_passed boolean, "
         "no_unresolved_ambiguity boolean, no_critical_repair boolean, repair_count int, plan_source string, plan_template_id string, dataset_semantic_signature string, "
         "plan_summary string, created_at string")  # fmt: skip


def events(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.values()) for c in changes], EVENT)


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"logical_structure": "XOR"}, "invalid_logical_structure"), ({"score": None}, "missing_quality"), ({"intent": "John Smith"}, "unsafe_intent"),
    ({"semantic_roles": ["ok", "john@example.com"]}, "unsafe_semantic_role"), ({"operators": ["A"]}, "unsafe_operator"), ({"tool_sequence": ["x y"]}, "unsafe_tool_graph"),
    ({"plan_source": "Secret"}, "unsafe_plan_source"), ({"dataset_semantic_signature": "zz"}, "unsafe_dataset_signature"), ({"success": None}, "execution_failed"),
    ({"critic_passed": False}, "critic_failed"), ({"privacy_validation_passed": None}, "privacy_failed"), ({"repair_count": 1}, "repaired_example_rejected"),
    ({"score": 0.94}, "quality_below_threshold"), ({"success": False, "score": 0.1}, "execution_failed"),
])
def test_gates(spark, change, reason):
    assert events(spark, change).select(corpus.event_reason()).first()[0] == reason


def test_split_is_stable_under_shuffling(spark, rows):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("f"))
    split = lambda d: d.select("f", corpus.stable_split(F.col("f")).alias("s"))
    assert rows(split(df)) == rows(split(df.repartition(7)))
    shares = {r.s: r["count"] for r in split(df).groupBy("s").count().collect()}
    assert shares["train"] > 350 and set(shares) == {"train", "validation", "test"}


@pytest.mark.parametrize("seed,per_intent,per_tools", [(1, 5, 7), (2, 20, 3), (3, 1, 1), (4, 12, 12)])
def test_caps_equal_the_sequential_rule(spark, seed, per_intent, per_tools):
    rng = random.Random(seed)
    data = []
    for i in range(300):
        intent = "hot" if rng.random() < 0.35 else f"i{rng.randint(0, 6)}"
        data.append((f"s{i:03d}", intent, [f"t{rng.randint(0, 5)}"], round(0.95 + rng.randint(0, 4) / 100, 2), f"2024-01-{rng.randint(1, 28):02d}"))
    df = spark.createDataFrame(data, "source_id string, intent string, tool_sequence array<string>, quality_score double, created_at string")
    found = {r.source_id: r.cap_reason for r in corpus.capped(df, per_intent, per_tools).collect()}
    intents, tools, plain = {}, {}, {}
    for s, intent, (tool,), *_ in sorted(data, key=lambda d: (d[3], d[4], d[0]), reverse=True):
        if intents.get(intent, 0) >= per_intent:
            plain[s] = "intent_cap"
        elif tools.get(tool, 0) >= per_tools:
            plain[s] = "tool_graph_cap"
        else:
            plain[s] = None
            intents[intent], tools[tool] = intents.get(intent, 0) + 1, tools.get(tool, 0) + 1
    assert found == plain


def test_corpus_build(spark, rows):
    data = events(spark, {"event_id": "a", "score": 0.96}, {"event_id": "b", "score": 0.98}, {"event_id": "c", "intent": "sort"}, {"event_id": "d", "success": False},
                  {"event_id": "e", "intent": "rank"})
    gone = spark.createDataFrame([("e", None)], "source_id string, family_fingerprint string")
    built, rejected = corpus.build_corpus(corpus.event_records(data), gone)
    assert rows(built, "source_id", "family_size") == [("b", 2), ("c", 1)]
    assert rows(rejected) == [("duplicate_family", 1), ("execution_failed", 1), ("invalidated", 1)]
    again, _ = corpus.build_corpus(corpus.event_records(data.repartition(5)), gone)
    assert rows(again, "source_id", "split") == rows(built, "source_id", "split")
    summary = corpus.corpus_summary(built).first()
    assert (summary.eligible_examples, summary.family_count, summary.intent_count) == (2, 2, 2)
    assert not corpus.readiness(corpus.corpus_summary(built)).first().ready


def test_strategies_in_a_corpus(spark):
    rows_ = [("strategy.a", "filter", ["r"], "AND", ["t"], "t1", 0.97, 5, "validated", "validated", "2024"), ("strategy.b", "filter", ["r"], "AND", ["t"], "t1", 0.97, 0, "validated", "validated", "2024"),
             ("strategy.c", "filter", ["r"], "AND", ["t"], "t1", 0.97, 5, "candidate", "observed", "2024")]
    df = spark.createDataFrame(rows_, "strategy_id string, intent string, semantic_roles array<string>, logical_structure string, tool_sequence array<string>, plan_template_id string, "
                               "average_quality double, evidence_count int, state string, lifecycle_state string, created_at string")  # fmt: skip
    found = {r.source_id: r.rejected for r in corpus.strategy_records(df).collect()}
    assert found == {"strategy.a": None, "strategy.b": "strategy_has_no_evidence", "strategy.c": "strategy_lifecycle_not_trusted"}


def test_skill_fold_equals_the_loop(spark):
    rng = random.Random(9)
    runs = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}", i, rng.random() < 0.6, round(rng.random(), 4)) for i in range(2000)]
    df = spark.createDataFrame([(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, ok, v) for s, i, ok, v in runs], "skill_id string, at timestamp, run_id long, success boolean, score double")
    state = {}
    for skill, _, ok, score in runs:
        c = state.get(skill, 0.5) + (0.04 if ok else -0.06) + (score - 0.5) * 0.08
        state[skill] = round(min(0.99, max(0.05, c)), 4)
    assert {r.skill_id: r.confidence for r in corpus.skill_states(df).collect()} == pytest.approx(state, abs=1e-9)


def test_status_blockers(spark):
    strategies = spark.createDataFrame([("strategy.x", "filter", "observed", "candidate", 3, 0.8)], "strategy_id string, intent string, lifecycle_state string, state string, evidence_count int, average_quality double")
    states = spark.createDataFrame([("learned.x", 2, 4, 0.7, "candidate")], "skill_id string, success_count int, failure_count int, average_quality_score double, state string")
    row = corpus.strategy_status(strategies, states).first()
    assert (row.lifecycle, row.next_stage, row.evidence_count) == ("candidate", "validated", 6)
    assert row.promotion_blockers == ["failure_tolerance_exceeded", "quality_below_0.85"]


def test_leaks_and_corpus_check(spark, rows):
    df = spark.createDataFrame([("train", "fine"), ("train", "by JOHN SMITH"), ("test", "x")], "split string, line string")
    assert rows(corpus.check_corpus(df, {"train": 2, "validation": 1, "test": 1}), "split", "blocker") == [("test", None), ("train", "privacy_violation:train"), ("validation", "split_count_mismatch")]


def test_unsafe_fields(spark):
    df = spark.createDataFrame([("ok.token", ["a", "B C"])], "a string, b array<string>")
    assert df.select(corpus.unsafe_field({f.name: f.dataType for f in df.schema})).first()[0] == "unsafe_string:record.b"


# ---- sources and sinks ---------------------------------------------------------


def test_readers(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("name,v,name\n x ,1,\n,2,y\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("a\tb\n1\t​\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]', encoding="utf-8")
    csv = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert csv.count() == 2 and csv.filter(F.col(csv.columns[0]).isNull()).count() == 1
    assert rows(readers.read_table(spark, str(tmp_path / "b.tsv"))) == [(1, None)]
    assert rows(readers.read_table(spark, str(tmp_path / "c.json"))) == [(1,), (2,)]


def test_event_log_skips_bad_lines(spark, tmp_path, rows):
    lines = ['{"event_id": "a", "created_at": "2024-01-01"}', "not json", "[1]", '{"event_id": "a", "created_at": "2024-01-01"}', '{"event_id": "b", "created_at": "2024-01-02"}', "", '{"event_id": ']
    (tmp_path / "log.jsonl").write_text("\n".join(lines), encoding="utf-8")
    schema = "event_id string, created_at string"
    assert rows(readers.read_event_log(spark, str(tmp_path / "log.jsonl"), schema, key="event_id")) == [("a", "2024-01-01"), ("b", "2024-01-02")]
    assert rows(readers.read_event_log(spark, str(tmp_path / "log.jsonl"), schema, newest=1)) == [("b", "2024-01-02")]


def test_jsonl_and_manifest(spark, tmp_path, rows):
    df = spark.createDataFrame([("train", "a", 1.0), ("validation", "b", float("nan")), ("test", "c", None)], "split string, t string, v double")
    path = f"{tmp_path}/corpus"
    writers.write_jsonl(df, path)
    lines = readers.read_splits(spark, path)
    assert rows(lines) == [('{"t":"a","v":1.0}', "train"), ('{"t":"b","v":null}', "validation")]
    with pytest.raises(ValueError):
        readers.read_splits(spark, path, ("test",))
    manifest = spark.createDataFrame(writers.create_manifest(spark, path).collect())
    assert writers.verify_manifest(spark, path, manifest).count() == 0
    other = manifest.filter(~F.col("path").contains("test")).withColumn("sha256", F.when(F.col("path").contains("train"), "0").otherwise(F.col("sha256")))
    other = other.unionByName(spark.createDataFrame([("split=test/lost.txt", "1", 1)], "path string, sha256 string, bytes long"))
    problems = [r.problem for r in writers.verify_manifest(spark, path, other).orderBy("path").collect()]
    assert sorted(problems) == ["changed", "missing", "unexpected"]


def test_ingest_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "customers.csv").write_text("customer_id,name\n10,a\n20,b\n30,c\n", encoding="utf-8")
    (folder / "orders.csv").write_text("order_id,customer_id\n1,10\n2,20\n3,10\n", encoding="utf-8")
    empty = spark.createDataFrame([], catalog.DATASET)
    added, columns, found, links = catalog.ingest(spark, str(folder), empty, "o1")
    assert added.count() == 2 and columns.count() == 4 and links.count() == 1
    assert found.filter("role = 'foreign_key'").first().column == "customer_id"
    again = catalog.ingest(spark, str(folder), spark.createDataFrame(added.collect(), added.schema), "o1")
    assert again[0].count() == 0
    assert catalog.ingest(spark, str(folder), spark.createDataFrame(added.collect(), added.schema), "o2")[0].count() == 2


def test_event_stream(spark, tmp_path, rows):
    source, out, state = tmp_path / "src", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    schema = "event_id string, created_at timestamp"
    for part, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        (source / f"{part}.jsonl").write_text("\n".join(f'{{"event_id": "{i}", "created_at": "2024-01-01T00:00:0{part}"}}' for i in ids) + "\nbroken", encoding="utf-8")
        event_log.append_to_log(event_log.event_stream(spark, str(source), schema), str(out), str(state)).awaitTermination()
    assert rows(spark.read.parquet(str(out)), "event_id") == [("a",), ("b",), ("c",)]
