"""Equal columns, keys across tables and twins against plain versions."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tablewright.operators import bitfilter, profile, relations


def plain_pairs(rows, columns, minimum):
    text = [[None if v is None else str(v) for v in row] for row in rows]
    out = []
    for a, b in combinations(range(len(columns)), 2):
        share = sum(r[a] == r[b] for r in text) / len(text)
        if share >= minimum:
            out.append((columns[a], columns[b], round(share + 1e-12, 4)))
    return sorted(out)


@pytest.mark.parametrize("size, minimum", [(10, 0.85), (10, 0.98), (1, 1.0), (300, 0.98), (300, 0.2), (4000, 0.98), (4000, 0.9)])
def test_equal_columns_by_brute_force(spark, rows, size, minimum):
    pick = random.Random(size)
    columns = [f"c{i}" for i in range(24)]
    base = [[pick.randrange(3 + i * i) for i in range(6)] for _ in range(size)]
    noise = [0.0, 0.005, 0.015, 0.03, 0.09, 0.5]
    table = [[None if pick.random() < 0.01 and c > 20 else row[c % 6] if pick.random() >= noise[c // 4] else "other" for c in range(24)] for row in base]
    df = spark.createDataFrame([[None if v is None else str(v) for v in row] for row in table], ", ".join(f"{c} string" for c in columns)).repartition(3)
    assert rows(relations.duplicate_columns(df, minimum)) == plain_pairs(table, columns, minimum)


def test_equal_columns_of_a_wide_table(spark, monkeypatch):
    """1,000 columns are 499,500 pairs; only a few of them are ever counted."""
    passes = []
    counted = relations._counted
    monkeypatch.setattr(relations, "_counted", lambda df, pairs, *rest, **more: passes.append(len(pairs)) or counted(df, pairs, *rest, **more))
    key = F.col("id")
    values = [F.when(key % 1000 != i, key * (i // 2 + 1) % 10007).alias(f"c{i}") if i % 2 else (key * (i // 2 + 1) % 10007).alias(f"c{i}") for i in range(998)]
    df = spark.range(3000).select(*values, key.alias("same"), key.cast("string").alias("text"))
    found = {(r["column_a"], r["column_b"]) for r in relations.duplicate_columns(df).collect()}
    # Modulo a prime the columns of different factors fall apart.
    assert found >= {(f"c{i}", f"c{i + 1}") for i in range(0, 998, 2)} | {("same", "text"), ("c0", "same"), ("c0", "text"), ("c1", "same"), ("c1", "text")}
    assert len(found) < 700 and max(passes) < 2000


def test_columns_without_rows_or_neighbours(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert relations.duplicate_columns(empty).count() == 0
    assert relations.duplicate_columns(spark.range(3)).count() == 0


def plain_links(tables, candidates, minimum):
    sets, out = {}, []
    for t, (columns, rows) in tables.items():
        for i, c in enumerate(columns):
            cells = [str(r[i]) for r in rows if r[i] is not None]
            values, n = set(cells), len(rows)
            sets[t, c] = values, n > 1 and round(len(values) / n * (len(cells) / n) * 0.5, 4) >= 0.45
    for s in candidates:
        for t in sets:
            if s[0] != t[0] and sets[s][0]:
                share = len(sets[s][0] & sets[t][0]) / len(sets[s][0])
                if share >= minimum and (sets[t][1] or s[1].lower() == t[1].lower()):
                    out.append((*s, *t, round(share, 4)))
    return sorted(out)


def random_tables(pick, big):
    people, orders = 3 * big, 9 * big
    ids = list(range(10, 10 + people))
    return {
        "people": (["person_id", "team_id", "note"], [(i, pick.randrange(7), f"n{i}") for i in ids]),
        "teams": (["team_id", "name"], [(i, f"team {i}") for i in range(6)]),
        "orders": (["order_id", "Person_ID", "maybe_id", "none_id"], [(i, pick.choice(ids), pick.choice([None, pick.randrange(people * 2)]), None) for i in range(orders)]),
        "copies": (["person_id"], [(pick.choice(ids[: people // 2]),) for _ in range(big)]),
        "one": (["x", "order_id"], [("a", 5)]),
        "empty": (["a", "person_id"], []),
    }


@pytest.mark.parametrize("sample", [4, 1_024])
@pytest.mark.parametrize("big, broadcast", [(3, 500_000), (400, 0)])
def test_links_by_brute_force(spark, rows, monkeypatch, sample, big, broadcast):
    monkeypatch.setattr(relations, "SAMPLE", sample)
    monkeypatch.setattr(relations, "BROADCAST_VALUES", broadcast)
    plain = random_tables(random.Random(big), big)
    kinds = {"note": "string", "name": "string", "x": "string", "a": "string"}
    tables = {t: spark.createDataFrame(r, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns)) for t, (columns, r) in plain.items()}
    candidates = [(t, c) for t, (columns, _) in plain.items() for i, c in enumerate(columns) if i and c.lower().endswith("_id")]
    for minimum in (0.8, 0.3, 1.0):
        assert rows(relations.relationships(tables, minimum=minimum)) == plain_links(plain, candidates, minimum)


def test_pairs_which_sketches_rule_out_are_not_counted(spark, monkeypatch):
    looked = []
    shared = relations._shared
    monkeypatch.setattr(relations, "_shared", lambda found, pairs: looked.extend((found.keys[s], found.keys[t]) for s, t in pairs) or shared(found, pairs))
    tables = {f"t{i}": spark.range(i * 5000, i * 5000 + 5000).select((F.col("id") * 7919 % 10**9).alias(f"k{i}"), (F.col("id") * 104729 % 10**9).alias("far_id")) for i in range(5)}
    tables["t5"] = tables["t0"].select(F.col("k0").alias("k5"), F.col("k0").alias("near_id"))
    found = {tuple(r)[:4] for r in relations.relationships(tables).collect()}
    assert ("t5", "near_id", "t0", "k0") in found and len(looked) < 8


def test_twins_are_found_without_moving_other_rows(spark, rows):
    df = spark.range(5000).select((F.col("id") % 4990).alias("a"), F.lit("x").alias("b"), F.when(F.col("id") % 2 == 0, "y").alias("c"))
    twins = profile.twin_groups(df)
    assert rows(twins.select("a", "copies")) == [(i, 2) for i in range(10)]
    plan = twins._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert profile.duplicate_counts(df.limit(0)).first() == (0, 0, 0)


def test_bit_filter_never_loses_a_key(spark, monkeypatch):
    keys = spark.range(-500, 500).select(F.xxhash64(F.col("id") - 7).alias("key"))
    for bits in (64, 1 << 16):
        monkeypatch.setattr(bitfilter, "LEAST_BITS", bits)
        monkeypatch.setattr(bitfilter, "MOST_BITS", bits)
        made = bitfilter.BitFilter(keys)
        assert made.passing(keys, F.col("key")).count() == 1000 and made.words.count() <= bits // 64
        marked = made.marked(spark.range(10000).select(F.xxhash64("id").alias("k")), "k", "maybe")
        assert marked.columns == ["k", "maybe"] and (bits == 64 or marked.filter("maybe").count() < 1000)


def test_ratios_and_distinct_counts(spark, rows):
    df = spark.createDataFrame([("1", 1.0, None, "yes"), ("x", 1.0, None, "No "), ("2024-01-05", None, None, "maybe"), ("1", 2.0, None, None)], "a string, b double, c string, d string")
    got = {r["column"]: r for r in profile.ratio_profile(df).collect()}
    assert (got["a"]["numeric_ratio"], got["a"]["datetime_ratio"], got["a"]["distinct"]) == (0.5, 0.25, 3)
    assert (got["b"]["numeric_ratio"], got["b"]["datetime_ratio"], got["b"]["missing_ratio"]) == (0.75, 0.0, 0.25)
    assert (got["c"]["filled"], got["c"]["unique_ratio"], got["c"]["mean_length"]) == (0, 0.0, 0.0) and got["d"]["boolean_ratio"] == pytest.approx(2 / 3)
    assert rows(profile.distinct_counts(df)) == [("a", 3), ("b", 2), ("c", 0), ("d", 3)]
