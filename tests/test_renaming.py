"""Names and shapes of texts against plain rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators import renaming


def plain_renamed(value, aliases):
    """Longest first; what is replaced is set aside and not searched again."""
    done = []
    for name in sorted({n for n, _ in aliases if n}, key=lambda n: (-len(n), n.lower())):
        alias = min(a for n, a in aliases if n == name)

        def put(match, alias=alias):
            done.append(alias)
            return chr(0x4E00 + len(done) - 1)

        value = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", put, value, flags=re.IGNORECASE)
    return "".join(done[ord(c) - 0x4E00] if 0x4E00 <= ord(c) < 0x9000 else c for c in value)


def test_names_by_plain_rule(spark):
    pick = random.Random(4)
    words = ["ann", "bo", "Ann", "lee", "x_1", "ann-lee", "é", "o'b", "+1"]
    aliases = [(f"{a}{s}{b}", f"C{i}") for i, (a, s, b) in enumerate((pick.choice(words), pick.choice([" ", "-", "."]), pick.choice(words)) for _ in range(25))]
    aliases = list({n.lower(): (n.lower(), a) for n, a in [*aliases, ("ann", "A1"), ("bo", "A2"), ("+1", "P"), ("é", "E")]}.values())
    texts = ["".join(pick.choice(words) + pick.choice([" ", ", ", "-", "", ". ", "ß "]) for _ in range(pick.randrange(14))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(900, None, "mine"), (901, "", "mine"), (902, "ANN " * 50_000, "mine")], "i long, t string, n string")
    table = spark.createDataFrame([*aliases, (None, "x"), ("", "y"), ("z", None)], "name string, alias string")
    found = {r["i"]: r["t"] for r in renaming.rename_names(df, "t", table).collect()}
    assert [found[i] for i in range(200)] == [plain_renamed(t, aliases) for t in texts]
    assert found[900] is None and found[901] == "" and found[902] == f"{dict(aliases)['ann ann']} " * 25_000


def test_plan_does_not_grow_with_the_names(spark, monkeypatch):
    df = spark.createDataFrame([("name 77777 met name 5",)], "t string")
    plans = []
    for n in (10, 100_000):
        names = spark.range(n).select(F.concat(F.lit("name "), "id").alias("name"), F.concat(F.lit("N"), "id").alias("alias"))
        done = renaming.rename_names(df, "t", names)
        plans.append(len(done._jdf.queryExecution().optimizedPlan().toString()))
    assert done.first()["t"] == "N77777 met N5" and abs(plans[0] - plans[1]) < 50
    monkeypatch.setattr(renaming, "MOST_NAMES", 9)
    with pytest.raises(ValueError):
        renaming.rename_names(df, "t", names)


def plain_shape(value):
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain_shape(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain_shape, value)) + "]"
    kinds = {bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}
    return f'"{kinds[type(value)]}"'


def test_shapes_by_plain_walk(spark):
    pick = random.Random(6)
    texts = ["", "a", 'q"', "\\", '\\"', "x: {1, [2]}", "null", "true,", "\u0001b", "é:", "a\\\\", ":", " : "]

    def made(depth):
        kind = pick.randrange(7 if depth else 5)
        if kind == 5:
            return {pick.choice(texts) + str(i): made(depth - 1) for i in range(pick.randrange(4))}
        if kind == 6:
            return [made(depth - 1) for _ in range(pick.randrange(4))]
        return [pick.choice(texts), pick.choice([0, -3, 10**17]), pick.choice([1.5, -2e-7, 1e300, 3.0]), pick.random() < 0.5, None][kind]

    docs = [made(4) for _ in range(300)]
    written = [json.dumps(d, ensure_ascii=False, indent=pick.choice([None, 1])) for d in docs]
    df = spark.createDataFrame([*enumerate(written), (900, "no json"), (901, None), (902, '{"a":')], "i long, v string")
    found = {r["i"]: r["s"] for r in df.select("i", text.json_shape(F.col("v")).alias("s")).collect()}
    assert [found[i] for i in range(300)] == [plain_shape(json.loads(w)) for w in written]
    assert found[900] is None and found[901] is None and found[902] is None
