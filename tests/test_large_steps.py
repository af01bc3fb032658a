"""Steps whose memory or shuffled rows must not grow faster than the input."""

import random

from pyspark.sql import functions as F

from tablewright.functions import parsing
from tablewright.functions.text import words
from tablewright.operators import matching, relations, renaming
from tablewright.sources import catalog


def test_texts_far_apart_do_not_travel_as_pairs(spark, rows):
    """All texts share their rarest words, so every pair meets; of those only
    the near ones leave the join, and none of these is lost."""
    pick = random.Random(3)
    listed = [f"w{i}" for i in range(60)]
    texts = sorted({" ".join(["rare", *pick.sample(listed, pick.randrange(1, 40))]) for _ in range(150)})
    texts += [t + " more" for t in texts[::3]]
    new, past = (spark.createDataFrame([(t,) for t in side], "norm string") for side in (texts[:150], texts))
    floor = 0.8
    found = matching._near_pairs(new, past, floor)
    sets = {t: set(t.split()) for t in texts}
    near = sorted((a, b) for a in texts[:150] for b in texts if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= floor)
    assert len(near) > 150 and rows(found) == near
    # The bound is a condition of the join by words, below the exchange of pairs.
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()


def test_signs_never_differ_by_more_than_the_words(spark):
    pick = random.Random(5)
    texts = [" ".join(pick.sample([f"w{i}" for i in range(400)], n)) for n in (1, 2, 5, 40, 300, 399, 400)]
    both = spark.createDataFrame([(t, "new") for t in texts], "norm string, side string").withColumn("text_id", F.xxhash64("norm"))
    lists = matching._word_lists(both).join(both.select("text_id", "norm", F.size(words(F.col("norm"))).alias("n")), "text_id").collect()
    assert all(r["size"] == r["n"] == len(set(r["tokens"])) for r in lists)
    bits = lambda r: [int(r[f"sign{i}"]) & (1 << 64) - 1 for i in range(matching.SIGN_WORDS)]
    for a in lists:
        for b in lists:
            apart = sum((x ^ y).bit_count() for x, y in zip(bits(a), bits(b)))
            assert apart <= len(set(a["norm"].split()) ^ set(b["norm"].split()))


def test_a_task_holds_a_bounded_number_of_cells(spark, rows, monkeypatch):
    """Keys of 3,000 values, a part of them hot: links are exact whatever the
    number of parts, and the parts follow the number of cells."""
    monkeypatch.setattr(relations, "TASK_CELLS", 500)
    monkeypatch.setattr(relations, "BROADCAST_VALUES", 50)
    owners = spark.range(3000).select(F.col("id").alias("owner_key"), (F.col("id") % 7).alias("kind_id")).coalesce(1)
    things = spark.range(4000).select(F.col("id").alias("thing_key"), F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id") % 3100).alias("owner_id")).coalesce(1)
    kinds = spark.range(7).select(F.col("id").alias("kind_key"))
    tables = {"owners": owners, "things": things, "kinds": kinds}
    used = [i % 3100 for i in range(4000) if i % 3 == 1] + [5]
    share = len({u for u in used if u < 3000}) / len(set(used))
    found = relations.relationships(tables, {"owners": ["kind_id"], "things": ["owner_id"]}, suffixes=("_id",))
    links = {tuple(r)[:4]: r["confidence"] for r in found.collect()}
    assert links["things", "owner_id", "owners", "owner_key"] == round(share, 4) and links["owners", "kind_id", "kinds", "kind_key"] == 1.0
    columns = relations.Columns(tables)
    wanted = [columns.ids["owners", "owner_key"], columns.ids["owners", "kind_id"]]
    distinct = relations._distinct(columns, wanted)
    assert rows(distinct.groupBy("c").count()) == [(wanted[0], 3000), (wanted[1], 7)]
    dealt, parts = relations._dealt(columns, wanted)
    assert parts == 12 and max(dealt.groupBy(F.spark_partition_id()).agg(F.countDistinct("c", "h", "g").alias("n")).select("n").toPandas()["n"]) < 1000


def test_rows_of_files_are_not_dealt_by_their_file(spark, tmp_path):
    """Few large files must not become few tasks: what is known of files and
    columns goes to the rows, and each cell stays where its file is read."""
    for i in range(2):
        (tmp_path / f"t{i}.csv").write_text("key_id,name\n" + "".join(f"{k},n{k % 3}\n" for k in range(50)), encoding="utf-8")
        (tmp_path / f"r{i}.jsonl").write_text("".join(f'{{"key_id": {k}, "name": "n{k % 3}"}}\n' for k in range(50)), encoding="utf-8")
    spark.range(50).selectExpr("id AS key_id", "concat('n', id % 3) AS name").write.parquet(f"{tmp_path}/p.parquet")
    rows = catalog.new_files(spark, str(tmp_path), spark.createDataFrame([], catalog.DATASET), "o").collect()
    long = catalog.LongTable(spark, [catalog.Table(r["sha256"][:16], r["path"], r["sha256"], list(r["files"]), catalog._format(r["path"], r["files"][0])) for r in rows])
    assert "hashpartitioning" not in long.cells._jdf.queryExecution().executedPlan().toString()
    found = relations.LongColumns({t.dataset: t.columns for t in long.tables}, long.cells)
    wanted = found.cells(found.ids.values(), relations._hash)
    assert "hashpartitioning" not in wanted._jdf.queryExecution().executedPlan().toString()
    measured = {(r["dataset"], r["column"]): (r["kind"], r["rows"], r["distinct"]) for r in long.measured(found).collect()}
    assert sorted(measured.values()) == sorted([("int", 50, 50)] * (len(rows) - 1) + [("bigint", 50, 50)] + [("string", 50, 3)] * len(rows))


def test_numbers_and_dates_are_tried_only_where_they_may_be(spark):
    """The gates before slow casts lose nothing which the casts can read."""
    texts = ["", " ", "1", " 1 ", "+1", "-0", "007", "1.0", ".5", "5.", ".", "1e5", "1E-5", "1e", "1d", "2.5F", "0x1p3", "-0X1.8P1", "inf", "-Infinity", "NaN", " nan ", "iNf", "\t1\n", "\x001", "1\x7f", "1 2", "1-2",
             "2147483648", "-2147483649", "9223372036854775808", "0" * 30 + "1", "1_000", "1,000", "\u0661", "1\u00a0", "x1", "2024", "2024-01-05", "2024-1-5", "2024-01-05 10:00", "2024-01-05T10:00:00Z", "2024/01/05", "1/2/2024",
             "1/2/2024 10:00", "31-12-2024", "5 Jan 2024", "Jan 5, 2024", "January 5, 2024", " 2024-01-05 ", "12024-01-05", "5-LOW", "Customer#000000001", "true", None]
    v = F.col("v")
    plain = v.try_cast("double"), v.try_cast("bigint")
    whole = parsing.whole(v)
    odd = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", parsing.double(v).eqNullSafe(plain[0]).alias("d"), whole.eqNullSafe(plain[1]).alias("w"), whole.between(-(1 << 31), (1 << 31) - 1).eqNullSafe(F.when(plain[1].isNotNull(), v.try_cast("int").isNotNull())).alias("i"),
        parsing.timestamp(v).eqNullSafe(parsing.timestamp(v, shapes=dict(parsing.DATE_SHAPES))).alias("t"))
    assert odd.filter("not (d and w and i and t)").collect() == []


def test_many_names_are_joined_and_do_not_travel(spark, monkeypatch):
    """Beyond a bound the names are no part of any task; the texts are the same."""
    pick = random.Random(8)
    words = ["ann", "bo", "Ann", "lee", "x_1", "ann-lee", "\u00e9", "o'b", "+1", "\u0130x", "Stra\u00dfe"]
    names = list({f"{pick.choice(words)}{pick.choice([' ', '-', ''])}{pick.choice(words)}": f"C{i}" for i in range(60)}.items())
    names += [("ann", "A2"), ("ANN", "A1"), ("ann", "A0"), ("+1", "P"), (None, "x"), ("", "y"), ("z", None)]
    texts = ["".join(pick.choice(words) + pick.choice([" ", ", ", "-", "", ". ", "\u00df "]) for _ in range(pick.randrange(14))) for _ in range(150)] + [None, "", "ann " * 3000, "ANN", "ann"] + ["twice bo"] * 2
    df = spark.createDataFrame([(t, i % 3, None, t) for i, t in enumerate(texts)], "name string, row int, hits double, t string").repartition(3)
    table = spark.createDataFrame(names, "name string, alias string")
    travelling = renaming.rename_names(df, "t", table)
    monkeypatch.setattr(renaming, "TRAVELLING_NAMES", 5)
    monkeypatch.setattr(renaming, "CANDIDATES", 100)
    joined = renaming.rename_names(df, "t", table)
    sort = lambda d: sorted(map(str, d.collect()))
    assert joined.schema == travelling.schema and sort(joined) == sort(travelling) and len(sort(joined)) == len(texts)
    assert "BatchEvalPython" not in (plan := joined._jdf.queryExecution().optimizedPlan().toString()) and "Join" in plan
    none = renaming.rename_names(df.filter("false"), "t", table)
    assert none.count() == 0 and none.schema == travelling.schema
