"""Records cut from arrays, digests of ranges, many files at once, blockers."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import corpus
from tablewright.sources import catalog, readers, writers


@pytest.fixture
def small_splits(spark):
    """Files are read in pieces of some hundred bytes."""
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def odd_records(n):
    pick = random.Random(n)
    texts = ["x}y", 'q"{', "\\", '\\"}', '[{"n": 1}]', "é\n😀", "", "}{", "\\\\}"]
    return [{"a": i, "t": pick.choice(texts), "n": {"k": [{"z": pick.random()}, {"z": 2.0}][: pick.randrange(3)]}, "b": pick.choice([True, None])} for i in range(n)]


def test_records_of_json_arrays(spark, tmp_path, small_splits):
    records = odd_records(150)
    files = {
        "line.json": json.dumps(records, ensure_ascii=False), "pretty.json": json.dumps(records, indent=2), "ascii.json": "\n [" + " ,\n".join(json.dumps(r) for r in records) + "]\n",
        "single.json": json.dumps(records[0]), "empty.json": "[]", "nothing.json": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {}
    for row in readers.json_records(spark, str(tmp_path)).collect():
        found.setdefault(row["file"].rsplit("/", 1)[-1], {})[row["place"]] = json.loads(row["record"])
    whole = dict(enumerate(records))
    assert found == {"line.json": whole, "pretty.json": whole, "ascii.json": whole, "single.json": {0: records[0]}}


def test_long_arrays_read_like_short_ones(spark, tmp_path, monkeypatch, small_splits):
    path = tmp_path / "records.json"
    path.write_text(json.dumps(odd_records(80)), encoding="utf-8")
    short = readers.read_table(spark, str(path))
    monkeypatch.setattr(readers, "WHOLE_BYTES", 100)
    long = readers.read_table(spark, str(path))
    assert long.schema == short.schema and sorted(map(str, long.collect())) == sorted(map(str, short.collect())) and long.count() == 80
    given = readers.read_table(spark, str(path), "a long, t string")
    assert given.columns == ["a", "t"] and given.agg(F.sum("a")).first()[0] == sum(range(80))


def plain_digest(data, length):
    if len(data) <= length:
        return hashlib.sha256(data).hexdigest()
    return hashlib.sha256("".join(hashlib.sha256(data[i : i + length]).hexdigest() for i in range(0, len(data), length)).encode()).hexdigest()


def test_digests_of_ranges(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(writers, "RANGE_BYTES", 1_000)
    pick = random.Random(2)
    files = {f"f {n}.bin": pick.randbytes(n) for n in (0, 1, 999, 1_000, 1_001, 2_000, 4_321)}
    (tmp_path / "deep").mkdir()
    for name, data in files.items():
        (tmp_path / "deep" / name).write_bytes(data)
    assert rows(writers.create_manifest(spark, str(tmp_path))) == sorted((f"deep/{n}", plain_digest(d, 1_000), len(d)) for n, d in files.items())


def test_a_file_beyond_one_row(spark, tmp_path):
    """More bytes than a cell can hold; the file has holes, so no disk is used."""
    size = (2 << 30) + 12_345
    path = tmp_path / "large.bin"
    with open(path, "wb") as out:
        out.truncate(size)
        out.seek(size - 3)
        out.write(b"end")
    zeros = hashlib.sha256(bytes(writers.RANGE_BYTES)).hexdigest()
    tail = hashlib.sha256(bytes(size % writers.RANGE_BYTES - 3) + b"end").hexdigest()
    found = writers.file_fingerprints(spark, str(tmp_path)).first()
    assert (found["bytes"], found["sha256"]) == (size, hashlib.sha256((zeros * (size // writers.RANGE_BYTES) + tail).encode()).hexdigest())


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        result = work()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    counts = []
    for n in (3, 60):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        for i in range(n):
            width = 1 + i % 4
            head = ",".join(["key_id", "some_id", "amount", "when"][:width])
            lines = [",".join([str(k + i), str(k % 5 + i), f"{k}.5", "2024-01-05"][:width]) for k in range(20)]
            (folder / f"t{i:02d}.csv").write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
        empty = spark.createDataFrame([], catalog.DATASET)
        (found, jobs) = jobs_of(spark, f"ingest{n}", lambda folder=folder, empty=empty: [part.collect() for part in catalog.ingest(spark, str(folder), empty, "o")])
        datasets, columns, roles, links = found
        assert len(datasets) == n and all(r["row_count"] == 20 for r in datasets) and len(columns) == sum(1 + i % 4 for i in range(n))
        assert {r["kind"] for r in columns if r["column"] == "amount"} <= {"double"} and {r["kind"] for r in columns if r["column"] == "when"} <= {"date"}
        counts.append(jobs)
    # Names of many files are listed by jobs of their own.
    assert counts[1] <= 1.25 * counts[0], counts


def test_ingest_of_formats_parts_and_odd_cells(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    spark.range(50).selectExpr("id AS customer_id", "concat('n', id % 3) AS name").repartition(4).write.option("header", True).csv(f"{box}/customers.csv")
    spark.range(30).selectExpr("id AS order_id", "id % 7 AS customer_id", "id / 2 AS total_price").write.parquet(f"{box}/orders.parquet")
    (box / "notes.json").write_text(json.dumps([{"note_id": 1, "text": "a }"}, {"note_id": 2, "text": None}, {"note_id": 3}]), encoding="utf-8")
    (box / "odd.tsv").write_text("﻿a\ta\t\tempty\n1.0\t x \t\t\n1\t\"q\"\"\t\"\t \t\n", encoding="utf-8")
    (box / "head only.csv").write_text("x,y\n", encoding="utf-8")
    (box / "nothing.csv").write_text("", encoding="utf-8")
    datasets, columns, roles, links = catalog.ingest(spark, str(box), spark.createDataFrame([], catalog.DATASET), "o")
    ids = {r["dataset_id"]: r["dataset_name"] for r in datasets.collect()}
    sizes = {r["dataset_name"]: (r["row_count"], r["column_count"]) for r in datasets.collect()}
    assert sizes == {"customers.csv": (50, 2), "orders.parquet": (30, 3), "notes.json": (3, 2), "odd.tsv": (2, 4), "head only.csv": (0, 2), "nothing.csv": (0, 0)}
    got = {(ids[r["dataset_id"]], r["column"]): (r["kind"], r["missing"], r["distinct"]) for r in columns.collect()}
    assert got["customers.csv", "customer_id"] == ("int", 0, 50) and got["orders.parquet", "customer_id"] == ("bigint", 0, 7) and got["notes.json", "text"] == ("string", 2, 1)
    assert [got["odd.tsv", c] for c in ("a", "a_2", "Unnamed_3", "empty")] == [("double", 0, 1), ("string", 0, 2), ("string", 2, 0), ("string", 2, 0)]
    assert got["head only.csv", "x"] == ("string", 0, 0)
    assert {(ids[r["source_dataset"]], r["source_column"], ids[r["target_dataset"]], r["target_column"]) for r in links.collect()} >= {("orders.parquet", "customer_id", "customers.csv", "customer_id")}
    found = {(ids[r["dataset"]], r["column"]): r["role"] for r in roles.collect()}
    assert found["customers.csv", "customer_id"] == "primary_key" and found["orders.parquet", "customer_id"] == "foreign_key" and found["orders.parquet", "total_price"] == "currency"
    assert catalog.ingest(spark, str(box), datasets, "o")[0].count() == 0


LINES = [("train", "a"), ("train", "b"), ("test", "c"), ("validation", "John Smith")]


@pytest.mark.parametrize("manifest, report, blockers", [
    ({}, {"x": 1}, {"missing_files:manifest"}), ({}, {}, {"missing_files:manifest,report"}),
    ({"eligible_examples": 4, "train_count": 2, "validation_count": 1, "test_count": 1, "readiness": {"ready_for_prototype": True}}, {"eligible_examples": 4}, {"privacy_violation:validation"}),
    ({"eligible_examples": 5, "train_count": 2, "validation_count": 1, "test_count": 2}, {"eligible_examples": 4, "split_integrity_passed": False, "readiness": {"reason": "few"}},
     {"few", "manifest_report_mismatch", "split_integrity_failed", "split_count_mismatch", "privacy_violation:validation"}),
])
def test_blockers_of_a_corpus(spark, manifest, report, blockers):
    rows = spark.createDataFrame(LINES, "split string, line string")
    found = [r["blocker"] for r in corpus.corpus_blockers(rows, manifest, report, forbidden=["john smith"]).collect()]
    assert set(found) == blockers and len(found) == len(blockers)


def test_checksums_block_a_corpus(spark):
    rows = spark.createDataFrame(LINES[:3], "split string, line string")
    manifest = {"eligible_examples": 3, "train_count": 2, "validation_count": 0, "test_count": 1, "readiness": {"ready_for_prototype": True}}
    problems = spark.createDataFrame([("p", "changed"), ("q", "unexpected")], "path string, problem string")
    found = lambda p: [r["blocker"] for r in corpus.corpus_blockers(rows, manifest, {"eligible_examples": 3}, p).collect()]
    assert found(problems) == ["sha_manifest_mismatch"] and found(problems.filter("path = 'q'")) == [] and os.sep


