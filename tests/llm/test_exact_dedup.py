"""Exact duplicates against a plain grouping of whole texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tablewright.llm import exact_dedup
from tablewright.operators import bitfilter


def plain_classes(rows):
    """(id, keep_id, group_size, sha) of each row, and how many rows stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, text or ""))
    out = []
    for normal, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(normal.encode()).hexdigest()) for i, _ in members]
    return out, len(groups)


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, v) for v in r])


def odd_rows():
    pick = random.Random(13)
    long = "wörter 😀 " * 60
    texts = [None, "", " \n", "\x0b\x0c", "a b", "ab", "a\tb", "a b", "b a", long, long + "x", long + "y", long.replace(" ", "\n"), "z" * 200_000, " " + "z" * 200_000]
    rows = [(i, pick.choice(texts)) for i in range(120)]
    rows += [(i, "".join(pick.choice("ab ") for _ in range(pick.randrange(9)))) for i in range(200, 320)]
    return rows + [(None, long), (None, "only one"), (7, "twice"), (7, "twice"), (7, "twice"), (500, "tie"), (499, "tie"), (498, "t ie"), (497, "ti e")]


def test_classes_equal_plain_grouping(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "mine", "mine", 3) for r in rows], "doc_id long, text string, digest string, Key string, kept int").repartition(7)
    wanted, groups = plain_classes(rows)
    found = exact_dedup.exact_duplicates(docs, every_digest=True).collect()
    assert in_order([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]) == in_order(wanted)
    staying = [r for r in found if r["kept"]]
    assert len(staying) == groups and all(r["doc_id"] == r["keep_id"] for r in staying)
    cheap = exact_dedup.exact_duplicates(docs).collect()
    assert in_order([r[:4] for r in cheap]) == in_order([r[:4] for r in found])
    assert all(r["text_sha256"] for r in cheap if r["group_size"] > 1) and not all(r["text_sha256"] for r in cheap)


def test_rows_which_stay(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "mine", "mine", i) for i, r in enumerate(rows)], "doc_id long, text string, turn string, Named string, row int").repartition(5)
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    normal = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got]
    assert len(set(normal)) == len(got) == plain_classes(rows)[1]
    best = {(k, s) for _, k, _, s in plain_classes(rows)[0]}
    assert {(r["doc_id"], hashlib.sha256(n.encode()).hexdigest()) for r, n in zip(got, normal)} == best


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With one word of bits nearly everything is suspect; results are whole."""
    monkeypatch.setattr(bitfilter, "LEAST_BITS", 2)
    monkeypatch.setattr(bitfilter, "MOST_BITS", 4)
    rows = odd_rows()
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), every_digest=True).collect()
    assert in_order([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]) == in_order(plain_classes(rows)[0])


def test_empty_tables_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.keep_one_of_each(empty).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", " x"), ("c", "x\n"), (None, "  x  ")], "name string, body string")
    assert {(r["name"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(named, "name", "body").collect()} == {
        ("a", None, False), ("b", None, False), ("c", None, False), (None, None, True)}


@pytest.mark.parametrize("part", ["classes", "keep"])
def test_main_path_is_native(spark, part):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    made = exact_dedup.Refinement(docs)
    found = made.classes() if part == "classes" else exact_dedup.keep_one_of_each(docs)
    plan = found._jdf.queryExecution().toString() + made.by_head.marked(docs.selectExpr("doc_id AS k"), "k", "s")._jdf.queryExecution().toString()
    for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"):
        assert word not in plan
