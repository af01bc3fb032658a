"""The Merkle manifest against a plain build and climb of whole lists."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def plain_h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return plain_h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([plain_h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proofs(rows, change):
    """(id, leaf, subroot, root, siblings, folded) of each row."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(r)))
    trees = {name: plain_levels([plain_leaf(r) for r in sources[name]]) for name in names}
    top = plain_levels([trees[name][-1][0] for name in names])
    out = []
    for rank, name in enumerate(names):
        for i, row in enumerate(sources[name]):
            folded, siblings = plain_leaf(change(row)), []
            for levels, at in ((trees[name], i), (top, rank)):
                for level in levels[:-1]:
                    start = at - at % 3
                    left, right = level[start:at], level[at + 1 : start + 3]
                    folded, at = plain_h(*left, folded, *right), at // 3
                    siblings += left + right
            out.append((row[0], plain_leaf(row), trees[name][-1][0], top[-1][0], "".join(siblings), folded))
    return out


def odd_rows(sizes):
    pick, rows = random.Random(12), []
    for name, size in sizes.items():
        for i in range(size):
            rows.append((pick.randrange(10**6), name, pick.choice(["en", None, ""]), pick.choice([None, 3]), pick.choice([None, "", "a\nb", "line\n" * 9, "ünï\n", "plain"])))
    return rows + [rows[0], rows[0], (None, *rows[0][1:]), (None, *rows[0][1:]), (-5, rows[0][1], "en", 1, "long\n" * 50_000)]


def cut(row):
    return (*row[:4], row[4].replace("\n", "") if row[4] is not None and (row[0] or 0) % 2 == 0 and row[0] is not None else row[4])


def found_text():
    return F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("levels, fanin, sizes", [
    (6, 8192, {"hot": 900, None: 28, "one": 1, "é": 3, "z": 82, "": 2, **{f"s{i}": i for i in range(4, 9)}}),
    (1, 5, {"hot": 100, None: 4, "one": 1, "z": 9, "\U0001f600": 10, "￮": 27}),
    (2, 3, {"alone": 90}),
    (4, 2, {f"s{i}": 1 for i in range(100)}),
])
def test_proofs_equal_plain_climb(spark, monkeypatch, levels, fanin, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "FAN", 3**levels)
    monkeypatch.setattr(merkle, "FANIN", fanin)
    rows = odd_rows(sizes)
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA + ", tree string, Place int").repartition(5)
    found = merkle.climb(merkle.build(docs, found={"text": found_text()})).collect()
    got = [(r["id"], r["leaf"], r["subroot"], r["root"], bytes(r["proof"]).hex(), r["folded_root"]) for r in found]
    order = lambda rs: sorted(rs, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order(got) == order(plain_proofs(rows, cut))
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in found)
    assert not all(r["verified"] for r in found) and any(r["verified"] for r in found)


def test_single_leaf_and_empty_table(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    got = merkle.climb(merkle.build(one)).first()
    leaf = plain_leaf((1, None, None, None, None))
    assert (got["leaf"], got["subroot"], got["root"], got["folded_root"], bytes(got["proof"]), got["verified"]) == (leaf, leaf, leaf, leaf, b"", True)
    empty = merkle.build(one.limit(0))
    assert empty.root is None and empty.subroots.count() == 0 and merkle.climb(empty).count() == 0


def test_other_fields_and_settings_stay(spark):
    pages = spark.createDataFrame([("b", "x", 1.5), ("a", "x", None), ("c", "y", 2.0)], "name string, site string, weight double")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    made = merkle.build(pages, ["name", "weight"], "site", "name")
    got = {r["id"]: r for r in merkle.climb(made).collect()}
    assert got["a"]["leaf"] == plain_h("1:a", "-") and got["b"]["leaf"] == plain_h("1:b", "3:1.5") and all(r["verified"] for r in got.values())
    assert bytes(got["c"]["proof"]).hex() == plain_h(got["a"]["leaf"], got["b"]["leaf"]) and {r["tree"]: r["leaves"] for r in made.subroots.collect()} == {"sx": 2, "sy": 1}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
