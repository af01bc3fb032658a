"""Faults once found in the operators, and bare executors."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat, decision_list, decontamination, mixing, queries, simhash, toxicity, warc

from .test_tables import plain_contamination, spread

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]

BARE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def absent(batches):
    for batch in batches:
        try:
            import tablewright
            raise RuntimeError("the package is installed, nothing is shown")
        except ModuleNotFoundError:
            yield batch

spark.range(4).mapInArrow(absent, "id long").count()
from tablewright.llm import queries
for name, query in queries.QUERIES.items():
    rows = query(spark, {FOLDER!r})
    assert rows.agg(F.count(F.lit(1))).first()[0] > 0, name
    rows.write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


def test_executors_need_no_installed_copy(tmp_path):
    """All queries from another folder, where workers cannot import the package."""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    # The tokenizers' folder is the driver's business alone.
    code = BARE.replace("import sys\n", f"import sys\nsys.path.insert(0, {str(Path(public_tokenizers.__file__).resolve().parent.parent)!r})\n" + (
        f"sys.path.insert(0, {str(Path(public_tokenizers.__file__).resolve().parent)!r})\n"), 1)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    done = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("done")]
    assert done == list(queries.QUERIES), run.stderr[-3000:]


HELPERS = ["_id", "_key", "_size", "_target", "_name", "_w", "_row", "_own", "_text", "_identity", "_text_hash", "spans", "_turn", "turn", "named", "nameless", "hashed", "cut", "words",
           "_quality_n_words", "word", "bits", "taken", "score", "host", "root", "id", "text_hash"]


def test_no_user_column_is_touched(spark):
    """Columns with the operators' own helper names come back as they were."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    named = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in HELPERS])
    benchmark, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("benchmark", "labels"))
    rules, model = decision_list.fit(docs, labels), toxicity.fit(docs, labels)
    results = {
        "mixing": mixing.mixed_documents(named), "simhash": simhash.keep_one_of_each(named), "documents": decontamination.decontaminate(named, benchmark),
        "spans": decontamination.decontaminate(named, benchmark, "spans"), "quality": decision_list.keep_good(named, rules), "toxicity": toxicity.reject_toxic(named, model),
    }
    for name, result in results.items():
        assert set(named.columns) <= set(result.columns), name
        for row in result.select(*HELPERS).distinct().collect():
            assert row.asDict() == {c: f"mine {c}" for c in HELPERS}, name


def test_mixing_reads_columns_with_its_own_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("source").alias("_name"))
    plain = mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found = mixing.mix(docs, doc_id="_id", text="_text", source="_name")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_windows_with_and_without_broadcast(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_RUNS", broadcast)
    pick = random.Random(9)
    say = lambda n: " ".join(pick.choice("a b c d".split()) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 30])][pick.randrange(2) :]
    for chosen in (items, items[4:], items[6:]):
        docs = [(i, " ".join([say(pick.randint(0, 40)), pick.choice(items)[1]])) for i in range(40)] + [(100, None), (101, ""), (None, say(60)), (7, "a"), (7, "a")]
        found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(chosen, "item_id long, text string"))
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect()]
        assert spread(got) == spread(plain_contamination(docs, chosen))


def plain_merged(spans):
    out = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def test_spans_are_merged(spark):
    pick = random.Random(5)
    rows = [sorted({(s, s + pick.randint(1, 13)) for s in (pick.randrange(most) for _ in range(pick.randrange(60)))}) for most in (10, 50, 300, 2000) for _ in range(30)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, spans array<struct<start:int,end:int>>")
    found = {r["i"]: [tuple(s) for s in r["spans"]] for r in decontamination.merged(df, "spans", 13).collect()}
    assert found == {i: plain_merged(r) for i, r in enumerate(rows)}


def test_many_spans_take_linear_time(spark):
    """A text with a million hits; merging them one by one would not end."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda s: F.struct((s * 2).alias("start"), (s * 2 + 1).alias("end"))).alias("spans"))
    found = decontamination.merged(df, "spans", 13).select(F.size("spans"), F.element_at("spans", -1)["end"]).first()
    assert tuple(found) == (1_000_000, 1_999_999)


def test_missing_ids_are_not_a_name(spark):
    passage = " ".join(f"item{i}" for i in range(30))
    docs = spark.createDataFrame([("(none)", passage), (None, passage), (None, "clean words"), ("(none)", "clean words")], "doc_id string, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, items).collect()
    assert sorted((r["doc_id"] or "", r["text"]) for r in kept) == [("", "clean words"), ("(none)", "clean words")]
    assert {r["text"] for r in decontamination.decontaminate(docs, items, "spans").collect()} == {"", "clean words"}


def test_buckets_are_even_whatever_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 100)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"), F.lit("s").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 0.1).when(F.col("doc_id") % 10 == 1, 30.0).otherwise(1.0)
    slim = mixing.drawn(docs, "doc_id", "text", "source", 0, weight).drop("_row", "_own")
    planned = mixing.plan(slim, (3, 1, 2), 1.5, 2.0)
    sizes = mixing.with_sources(slim, planned).groupBy(mixing.bucket().alias("b")).count().collect()
    assert len(sizes) > 150 and max(r["count"] for r in sizes) < 500


def test_repeated_messages_count_once(spark):
    rows = [("t", 0, None, 1.0, "user", "hi"), ("t", 1, 0, 1.0, "assistant", "yes"), ("t", 2, 1, 1.0, "user", "ok")]
    frame = spark.createDataFrame([*rows, rows[1], rows[2], rows[2]], "tree string, id long, parent long, score double, role string, text string")
    found = chat.read_back(chat.formatted(frame)).collect()
    assert len(found) == 1 and found[0]["n_turns"] == 3
    assert sorted(tuple(r) for r in chat.branches(frame).collect()) == sorted(tuple(r) for r in chat.branches(spark.createDataFrame(rows, frame.schema)).collect())


@pytest.mark.parametrize("kind", ["string", "double", "long"])
def test_page_ids_of_any_type(spark, kind):
    names = {"string": ["b", "a b\r\nc: é", "10", None, "9"], "double": [2.5, -1.0, 10.0, None, 9.0], "long": [3, 1, 10, None, 9]}[kind]
    pages = spark.createDataFrame([(n, f"http://x/{i}", h) for i, (n, h) in enumerate(zip(names, ["same", "same", "same", "same", ""]))], f"page_id {kind}, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archived_pages(pages).collect()}
    least = min(n for n, h in zip(names, "ssss") if n is not None)
    assert found == {n: ("response", None) if n in (least, names[4]) else ("revisit", least) for n in names}


def test_misspelt_and_masked_terms(spark):
    lexicon = toxicity.Lexicon(["idiot", "stupid", "grobnaken"], ["grobn"])
    scorer = toxicity.Scorer(lexicon)
    assert scorer.kind("grobnaken") == "stem" and scorer.kind("grabnaken") == "fuzzy" and scorer.kind("gravel") == ""
    for text in ("you idi@t", "so $tupid", "an 1diot", "idiot@home.org"):
        assert sum(scorer.features(text)) > 0, text
    for text in ("mail a@b.org", "pay $100 or @ noon", "5$ and @you", ""):
        assert sum(scorer.features(text)) == 0, text
