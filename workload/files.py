"""Queries which write the given tables in some format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import names
from tablewright.operators import corpus, findings, kpis, projection
from tablewright.session import new_folder
from tablewright.sources import catalog, readers, writers

from .common import load, r
from .keys import links_sql
from .logs import HASHED, SPLIT

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


ORDERS = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ', "' || o_orderstatus || '"' END AS note FROM orders"""


def noted_orders(spark, folder):
    key = F.col("o_orderkey")
    note = F.when(key % 5 != 0, F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')))
    return load(spark, folder, "orders").select("o_orderkey", "o_custkey", F.when(key % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", "o_orderdate", note.alias("note"))


def as_written(df):
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp"), "note")


@query(ORDERS)
def csv_round_trip(spark, folder):
    path = new_folder(spark, "orders") + ".csv"
    writers.write_csv(noted_orders(spark, folder), path)
    return as_written(readers.read_table(spark, path))


@query(ORDERS)
def tsv_scan(spark, folder):
    path = new_folder(spark, "orders") + ".tsv"
    noted_orders(spark, folder).write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return as_written(readers.read_table(spark, path))


def write_json_arrays(df, path):
    """One JSON array of records per task."""

    def bracketed(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield batch.from_pydict({"value": [("[" if first and i == 0 else ",") + line for i, line in enumerate(lines)]})
                first = False
        yield type(batch).from_pydict({"value": ["[]" if first else "]"]})

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(bracketed, "value string").write.text(path)


@query(ORDERS)
def json_array_scan(spark, folder):
    """Arrays cut at the borders of their records."""
    path = new_folder(spark, "orders") + ".json"
    write_json_arrays(noted_orders(spark, folder).repartition(4), path)
    records = readers.json_records(spark, path).select(F.from_json("record", noted_orders(spark, folder).schema).alias("r"))
    return as_written(records.select("r.*"))


@query("""SELECT event_id::VARCHAR AS event_id, event_type, value FROM events WHERE event_id % 10 <> 0""")
def event_log_scan(spark, folder):
    """JSON lines in which some are broken, some no objects, some repeated."""
    events = load(spark, folder, "events")
    key = F.col("event_id")
    line = F.to_json(F.struct(key.cast("string").alias("event_id"), "event_type", "value"))
    lines = events.select(F.when(key % 20 == 0, F.substring(line, 1, 9)).when(key % 10 == 0, F.lit("[1]")).otherwise(line).alias("value"), key)
    again = lines.filter(key % 4 == 0)
    path = new_folder(spark, "events")
    lines.unionByName(again).select("value").write.text(path)
    return readers.read_event_log(spark, path, "event_id string, event_type string, value double", key="event_id")


SPLIT_DOCS = f"SELECT doc_id, lang, split FROM (SELECT doc_id, lang, {SPLIT} AS split FROM (SELECT doc_id, lang, {HASHED} FROM (SELECT doc_id, lang, sha256(text) AS f FROM documents)))"


def split_documents(spark, folder):
    return load(spark, folder, "documents").select("doc_id", "lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), corpus.stable_split(F.sha2("text", 256)).alias("split"))


@query(f"SELECT * FROM ({SPLIT_DOCS}) WHERE split <> 'test'")
def split_scan(spark, folder):
    path = new_folder(spark, "corpus")
    writers.write_jsonl(split_documents(spark, folder), path)
    lines = readers.read_splits(spark, path)
    return lines.select(F.get_json_object("line", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("line", "$.lang").alias("lang"), "split")


@query("""SELECT c_custkey AS "key", c_name AS name, c_nationkey AS name_2, c_acctbal AS "Unnamed_4", c_mktsegment AS name_3 FROM customer""")
def repeated_headers(spark, folder):
    df = load(spark, folder, "customer")
    return df.toDF(*names.unique_headers(["key", "name", " name ", "", "name"]))


@query("""SELECT l_orderkey AS "L-ORDERKEY", l_shipdate AS "SHIP-DATE" FROM lineitem""")
def clean_headers(spark, folder):
    df = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias(" l orderkey "), F.col("l_shipdate").alias("Ship Date"))
    return projection.clean_headers(df, "upper", True, "-")


@query("""SELECT * FROM (VALUES ('o_clerk', 'added', NULL, 'string'), ('o_orderstatus', 'removed', 'string', NULL), ('o_custkey', 'retyped', 'bigint', 'int')) t("column", change, type_before, type_after), (SELECT count(*) > 0 AS any_row FROM orders) WHERE any_row""".replace("SELECT * FROM (VALUES", 'SELECT "column", change, type_before, type_after FROM (VALUES'))
def schema_changes(spark, folder):
    before = load(spark, folder, "orders")
    after = before.drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("int")).withColumn("o_clerk", F.lit("c"))
    return names.schema_changes(spark, before.schema, after.schema)


@query("""SELECT c_custkey, c_name, '[' || c_nationkey || ',' || c_custkey % 3 || ']' AS pair, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance FROM customer""")
def parquet_round_trip(spark, folder):
    key = F.col("c_custkey")
    df = load(spark, folder, "customer").select("c_custkey", "c_name", F.array(F.col("c_nationkey").cast("long"), key % 3).alias("pair"), F.when(key % 4 != 0, F.col("c_acctbal")).alias("balance"))
    path = new_folder(spark, "customers") + ".parquet"
    writers.write_parquet(df, path)
    return readers.read_table(spark, path)


def nation_files(spark, folder, changed=False):
    """One text file per nation, its customers in order."""
    path = new_folder(spark, "nations")
    key = F.col("c_nationkey")
    df = load(spark, folder, "customer")
    if changed:
        df = df.filter(key % 5 != 0).withColumn("c_name", F.when(key % 5 == 1, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name")))
    lines = df.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", F.concat_ws("|", "c_name", "c_mktsegment").alias("value"))
    lines.write.partitionBy("c_nationkey").text(path)
    return path


@query("""SELECT c_nationkey, sha256(string_agg(c_name || '|' || c_mktsegment || chr(10), '' ORDER BY c_custkey)) AS sha256, sum(strlen(c_name) + strlen(c_mktsegment) + 2)::BIGINT AS bytes FROM customer GROUP BY 1""")
def file_fingerprints(spark, folder):
    found = writers.file_fingerprints(spark, nation_files(spark, folder))
    return found.select(F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).cast("int").alias("c_nationkey"), "sha256", "bytes")


@query("""SELECT c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey % 5 < 2""")
def checksum_problems(spark, folder):
    known = writers.create_manifest(spark, nation_files(spark, folder))
    # File names are new on each write; nations are what is compared.
    named = lambda m: m.select(F.regexp_extract("path", r"(c_nationkey=\d+)/", 1).alias("path"), "sha256", "bytes")
    now = named(writers.create_manifest(spark, nation_files(spark, folder, changed=True)))
    found = writers.compared_manifests(named(known), now)
    return found.select(F.regexp_extract("path", r"=(\d+)", 1).cast("int").alias("c_nationkey"), "problem")


@query(f"""
WITH d AS ({SPLIT_DOCS}), c AS (SELECT (SELECT count(*) FROM d JOIN documents USING (doc_id) WHERE d.split = 'train' AND contains(lower(text), 'the')) AS leaks, (SELECT count(*) FROM documents) AS n)
SELECT 'too_few_examples' AS blocker FROM c WHERE n < 1000000000 UNION ALL SELECT 'manifest_report_mismatch' FROM c WHERE n + 1 <> n UNION ALL SELECT 'split_count_mismatch' FROM c
UNION ALL SELECT DISTINCT 'privacy_violation:' || d.split FROM d JOIN documents USING (doc_id) WHERE contains(lower(text), 'the then') UNION ALL SELECT 'sha_manifest_mismatch' FROM c
""")
def corpus_blockers(spark, folder):
    path = new_folder(spark, "corpus")
    docs = split_documents(spark, folder)
    writers.write_jsonl(docs, path)
    counts = {row["split"]: row["n"] for row in docs.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    manifest = {**{f"{s}_count": n + (s == "test") for s, n in counts.items()}, "eligible_examples": total + 1, "readiness": {"ready_for_prototype": total >= 10**9, "reason": "too_few_examples"}}
    written = writers.create_manifest(spark, path)
    altered = written.withColumn("sha256", F.when(F.contains("path", F.lit("split=train")), F.lit("0")).otherwise(F.col("sha256")))
    rows = spark.read.text(path).select(F.col("value").alias("line"), "split")
    return corpus.corpus_blockers(rows, manifest, {"eligible_examples": total}, writers.verify_manifest(spark, path, altered), forbidden=["the then"])


@query("""
SELECT 'experience' AS source_kind, count(*) AS n, count(DISTINCT doc_id) AS sources FROM documents UNION ALL
SELECT 'strategy', count(*), count(DISTINCT s) FROM (SELECT DISTINCT source || lang AS s FROM documents)
""")
def united_sources(spark, folder):
    from .logs import learning_events

    events = corpus.event_records(learning_events(spark, folder))
    docs = load(spark, folder, "documents").select("source", "lang").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    strategies = docs.select(
        F.concat("source", "lang").alias("strategy_id"), F.lit("filter").alias("intent"), none("array<string>").alias("semantic_roles"), none("string").alias("logical_structure"),
        none("array<string>").alias("tool_sequence"), F.lit("validated").alias("state"), F.lit("validated").alias("lifecycle_state"), none("string").alias("plan_template_id"), F.lit(0.9).alias("average_quality"), F.lit("").alias("created_at"),
        F.lit(3).alias("evidence_count"), F.col("source").alias("semantic_signature"),
    )
    united = events.unionByName(corpus.strategy_records(strategies))
    return united.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


@query("""SELECT * FROM (VALUES ('city', 'Town Name'), ('country', 'n_country'), ('latitude', 'LAT'), ('longitude', 'lng')) t(part, "column") WHERE (SELECT count(*) FROM nation) > 0""")
def location_columns(spark, folder):
    df = load(spark, folder, "nation").select(F.col("n_name").alias("n_country"), F.col("n_name").alias("Town Name"), F.col("n_nationkey").alias("LAT"), F.col("n_regionkey").alias("lng"), F.col("n_nationkey").alias("size"))
    return spark.createDataFrame(sorted(names.location_columns(df.columns).items()), "part string, column string")


# ---- many files at once ----------------------------------------------------------

INGESTED = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
            "events": "event_id event_type user_id value", "supplier": "s_suppkey s_name s_nationkey s_acctbal"}
ENDINGS = {"customer": "csv", "orders": "tsv", "events": "jsonl", "supplier": "parquet"}
KINDS = {"c_custkey": "int", "c_nationkey": "int", "c_acctbal": "double", "o_orderkey": "int", "o_custkey": "int", "o_totalprice": "double", "o_orderdate": "timestamp", "event_id": "int",
         "user_id": "int", "value": "double", "s_suppkey": "bigint", "s_nationkey": "int", "s_acctbal": "double"}


def in_parts(df, least):
    """In as many parts as it is read in, but no fewer than ``least``."""
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def ingested(spark, folder):
    """Tables in four formats, one of which is known already."""
    base = new_folder(spark, "inbox")
    writers.write_csv(load(spark, folder, "region"), f"{base}/region.csv")
    known = catalog.ingest(spark, base, spark.createDataFrame([], catalog.DATASET), "o1")[0]
    writers.write_csv(in_parts(load(spark, folder, "customer"), 3), f"{base}/customer.csv")
    in_parts(load(spark, folder, "orders"), 2).write.option("header", True).option("sep", "\t").csv(f"{base}/orders.tsv")
    events = load(spark, folder, "events").select(*INGESTED["events"].split())
    events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{base}/events.jsonl")
    writers.write_parquet(load(spark, folder, "supplier"), f"{base}/supplier.parquet")
    return catalog.ingest(spark, base, known, "o1", suffixes=("key", "_id"))


def _profiles():
    return " UNION ALL ".join(
        f"SELECT '{t}.{ENDINGS[t]}' AS dataset_name, '{c}' AS \"column\", '{KINDS.get(c, 'string')}' AS kind, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, count(*) AS row_count FROM {t}"
        for t, columns in INGESTED.items() for c in columns.split())


@query(_profiles())
def ingest_profiles(spark, folder):
    datasets, columns, _, _ = ingested(spark, folder)
    named = columns.join(datasets.select("dataset_id", "dataset_name", "row_count"), "dataset_id")
    return named.select("dataset_name", "column", "kind", "missing", F.col("distinct").alias("distinct_values"), "row_count")


@query(f"""SELECT s.e AS source_dataset, source_column, t.e AS target_dataset, target_column, confidence FROM ({links_sql(INGESTED)}) l
JOIN (VALUES {", ".join(f"('{t}', '{t}.{e}')" for t, e in ENDINGS.items())}) s(n, e) ON s.n = source_dataset JOIN (VALUES {", ".join(f"('{t}', '{t}.{e}')" for t, e in ENDINGS.items())}) t(n, e) ON t.n = target_dataset""")
def ingest_links(spark, folder):
    datasets, _, _, links = ingested(spark, folder)
    for end in ("source", "target"):
        named = datasets.select(F.col("dataset_id").alias(f"{end}_dataset"), F.col("dataset_name").alias(f"{end}_name"))
        links = links.join(named, f"{end}_dataset").drop(f"{end}_dataset").withColumnRenamed(f"{end}_name", f"{end}_dataset")
    return links.select("source_dataset", "source_column", "target_dataset", "target_column", "confidence")


# ---- own rules -------------------------------------------------------------------


@query("""
SELECT 'Largest Order' AS name, max(o_totalprice)::DOUBLE AS value FROM orders UNION ALL SELECT 'Open Share', round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 2)::DOUBLE FROM orders
""")
def own_figures(spark, folder):
    orders = load(spark, folder, "orders").select(F.col("o_totalprice").alias("paid"), "o_orderstatus")
    extra = [
        {"name": "Largest Order", "value": F.max("paid"), "unit": "currency", "confidence": 0.9},
        {"name": "Open Share", "value": F.round(F.count_if(F.col("o_orderstatus") == "O") * 100.0 / F.count(F.lit(1)), 2), "unit": "%", "confidence": 0.8},
    ]
    return kpis.kpis(orders, extra=extra).filter(F.col("name").isin("Largest Order", "Open Share")).select("name", "value")


@query("""
SELECT n_name AS nation, 'Customers' AS category, CASE WHEN share >= 60 THEN 'High' WHEN share >= 50 THEN 'Medium' ELSE 'Low' END AS priority, round(0.55 + least(1, greatest(0, (share - 40) / 40)) * 0.4, 2)::DOUBLE AS confidence
FROM (SELECT n_name, 100.0::DOUBLE * count(*) FILTER (c_acctbal > 0) / count(*) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) WHERE share >= 40
""")
def own_advice(spark, folder):
    customers = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shares = customers.groupBy(F.col("n_name").alias("nation")).agg((F.count_if(F.col("c_acctbal") > 0) * 100.0 / F.count(F.lit(1))).alias("share"))
    own = findings.rule(F.col("share") >= 40, "Customers", "Ask for payment", F.lit("many in credit"), F.col("share"), (50.0, 60.0), (40.0, 80.0))
    return findings.recommendations(shares, ["nation"], [own]).select("nation", "category", "priority", r("confidence", 2))
