"""Readers for tables and logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted, unique_headers
from ..operators.cleaning import blank_to_null
from ..operators.ordered import row_index, running_total


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8", blanks: bool = True
) -> DataFrame:
    """CSV, TSV, JSON records, Parquet or ORC by file name; any other name is
    read as CSV.  With a schema no inference pass is made.  Headers are made
    unique and blank text becomes null."""
    name = path.lower().rstrip("/")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if name.endswith(".parquet"):
        df = reader.parquet(path)
    elif name.endswith(".orc"):
        df = reader.orc(path)
    elif name.endswith((".jsonl", ".ndjson")):
        df = reader.json(path)
    elif name.endswith(".json"):
        df = read_json_records(spark, path, schema)
    else:
        separator = "\t" if name.endswith((".tsv", ".tab")) else ","
        options = {"header": True, "sep": separator, "encoding": encoding, "escape": '"', "quote": '"'}
        df = reader.options(**options, inferSchema=schema is None).csv(path)
    df = df.toDF(*unique_headers(df.columns))
    return blank_to_null(df) if blanks else df


#: Bytes of JSON files which one task each may read whole.
WHOLE_BYTES = 64 << 20


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of JSON files, each an array of objects or one object.

    Files of at most WHOLE_BYTES are read by a task each.  Longer ones are cut
    at the borders of their records (``json_records``) and parsed in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select("length")
    if files.filter(F.col("length") > WHOLE_BYTES).isEmpty():
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.option("multiLine", True).json(path)
    records = json_records(spark, path)
    if schema is None:
        found = records.agg(F.schema_of_variant_agg(F.parse_json("record"))).first()[0]
        schema = _plain_types(found)
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def _plain_types(described: str) -> T.StructType:
    """The schema of a described object; numbers as a JSON reader takes them."""
    text = re.sub(r"^OBJECT<", "STRUCT<", described)
    text = re.sub(r"OBJECT<", "STRUCT<", re.sub(r"DECIMAL\(\d+,\s*\d+\)|FLOAT", "DOUBLE", text)).replace("VOID", "STRING").replace("VARIANT", "STRING")
    kind = T._parse_datatype_string(text)
    return T.StructType(sorted(kind.fields, key=lambda f: f.name))


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, place, record): the text of every record of JSON arrays, however
    long a file is and however it is broken into lines.

    Files are split after each ``}``, where no escape can be open.  Whether a
    piece begins inside a string is the parity of the quotes before it; its
    depth there is the sum of the braces before it, outside strings.  Both are
    scans in chunks.  A record ends where the depth comes back to zero.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    cut = F.split(F.concat(plain, F.lit("}")), '"')
    outside = lambda first: F.array_join(F.filter(cut, lambda _, i: i % 2 == first), "")
    depth = lambda text: F.length(F.replace(text, F.lit("}"), F.lit(""))) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    order = ["block", "at"]
    # Depth of a piece which begins outside a string, and inside one.
    slim = pieces.select("file", *order, "piece", (F.size(cut) - 1).cast("long").alias("quotes"), depth(outside(0)).cast("long").alias("plain"), depth(outside(1)).cast("long").alias("quoted"))
    placed = row_index(slim, order, ["file"], "place").drop(*order)
    placed = running_total(placed, "quotes", ["place"], ["file"], "upto")
    inside = (F.col("upto") - F.col("quotes")) % 2 == 1
    moved = placed.withColumn("delta", F.when(inside, F.col("quoted")).otherwise(F.col("plain"))).withColumn("open", F.col("upto") % 2 == 1)
    deep = running_total(moved.drop("quotes", "plain", "quoted", "upto"), "delta", ["place"], ["file"], "depth")
    # The last sign of a piece is a brace of the text unless a string is open.
    ends = deep.withColumn("ends", F.when((F.col("depth") == 0) & ~F.col("open"), 1).otherwise(0).cast("long"))
    numbered = running_total(ends, "ends", ["place"], ["file"], "number").withColumn("record", F.col("number") - F.col("ends"))
    joined = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"), F.max("ends").alias("whole"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), "}"), F.lit("}"))
    records = joined.filter("whole = 1").select("file", F.col("record").alias("place"), F.regexp_replace(text, r"^[\s\[,]+", "").alias("record"))
    return records


def read_event_log(spark: SparkSession, path: str, schema: T.StructType | str, newest: int | None = None, key: str | None = None) -> DataFrame:
    """JSON lines with a fixed schema.  Lines which are no JSON object are
    skipped, an event id counts once, and ``newest`` keeps the latest rows."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])
    place = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(place.alias("place"), F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"),
                                         F.ltrim("value").alias("raw"))
    events = lines.filter(F.startswith("raw", F.lit("{")) & F.col("e").isNotNull() & F.col("e._corrupt_record").isNull())
    columns = [f.name for f in wanted.fields]
    events = events.select("place", *[F.col("e").getField(c).alias(c) for c in columns])
    if key is not None:
        # The event written first wins: by file time and name, then by line.
        row = F.min_by(F.struct("place", *[quoted(c) for c in columns]), "place").alias("row")
        nameless = events.filter(quoted(key).isNull())
        events = events.filter(quoted(key).isNotNull()).groupBy(quoted(key).alias("__key")).agg(row).select("row.*").unionByName(nameless)
    if newest is not None:
        events = events.orderBy(F.desc("created_at"), *[quoted(c) for c in [key] if c], "place").limit(newest)
    return events.select(*[quoted(c) for c in columns])


def read_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Lines of the named splits of a written corpus.  The test split cannot
    be read here; audits must not see it."""
    if "test" in splits:
        raise ValueError("the test split is closed to audits")
    parts = [spark.read.text(f"{path}/split={s}").select(F.col("value").alias("line"), F.lit(s).alias("split")) for s in splits]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def explode_records(df: DataFrame, column: str, schema: T.StructType | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested JSON text to flat columns, null where absent."""
    fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    parsed = df.withColumn("__j", F.from_json(column, T.StructType(fields)))
    return parsed.select(*keep, *[F.col("__j").getField(f.name).alias(f.name) for f in fields])
