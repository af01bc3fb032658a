"""Registering tables and analysing the new ones, many files at a time.

Files are brought into one long table (dataset, position, value), a row per
cell, whatever their headers: delimited text of all files is one scan, JSON
records are another, columnar files one per different schema.  Profiles, types,
roles and keys are aggregates over the long table, so a thousand files take as
many jobs as one.  What is known of files and columns is small and travels to
the rows: rows are never dealt by their file, of which there may be few.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import columns_fingerprint, quoted, unique_headers
from ..functions.parsing import double, whole
from ..operators.cleaning import BLANK
from ..operators.profile import distinct_counts, missing
from ..operators.relations import KEY_SUFFIXES, LongColumns, relationships, upgrade_foreign_keys
from ..operators.roles import DEFAULT_RULES, long_measures, roles_of_measures
from ..session import durable, written
from .readers import json_records
from .writers import file_fingerprints

DATASET = "dataset_id string, organization_id string, dataset_name string, path string, schema_hash string, file_hash string, row_count long, column_count int"
#: Files which a writer made as parts of one table.
PART = r"^part-"
SEPARATORS = {"csv": ",", "tsv": "\t", "tab": "\t"}
LINES, RECORDS, COLUMNAR = ("jsonl", "ndjson"), ("json",), ("parquet", "orc")


def new_files(spark: SparkSession, path: str, registry: DataFrame, organization: str) -> DataFrame:
    """(sha256, path, files) of tables whose bytes this organisation has not
    registered yet, one row per content.  The part files of a folder are one
    table, known by the digest of its parts' digests in order of their names."""
    known = registry.filter(F.col("organization_id") == organization).select(F.col("file_hash").alias("sha256"))
    name = F.element_at(F.split("path", "/"), -1)
    table = F.when(name.rlike(PART), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))
    files = file_fingerprints(spark, path).filter(~name.rlike(r"^[._]")).groupBy(table.alias("path")).agg(F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("f"))
    digests = F.transform("f", lambda x: x["sha256"])
    whole = F.when(F.size("f") == 1, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), 256))
    fresh = files.select(whole.alias("sha256"), "path", F.transform("f", lambda x: x["path"]).alias("files")).join(known, "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min(F.struct("path", "files")).alias("t")).select("sha256", "t.*")


def column_profile(df: DataFrame, dataset_id: str) -> DataFrame:
    """(dataset_id, column, kind, missing, missing_percent, distinct)."""
    kinds = df.sparkSession.createDataFrame(df.dtypes, "column string, kind string")
    both = missing(df).join(distinct_counts(df), "column").join(F.broadcast(kinds), "column")
    return both.select(F.lit(dataset_id).alias("dataset_id"), "column", "kind", "missing", "missing_percent", "distinct")


@dataclass
class Table:
    dataset: str
    path: str
    sha256: str
    files: list[str]
    format: str
    columns: list[str] = field(default_factory=list)
    #: Types as far as the files tell them.
    kinds: list[T.DataType | None] = field(default_factory=list)


def _format(table: str, file: str) -> str:
    """By the ending of the table's name, else of its file's."""
    for path in (table, file):
        for part in reversed(path.lower().rstrip("/").rsplit("/", 1)[-1].split(".")[1:]):
            if part in (*SEPARATORS, *LINES, *RECORDS, *COLUMNAR):
                return part
    return "csv"


class LongTable:
    """The cells of many tables in long form, and their columns."""

    def __init__(self, spark: SparkSession, tables: Sequence[Table]) -> None:
        self.spark, self.tables, parts = spark, list(tables), []
        paths = [f for t in tables for f in t.files]
        listed = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file")) if paths else None
        files = [(f, t.dataset, len(t.columns)) for t in tables for f in t.files]
        # How the sources name their files, beside what they belong to.
        self.files = durable(listed.join(spark.createDataFrame([f[:2] for f in files], "path string, dataset string"), "path").select("file", "dataset")) if paths else None
        for separator in sorted(set(SEPARATORS.values())):
            chosen = [t for t in tables if SEPARATORS.get(t.format) == separator]
            if chosen:
                parts.append(self._delimited(chosen, separator))
        for kinds in (LINES, RECORDS):
            chosen = [t for t in tables if t.format in kinds]
            if chosen:
                parts.append(self._json(chosen, kinds == LINES))
        schemas: dict[tuple[str, str], list[Table]] = {}
        for t in tables:
            if t.format in COLUMNAR:
                schema = spark.read.format(t.format).load(t.files[0]).schema
                t.columns, t.kinds = unique_headers(schema.names), [f.dataType for f in schema]
                schemas.setdefault((t.format, schema.json()), []).append(t)
        parts += [self._columnar(chosen) for chosen in schemas.values()]
        long = parts[0] if parts else spark.createDataFrame([], "dataset string, position int, value string")
        for part in parts[1:]:
            long = long.unionByName(part)
        trimmed = F.when(~F.col("value").rlike(BLANK), F.regexp_replace("value", r"^\s+|\s+$", ""))
        self.cells = long.withColumn("value", trimmed)

    def _named(self, rows: DataFrame, chosen: Sequence[Table]) -> DataFrame:
        widths = self.spark.createDataFrame([(t.dataset, len(t.columns)) for t in chosen], "dataset string, width int")
        return rows.join(F.broadcast(self.files.join(F.broadcast(widths), "dataset")), "file")

    def _delimited(self, chosen: Sequence[Table], separator: str) -> DataFrame:
        lines = self.spark.read.text([t.files[0] for t in chosen]).select(
            F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"), "value")
        # The first line of a file lies in its first block.
        heads = lines.filter("place.block = 0").groupBy("file").agg(F.min_by("value", "place").alias("head")).join(self.files, "file").select("dataset", "head").collect()
        heads = {r["dataset"]: r["head"].lstrip("﻿") for r in heads}
        for t in chosen:
            t.columns = unique_headers(next(csv.reader([heads.get(t.dataset, "")], delimiter=separator), []))
            t.kinds = [None] * len(t.columns)
        width = max(len(t.columns) for t in chosen)
        names = [f"_c{i}" for i in range(width)]
        reader = self.spark.read.schema(", ".join(f"{n} string" for n in names)).options(header=True, sep=separator, escape='"', quote='"', enforceSchema=True)
        rows = reader.csv([f for t in chosen for f in t.files]).select(F.array(*names).alias("row"), F.col("_metadata.file_path").alias("file"))
        return self._named(rows, chosen).select("dataset", F.posexplode(F.slice("row", F.lit(1), F.col("width"))).alias("position", "value"))

    def _json(self, chosen: Sequence[Table], lines: bool) -> DataFrame:
        paths = [f for t in chosen for f in t.files]
        if lines:
            texts = self.spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
        else:
            texts = json_records(self.spark, paths).select("file", "record")
        rows = texts.select("file", F.from_json("record", "map<string,string>").alias("row")).filter("row is not null")
        keys = rows.select("file", F.explode(F.map_keys("row")).alias("key")).distinct().join(self.files, "file").select("dataset", "key").distinct().collect()
        for t in chosen:
            t.columns = sorted(r["key"] for r in keys if r["dataset"] == t.dataset)
            t.kinds = [None] * len(t.columns)
        listed = self.spark.createDataFrame([(t.dataset, t.columns) for t in chosen], "dataset string, columns array<string>")
        cells = F.transform("columns", lambda c: F.try_element_at("row", c))
        return rows.join(F.broadcast(self.files.join(F.broadcast(listed), "dataset")), "file").select("dataset", F.posexplode(cells).alias("position", "value"))

    def _columnar(self, chosen: Sequence[Table]) -> DataFrame:
        reader = self.spark.read.format(chosen[0].format)
        rows = reader.load([f for t in chosen for f in t.files])
        row = F.array(*[quoted(c).cast("string") for c in rows.columns])
        rows = rows.select(row.alias("row"), F.col("_metadata.file_path").alias("file"))
        return self._named(rows, chosen).select("dataset", F.posexplode("row").alias("position", "value"))

    def measured(self, found: LongColumns) -> DataFrame:
        """(dataset, position, column, rows, filled, distinct, kind and the
        measures of the role rules), one row per column.

        One scan measures all cells; it tells what each column is, so that a
        second one counts its distinct texts or numbers, whichever it holds.
        """
        value = F.col("value")
        number, count = double(value), whole(value)
        tests = {
            "int": count.between(-(1 << 31), (1 << 31) - 1), "bigint": count.isNotNull(), "double": number.isNotNull(),
            "date": value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull(),
            "timestamp": value.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d") & value.try_cast("timestamp").isNotNull(), "boolean": F.lower(value).isin("true", "false"),
        }
        columns = [(c, p) for t in self.tables for p, c in enumerate(t.columns)]
        sums = {"rows": F.count(F.lit(1)), "filled": F.count(value), **{f"is_{k}": F.count_if(test) for k, test in tests.items()}, **long_measures(DEFAULT_RULES, columns, value)}
        scan = self.cells.groupBy("dataset", "position").agg(*[c.alias(n) for n, c in sums.items()])
        names = [(t.dataset, p, found.ids[t.dataset, c], c, None if k is None else k.simpleString()) for t in self.tables for p, (c, k) in enumerate(zip(t.columns, t.kinds))]
        listed = self.spark.createDataFrame(names, "dataset string, position int, c int, column string, known string")
        kind = F.when(F.coalesce("filled", F.lit(0)) == 0, "string")
        for name in tests:
            kind = kind.when(F.col(f"is_{name}") == F.col("filled"), name)
        both = listed.join(scan, ["dataset", "position"], "left").withColumn("kind", F.coalesce("known", kind.otherwise("string")))
        numeric = F.col("kind").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.startswith("kind", F.lit("decimal"))
        both = durable(both.withColumn("numeric", numeric))
        # Numbers are the same in any writing: 1 and 1.0, 7 and 007.
        exact = F.coalesce(count.cast("string"), number.cast("string"), value)
        as_number = F.when(F.abs(number) < float(1 << 53), number.cast("string")).otherwise(exact)
        distinct = found.distinct_counts({r["c"] for r in both.filter("numeric").select("c").collect()}, as_number)
        zero = {n: F.coalesce(n, F.lit(0)) for n in ("rows", "filled", "distinct")}
        return both.join(distinct, "c", "left").withColumns(zero).drop("c", "numeric")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def ingest(spark: SparkSession, path: str, registry: DataFrame, organization: str, suffixes: Sequence[str] = KEY_SUFFIXES):
    """Register the new tables of a folder: (datasets, columns, roles,
    relationships).  Known ones skip analysis.

    The driver sees names, headers and a few numbers per column.  A table of
    delimited text has its header in the first line of each of its files.
    Types are the narrowest which all filled cells of a column can be read as.
    """
    rows = new_files(spark, path, registry, organization).orderBy("path").collect()
    tables = [Table(r["sha256"][:16], r["path"], r["sha256"], list(r["files"]), _format(r["path"], r["files"][0])) for r in rows]
    if not tables:
        return spark.createDataFrame([], DATASET), None, None, None
    long = LongTable(spark, tables)
    long.cells = written(long.cells, "cells")
    found = LongColumns({t.dataset: t.columns for t in tables}, long.cells)
    measured = durable(long.measured(found))
    numbers = {(r["dataset"], r["position"]): r for r in measured.select("dataset", "position", "rows", "kind").collect()}
    datasets, columns = [], []
    for t in tables:
        kinds = [numbers[t.dataset, p]["kind"] for p in range(len(t.columns))]
        size = numbers[t.dataset, 0]["rows"] if t.columns else 0
        datasets.append((t.dataset, organization, t.path.rsplit("/", 1)[-1], t.path, columns_fingerprint(list(zip(t.columns, kinds))), t.sha256, size, len(t.columns)))
        columns += [(t.dataset, c, p, T._parse_datatype_string(k)) for p, (c, k) in enumerate(zip(t.columns, kinds))]
    gaps = F.col("rows") - F.col("filled")
    profile = measured.select(F.col("dataset").alias("dataset_id"), "column", "kind", gaps.alias("missing"), _percent(gaps, F.col("rows")).alias("missing_percent"), "distinct")
    links = relationships(found, suffixes=suffixes)
    return spark.createDataFrame(datasets, DATASET), profile, upgrade_foreign_keys(roles_of_measures(measured, columns), links), links
