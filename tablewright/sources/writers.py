"""Sinks and checksum manifests.  All writes are plain Spark writes, so a
lost executor only repeats its tasks."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..operators.projection import finite, json_safe


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV and Parquet agree."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(quoted(f.name)) if isinstance(f.dataType, nested) else quoted(f.name)).alias(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _flat(df).write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = "split") -> None:
    """JSON lines, one folder per split."""
    if by is None:
        json_safe(df).write.mode(mode).text(path)
        return
    rest = df.drop(by)
    safe = [finite(quoted(f.name), f.dataType).alias(f.name) for f in rest.schema]
    lines = df.select(quoted(by), F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode(mode).partitionBy(by).text(path)


#: Bytes of a file which are read as one row; longer files go by ranges.
RANGE_BYTES = 64 << 20


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of every data file below a folder.

    A file of more than RANGE_BYTES is read range by range, each by a task of
    its own, and its fingerprint is the SHA-256 of its ranges' digests (lower
    hex, in order); a shorter one has the SHA-256 of its bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    bounded = files.filter(F.col("length") <= RANGE_BYTES).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    listed = [re.sub("^file:/+", "file:/", unquote(name)) for name in files.inputFiles()]
    if len(listed) > files.select("path").count():
        # A file without bytes is listed but gives no row.
        empty = spark.createDataFrame([(name,) for name in listed], "path string").join(files.select("path"), "path", "left_anti")
        bounded = bounded.unionByName(empty.select("path", F.sha2(F.lit(""), 256).alias("sha256"), F.lit(0).cast("long").alias("bytes")))
    # Only names and lengths are read here.
    long = files.filter(F.col("length") > RANGE_BYTES).select("path", F.col("length").alias("bytes"))
    if long.isEmpty():
        return bounded
    offsets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("offset")
    ranges = long.select("path", "bytes", offsets).repartition("path", "offset")
    digests = ranges.mapInArrow(_range_digests(RANGE_BYTES), "path string, bytes long, offset long, digest string")
    listed = digests.groupBy("path", "bytes").agg(F.sort_array(F.collect_list(F.struct("offset", "digest"))).alias("d"))
    whole = F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), ""), 256)
    return bounded.unionByName(listed.select("path", whole.alias("sha256"), "bytes"))


def _range_digests(length: int, piece: int = 4 << 20):
    """A task's function: the digest of each (path, bytes, offset) range, read
    piece by piece."""

    def opened(path: str):
        scheme, _, rest = path.partition(":")
        if scheme == "file" or not rest:
            return pyarrow.fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
        system, name = pyarrow.fs.FileSystem.from_uri(path)
        return system.open_input_file(name)

    def run(batches):
        for batch in batches:
            digests = []
            for row in batch.to_pylist():
                state, left = hashlib.sha256(), min(length, row["bytes"] - row["offset"])
                with opened(row["path"]) as source:
                    source.seek(row["offset"])
                    while left:
                        read = source.read(min(piece, left))
                        if not read:
                            raise OSError(f"{row['path']} is shorter than it was")
                        state.update(read)
                        left -= len(read)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "bytes", "offset", "digest"])

    return run


def create_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints with paths relative to the folder."""
    root = path.rstrip("/")
    relative = F.regexp_replace("path", rf"^(?:file:)?/*\Q{root.lstrip('/')}\E/", "")
    return file_fingerprints(spark, path).select(relative.alias("path"), "sha256", "bytes")


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, problem) for files which are missing, changed or unexpected."""
    return compared_manifests(manifest, create_manifest(spark, path))


def compared_manifests(known: DataFrame, now: DataFrame) -> DataFrame:
    """(path, problem) of what two manifests do not agree on."""
    joined = known.select("path", "sha256").join(now.select("path", F.col("sha256").alias("__now")), "path", "full_outer")
    problem = F.when(F.col("__now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("sha256") != F.col("__now"), "changed")
    return joined.select("path", problem.alias("problem")).filter("problem is not null")
