"""Helpers shared by the operators: shared folder, Arrow columns, hot joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_folder, durable

__all__ = ["durable", "shared_folder", "quoted", "with_arrow_columns", "TEXT_ROWS", "row_keys", "free_names"]

#: Texts handed to one call of a column function; bounds the arrays it holds.
TEXT_ROWS = 256

TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns which no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = f"_{name}"
        return name

    return [free(name) for name in wanted]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one which the cluster shares."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_arrow_columns(df: DataFrame, source: str, added: dict[str, str], fill: Callable[[list[str | None]], dict[str, list]],
                       keep: Callable[[dict[str, list], int], bool] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (name to SQL type), made from the texts
    of ``source`` by ``fill``, which gets lists of at most TEXT_ROWS texts.

    A column of ``df`` which has the name of an added one gives way to it.
    With ``keep`` the rows for which it is false are dropped and no column is
    added.  Rows are never moved between tasks.
    """
    taken = {name.lower() for name in added}
    rest = [f for f in df.schema.fields if keep is not None or f.name.lower() not in taken]
    fields = list(rest)
    if keep is None:
        fields += [T.StructField(name, TYPES[kind]) for name, kind in added.items()]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    names = [f.name for f in rest]
    at_source = df.columns.index(source)
    at_rest = [i for i, f in enumerate(df.schema.fields) if keep is not None or f.name.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(start, TEXT_ROWS)
                made = fill(part.column(at_source).to_pylist())
                columns = [part.column(i) for i in at_rest]
                if keep is not None:
                    chosen = pa.array([keep(made, i) for i in range(part.num_rows)], pa.bool_())
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(chosen)
                else:
                    columns += [pa.array(made[name], arrow[kind]) for name, kind in added.items()]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return df.mapInArrow(run, T.StructType(fields))


def row_keys(id_column: str, text_column: str) -> tuple[Column, Column]:
    """The two parts of a document's identity: rows which share both are
    repeats of one document; null ids fall apart by their texts."""
    return F.col(quoted(id_column)), F.xxhash64(F.col(quoted(text_column)))
