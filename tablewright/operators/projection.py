"""Column transformations: rename, drop, merge, split, convert, compute."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.arithmetic import arithmetic
from ..functions.names import quoted
from ..functions.parsing import number, timestamp, truth


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    _need(df, mapping)
    taken = [new for old, new in mapping.items() if new in df.columns and new != old]
    if taken or len(set(mapping.values())) < len(mapping):
        raise ValueError(f"names already in use: {taken or list(mapping.values())}")
    return df.withColumnsRenamed(mapping)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _need(df, columns)
    if not set(df.columns) - set(columns):
        raise ValueError("a table needs at least one column")
    return df.drop(*columns)


def merge_columns(df: DataFrame, columns: Sequence[str], separator: str = " ", new_column: str | None = None) -> DataFrame:
    """Texts joined in order; a null counts as empty text."""
    if len(columns) < 2:
        raise ValueError("merging needs two columns or more")
    _need(df, columns)
    parts = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn(new_column or "_".join(columns), F.concat_ws(separator, *parts))


#: Columns which the widest row may ask for.
MOST_PARTS = 500


def split_column(df: DataFrame, column: str, delimiter: str, parts: int | None = None) -> DataFrame:
    """``column_part1 … n`` by a literal delimiter; n is that of the widest
    row (one small aggregate) unless given.  Absent parts are null.  A row of
    more than MOST_PARTS parts is refused rather than made a plan of that
    width; ``parts`` keeps the first ones of any row."""
    _need(df, [column])
    if not delimiter:
        raise ValueError("a delimiter is needed")
    pieces = F.split(quoted(column).cast("string"), re.escape(delimiter))
    if parts is None:
        parts = df.agg(F.max(F.size(pieces))).first()[0] or 1
        if parts > MOST_PARTS:
            raise ValueError(f"the widest row of {column!r} has {parts} parts, more than {MOST_PARTS}; say how many are wanted")
    return df.select("*", *[F.get(pieces, F.lit(i)).alias(f"{column}_part{i + 1}") for i in range(max(parts, 1))])


def converted(value: Column, kind: T.DataType, target: str) -> Column:
    if target == "int":
        return F.rint(number(value, kind)).try_cast("long")  # half to even
    if target == "float":
        return number(value, kind)
    if target in ("string", "str", "category"):
        return value.cast("string")
    if target in ("datetime", "date"):
        return timestamp(value, kind)
    if target == "bool":
        return truth(value)
    raise ValueError(f"unknown type {target!r}")


def convert_type(df: DataFrame, column: str, target: str) -> DataFrame:
    _need(df, [column])
    return df.withColumn(column, converted(quoted(column), df.schema[column].dataType, target))


def conversion_failures(df: DataFrame, column: str, target: str) -> DataFrame:
    """How many filled values the conversion cannot read."""
    _need(df, [column])
    new = converted(quoted(column), df.schema[column].dataType, target)
    lost = F.count_if(new.isNull() & quoted(column).isNotNull())
    return df.agg(F.lit(column).alias("column"), F.lit(target).alias("target"), F.count(quoted(column)).alias("filled"), lost.alias("failed"))


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*names.unique_headers([names.standard_name(c) for c in df.columns]))


def clean_headers(df: DataFrame, case: str | None = "lower", trim: bool = True, blank: str | None = "_") -> DataFrame:
    return df.toDF(*[names.header_name(c, case, trim, blank) for c in df.columns])


def computed_column(df: DataFrame, new_column: str, expression: str) -> DataFrame:
    return df.withColumn(new_column, arithmetic(expression, df.columns))


SIGNS = {
    "=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "≠": lambda a, b: a != b,
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "≥": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b, "≤": lambda a, b: a <= b,
}


def check_column(
    df: DataFrame, new_column: str, left: str, right: str, operator: str = "=", tolerance: float | None = None,
    match: str = "Match", mismatch: str = "Mismatch",
) -> DataFrame:
    """Label each row by comparing two expressions.  With a tolerance, equal
    means no further apart than it; a null on either side is a mismatch."""
    a, b = arithmetic(left, df.columns), arithmetic(right, df.columns)
    if operator not in SIGNS:
        raise ValueError(f"unknown operator {operator!r}")
    if tolerance is not None and operator in ("=", "==", "!=", "≠"):
        near = F.abs(a - b) <= F.lit(float(tolerance))
        test = near if operator in ("=", "==") else ~near
    else:
        test = SIGNS[operator](a, b)
    return df.withColumn(new_column, F.when(test, match).otherwise(mismatch))


def keep_allowed(df: DataFrame, payload: str, schema: T.StructType | str) -> DataFrame:
    """Reduce a JSON payload to an allow-listed structure at every depth."""
    return df.withColumn(payload, F.to_json(F.from_json(quoted(payload), schema)))


def finite(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities as null and decimals as doubles, at any depth of
    arrays, maps and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite(x, kind.valueType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(value.isNotNull(), F.struct(*[finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value.cast("double") if isinstance(kind, T.DecimalType) else value


def json_safe(df: DataFrame) -> DataFrame:
    """Rows as JSON text in column ``json``: NaN and infinities null, nulls
    written, decimals as doubles, nested values included."""
    cells = [finite(quoted(f.name), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def _need(df: DataFrame, columns) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"no such column: {gone}")
