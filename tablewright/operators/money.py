"""Currency conversion against a table of rates (from, to, rate)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.currency import amount, currency_code
from ..functions.names import quoted
from ..functions.parsing import number


def convert_column(df: DataFrame, column: str, rate: float, new_column: str) -> DataFrame:
    return df.withColumn(new_column, number(quoted(column), df.schema[column].dataType) * F.lit(rate))


def convert_by_rates(df: DataFrame, column: str, source: str, target: str, rates: DataFrame, new_column: str) -> DataFrame:
    """Amount × rate(from → to), where ``source`` and ``target`` name code
    columns.  Equal codes keep the amount; a pair without rate gives null."""
    table = rates.select(F.upper("from").alias("__from"), F.upper("to").alias("__to"), F.col("rate").alias("__rate"))
    a, b = F.upper(quoted(source)), F.upper(quoted(target))
    joined = df.join(table, (a == F.col("__from")) & (b == F.col("__to")), "left")
    value = number(quoted(column), df.schema[column].dataType)
    return joined.withColumn(new_column, F.when(a == b, value).otherwise(value * F.col("__rate"))).drop("__from", "__to", "__rate")


def unconverted(df: DataFrame, source: str, target: str, converted: str) -> DataFrame:
    """Rows without a converted amount per currency pair."""
    return df.filter(quoted(converted).isNull()).groupBy(source, target).agg(F.count(F.lit(1)).alias("n"))


def convert_text(df: DataFrame, column: str, target: str, rates: DataFrame, new_column: str) -> DataFrame:
    """Mixed-currency text to one currency.  Text without an amount keeps its
    value, an unknown currency keeps the amount, a missing rate gives null.
    ``<new_column>_changed`` tells whether a rate was applied."""
    tagged = df.withColumns({"__code": currency_code(quoted(column)), "__amount": amount(quoted(column))})
    table = rates.filter(F.upper("to") == target.upper()).select(F.upper("from").alias("__from"), F.col("rate").alias("__rate"))
    joined = tagged.join(table, F.col("__code") == F.col("__from"), "left")
    same = F.col("__code").isNull() | (F.col("__code") == target.upper())
    value = F.when(same, F.col("__amount")).otherwise(F.col("__amount") * F.col("__rate"))
    shown = F.when(F.col("__amount").isNull(), quoted(column).cast("string")).otherwise(value.cast("string"))
    changed = ~same & F.col("__amount").isNotNull() & F.col("__rate").isNotNull()
    return joined.withColumns({new_column: shown, f"{new_column}_changed": changed}).drop("__code", "__amount", "__from", "__rate")
