"""Numeric ranges and date parts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.parsing import timestamp

NUMBER = r"(-?\d+(?:\.\d+)?)"
OUTSIDE = "Out of Range"


@dataclass(frozen=True)
class Range:
    """One labelled range; ``None`` is no bound.  Ends belong to the range
    except the named limit of "above" and "below"."""

    label: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False

    @classmethod
    def parse(cls, token: str) -> Range:
        text = token.strip()
        if m := re.fullmatch(rf"{NUMBER}\s*(?:-|–|to)\s*{NUMBER}", text, re.I):
            low, high = float(m[1]), float(m[2])
            if low >= high:
                raise ValueError(f"range {text!r} ends before it starts")
            return cls(text, low, high)
        if m := re.fullmatch(rf"{NUMBER}\s*\+", text):
            return cls(text, low=float(m[1]))
        if m := re.fullmatch(rf"(?:above|over|greater than|more than)\s+{NUMBER}", text, re.I):
            return cls(text, low=float(m[1]), low_open=True)
        if m := re.fullmatch(rf"(?:below|under|less than)\s+{NUMBER}", text, re.I):
            return cls(text, high=float(m[1]), high_open=True)
        raise ValueError(f"cannot read range {text!r}")

    def holds(self, value: Column) -> Column:
        test = F.lit(True)
        if self.low is not None:
            test = test & ((value > self.low) if self.low_open else (value >= self.low))
        if self.high is not None:
            test = test & ((value < self.high) if self.high_open else (value <= self.high))
        return test


def parse_ranges(tokens: list[str]) -> list[Range]:
    """Ranges in ascending order without overlap, or an error."""
    if not tokens:
        raise ValueError("at least one range is needed")
    ranges = [Range.parse(t) for t in tokens]
    for left, right in zip(ranges, ranges[1:]):
        if right.low is None or (left.low is not None and right.low < left.low):
            raise ValueError("the ranges are not in ascending order")
        if left.high is None or right.low < left.high:
            raise ValueError(f"ranges {left.label!r} and {right.label!r} overlap")
    return ranges


def range_table(df: DataFrame, tokens: list[str]) -> DataFrame:
    """The ranges as rows (low, high, open flags, label)."""
    rows = [(r.low, r.high, r.low_open, r.high_open, r.label) for r in parse_ranges(tokens)]
    return df.sparkSession.createDataFrame(rows, "low double, high double, low_open boolean, high_open boolean, label string")


def auto_bins(df: DataFrame, column: str, bins: int = 5) -> list[Range]:
    """Equal widths over min..max, with exact edges: every value has a bin.

    Labels show whole numbers for whole data, else two decimals, or as many
    digits as it takes to tell the edges apart.
    """
    v = quoted(column)
    whole = F.every(F.round(v.cast("double")) == v.cast("double"))
    low, high, is_whole = df.agg(F.min(v.cast("double")), F.max(v.cast("double")), whole).first()
    if low is None:
        raise ValueError(f"{column!r} has no values")
    if low == high:
        raise ValueError(f"{column!r} is constant")
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    forms = [lambda e: str(round(e)) if is_whole and step >= 1 else f"{round(e, 2):g}", *[lambda e, d=d: f"{e:.{d}g}" for d in (8, 12, 17)]]
    shown = next(s for s in ([form(e) for e in edges] for form in forms) if len(set(s)) == len(s))
    return [Range(f"{a}-{b}", low, high) for a, b, low, high in zip(shown, shown[1:], edges, edges[1:])]


def auto_ranges(df: DataFrame, column: str, bins: int = 5) -> list[str]:
    """The labels of ``auto_bins``."""
    return [r.label for r in auto_bins(df, column, bins)]


def range_label(value: Column, ranges: list[Range]) -> Column:
    """Lowest range which holds the value; null stays null."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for r in ranges:
        label = label.when(r.holds(value), F.lit(r.label))
    return label.otherwise(F.lit(OUTSIDE))


def bin_column(df: DataFrame, column: str, ranges: list[str] | None = None, new_column: str | None = None) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"there is no column {column!r}")
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"{column!r} is not numeric")
    parsed = parse_ranges(ranges) if ranges else auto_bins(df, column)
    base = name = new_column or f"{column}_Range"
    n = 2
    while name in df.columns:
        name, n = f"{base}_{n}", n + 1
    return df.withColumn(name, range_label(quoted(column), parsed))


def bin_counts(df: DataFrame, column: str, ranges: list[str] | None = None) -> DataFrame:
    """Rows per range."""
    binned = bin_column(df, column, ranges)
    label = [c for c in binned.columns if c not in df.columns][0]
    return binned.groupBy(F.col(label).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "weekday": lambda c: F.date_format(c, "EEEE"),
    "quarter": F.quarter,
    "week": F.weekofyear,
}


def date_features(df: DataFrame, column: str, features: list[str]) -> DataFrame:
    """Columns ``<column>_<feature>``; text which is no date gives null."""
    unknown = [f for f in features if f not in DATE_PARTS]
    if unknown:
        raise ValueError(f"unknown date features {unknown}; there are {list(DATE_PARTS)}")
    moment = timestamp(quoted(column), df.schema[column].dataType)
    return df.select("*", *[DATE_PARTS[f](moment).alias(f"{column}_{f}") for f in features])


def month_label(value: Column) -> Column:
    return F.date_format(value, "MMMM")


def date_validity(df: DataFrame, column: str) -> DataFrame:
    """Share of filled cells which are dates, and how many are not."""
    kind = df.schema[column].dataType
    filled = quoted(column).isNotNull() & (F.trim(quoted(column).cast("string")) != "")
    good = filled & timestamp(quoted(column), kind).isNotNull()
    one = df.agg(F.count_if(filled).alias("filled"), F.count_if(good).alias("valid"))
    return one.select(
        F.lit(column).alias("column"), "filled", (F.col("filled") - F.col("valid")).alias("invalid"),
        F.coalesce(F.try_divide("valid", "filled"), F.lit(0.0)).alias("valid_ratio"),
    )
