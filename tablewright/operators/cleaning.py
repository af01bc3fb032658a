"""Missing values, duplicates, text and outliers of a whole table.

Fill values and bounds are a few numbers per column: they are computed with
aggregates over all columns at once and then used as literals, so the row work
stays one narrow projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arithmetic import arithmetic
from ..functions.names import numeric_columns, quoted, text_columns
from ..functions.parsing import BLANK, is_missing, number, squeezed, timestamp
from ..session import durable
from . import ordered
from .profile import row_groups, value_counts
from .quantiles import quantiles

UNKNOWN = "Unknown"


def blank_to_null(df: DataFrame) -> DataFrame:
    """Trim every text column; empty or invisible text becomes null, and NaN
    becomes null in the number columns."""
    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.rlike(BLANK), F.regexp_replace(c, r"^\s+|\s+$", ""))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cells.append(c.alias(f.name))
    return df.select(*cells)


def column_kinds(df: DataFrame) -> dict[str, str]:
    """empty, numeric, datetime, categorical or text, per column."""
    return {r["column"]: r["kind"] for r in kind_table(df).collect()}


def kind_table(df: DataFrame) -> DataFrame:
    """(column, kind, mode) per column.  Distinct values are parsed once, and
    the most frequent one falls out of the same job."""
    fixed = {f.name: "numeric" for f in df.schema if isinstance(f.dataType, T.NumericType)}
    fixed |= {f.name: "datetime" for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))}
    counts = value_counts(df, df.columns)
    value = F.col("value")
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct"), F.every(number(value).isNotNull()).alias("numbers"),
        F.every(timestamp(value).isNotNull()).alias("dates"), F.min_by("value", _mode_place(df)).alias("mode"),
    )
    few = (F.col("distinct") <= 10) | (F.col("distinct") / F.col("filled") < 0.05)
    kind = F.when(F.col("filled").isNull(), "empty")
    for name, known in fixed.items():
        kind = kind.when(F.col("column") == name, known)
    kind = kind.when(F.col("numbers"), "numeric").when(F.col("dates"), "datetime").when(few, "categorical").otherwise("text")
    listed = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return listed.join(stats, "column", "left").select("column", kind.alias("kind"), "mode")


def _mode_place(df: DataFrame) -> Column:
    """Order of (column, value, n) rows: most frequent, then smallest."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    as_number = F.when(F.col("column").isin(numeric), F.col("value").try_cast("double"))
    return F.struct(-F.col("n"), as_number, F.col("value"))


def text_kinds(df: DataFrame) -> dict[str, str]:
    texts = text_columns(df)
    return column_kinds(df.select(*[quoted(c) for c in texts])) if texts else {}


def to_inferred_types(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Text columns whose every value is a number or a time get that type."""
    kinds = text_kinds(df) if kinds is None else kinds
    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if kinds.get(f.name) == "numeric":
            c = number(c)
        elif kinds.get(f.name) == "datetime":
            c = timestamp(c)
        cells.append(c.alias(f.name))
    return df.select(*cells)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value as text; the smallest one on ties."""
    if not columns:
        return {}
    picked = value_counts(df, columns).groupBy("column").agg(F.min_by("value", _mode_place(df)).alias("value")).collect()
    found = {r["column"]: r["value"] for r in picked}
    return {c: found.get(c) for c in columns}


def fill_values(df: DataFrame, strategy: str, columns: Sequence[str], custom=None) -> tuple[dict[str, object], list[tuple]]:
    """(fill value per column, report rows).  Report rows are (column,
    missing, used, value); columns without gaps are left out."""
    gaps = {c: is_missing(quoted(c), df.schema[c].dataType) for c in columns}
    row = df.agg(F.count(F.lit(1)), *[F.count_if(g) for g in gaps.values()]).first()
    total, counts = row[0], dict(zip(columns, row[1:]))
    gappy = [c for c in columns if counts[c]]
    if strategy == "custom":
        if custom is None:
            raise ValueError("a custom fill needs a value")
        return {c: custom for c in gappy}, [(c, counts[c], "custom", str(custom)) for c in gappy]

    live = [c for c in gappy if counts[c] < total]
    kind_of = {c: df.schema[c].dataType for c in live}
    numeric = [c for c in live if isinstance(kind_of[c], T.NumericType)]
    times = [c for c in live if isinstance(kind_of[c], (T.TimestampType, T.TimestampNTZType, T.DateType))]
    texts = [c for c in live if c not in numeric and c not in times]
    how: dict[str, str] = {}
    if strategy == "smart":
        facts = {r["column"]: r for r in kind_table(df.select(*[F.when(~gaps[c], quoted(c)).alias(c) for c in texts])).collect()} if texts else {}
        how = {c: "median" for c in numeric} | {c: "median_datetime" for c in times}
        how |= {c: "text_mode" if facts[c]["kind"] == "categorical" else "placeholder" for c in texts}
    elif strategy in ("mean", "median"):
        how = {c: strategy if c in numeric else "placeholder" for c in live}
    elif strategy == "mode":
        how = {c: "mode" for c in live}
    else:
        raise ValueError(f"unknown fill strategy {strategy!r}")

    picked = lambda used: [c for c in live if how[c] == used]
    values: dict[str, object] = {c: q[0] for c, q in quantiles(df, picked("median"), [0.5]).items()}
    if picked("mean"):
        means = df.agg(*[F.avg(number(quoted(c), kind_of[c])) for c in picked("mean")]).first()
        values |= dict(zip(picked("mean"), means))
    if picked("median_datetime"):
        micros = df.select(*[F.unix_micros(quoted(c).cast("timestamp")).alias(c) for c in picked("median_datetime")])
        middles = quantiles(micros, picked("median_datetime"), [0.5])
        values |= {c: F.timestamp_micros(F.lit(int(q[0]))) for c, q in middles.items()}
    values |= modes(df.select(*[F.when(~gaps[c], quoted(c)).alias(c) for c in picked("mode")]), picked("mode")) if picked("mode") else {}
    values |= {c: facts[c]["mode"] for c in picked("text_mode")}
    # A placeholder word fits text only; other columns keep their gaps.
    values |= {c: UNKNOWN for c in picked("placeholder") if isinstance(kind_of[c], T.StringType)}
    shown = lambda v: None if isinstance(v, Column) else str(v)
    report = [(c, counts[c], how[c].removeprefix("text_"), shown(values.get(c))) for c in live if c in values]
    report += [(c, counts[c], "dropped", None) for c in gappy if c not in live]
    return {c: v for c, v in values.items() if v is not None}, report


def fill_missing(df: DataFrame, strategy: str = "smart", columns: Sequence[str] | None = None, custom=None) -> DataFrame:
    """Fill gaps (null, NaN, blank text) by mean, median, mode, a literal or
    by what suits the column.  Columns without any value stay as they are,
    except under ``custom``."""
    values, _ = fill_values(df, strategy, list(columns or df.columns), custom)
    return apply_fill(df, values)


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if f.name in values:
            new = values[f.name]
            fill = new if isinstance(new, Column) else F.lit(new)
            whole = isinstance(f.dataType, T.IntegralType) and isinstance(new, float) and new != int(new)
            fill = fill if whole else fill.cast(f.dataType)
            c = F.when(is_missing(c, f.dataType), fill).otherwise(c)
        cells.append(c.alias(f.name))
    return df.select(*cells)


def forward_fill(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Last value before the gap; leading gaps in text become "Unknown"."""
    columns = list(columns or [c for c in df.columns if c not in order and c not in keys])
    filled = ordered.forward_fill(df, columns, order, keys)
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return filled.fillna({c: UNKNOWN for c in texts}) if texts else filled


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    for c in columns or df.columns:
        keep = keep & ~is_missing(quoted(c), df.schema[c].dataType)
    return df.filter(keep)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def drop_sparse_rows(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop rows in which more than this share of the cells is null."""
    gaps = sum((F.when(quoted(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.filter(gaps / F.lit(len(df.columns)) <= F.lit(float(threshold)))


def normalise_text(df: DataFrame) -> DataFrame:
    return df.select(*[(squeezed(quoted(f.name)) if isinstance(f.dataType, T.StringType) else quoted(f.name)).alias(f.name) for f in df.schema])


def text_changes(df: DataFrame) -> DataFrame:
    """How many cells of each text column the normalising changes."""
    columns = text_columns(df)
    one = df.agg(*[F.count_if(squeezed(quoted(c)) != quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("changed")) for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


def remove_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", order: Sequence | None = None
) -> DataFrame:
    """One row per distinct key (first or last in ``order``) or, with
    ``keep=False``, only the rows without a twin.  Nulls equal each other.

    Without ``order`` the rows of a key are ordered by their other columns.
    """
    if keep not in ("first", "last", False, "none"):
        raise ValueError("keep is 'first', 'last' or False")
    keys = list(subset or df.columns)
    unknown = [c for c in keys if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {unknown}")
    if keep in (False, "none"):
        return ordered.group_value(df, keys, {"__copies": F.count(F.lit(1))}).filter("__copies = 1").drop("__copies")
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates()
    order = [o if isinstance(o, tuple) else (o, False) for o in (order or rest)]
    if keep == "last":
        order = [(name, not down) for name, down in order]
    # row_number() = 1 is cut to one row per key in each task before the
    # shuffle, so a key with very many copies stays cheap.
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*ordered.sort_keys(order))
    return df.withColumn("__row", F.row_number().over(window)).filter("__row = 1").drop("__row")


def iqr_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> dict[str, tuple[float, float]]:
    cuts = quantiles(df, columns, [0.25, 0.75])
    return {c: (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)) for c, (q1, q3) in cuts.items() if q1 is not None}


def zscore_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 3.0, ddof: int = 0) -> dict[str, tuple[float, float]]:
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[e for c in columns for e in (F.avg(quoted(c)), spread(quoted(c)))]).first()
    pairs = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return {c: (m - threshold * s, m + threshold * s) for c, (m, s) in pairs.items() if s}


Bounds = dict[str, tuple[float, float]]


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, bounds: Bounds | None = None) -> DataFrame:
    bounds = iqr_bounds(df, list(columns or numeric_columns(df)), multiplier) if bounds is None else bounds
    capped = {
        c: F.when(quoted(c).isNotNull(), F.least(F.greatest(quoted(c).cast("double"), F.lit(lo)), F.lit(hi)))
        for c, (lo, hi) in bounds.items()
    }
    return df.withColumns(capped)


def _inside(column: str, low: float, high: float) -> Column:
    return F.coalesce(quoted(column).between(low, high), F.lit(True))


def remove_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, sequential: bool = False, bounds: Bounds | None = None
) -> DataFrame:
    """Drop rows outside the bounds; nulls stay.  ``sequential`` recomputes
    the bounds on the rows left by the columns before (one pass each)."""
    columns = list(columns or numeric_columns(df))
    if sequential:
        for c in columns:
            df = remove_outliers(df, [c], multiplier)
        return df
    bounds = iqr_bounds(df, columns, multiplier) if bounds is None else bounds
    for c, (lo, hi) in bounds.items():
        df = df.filter(_inside(c, lo, hi))
    return df


def mark_outliers(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, bounds: Bounds | None = None) -> DataFrame:
    bounds = iqr_bounds(df, list(columns or numeric_columns(df)), multiplier) if bounds is None else bounds
    return df.withColumns({f"{c}_is_outlier": ~_inside(c, lo, hi) for c, (lo, hi) in bounds.items()})


def quick_clean(df: DataFrame, drop_duplicates: bool = True, numeric: str = "median") -> tuple[DataFrame, DataFrame]:
    """Drop duplicate rows, fill numbers by median (or mean) and the rest by
    "Unknown".  Returns the table and a one-row report."""
    # Several statistics follow, so the shuffle is not repeated for each.
    rows = durable(df.dropDuplicates()) if drop_duplicates else df
    numbers = numeric_columns(df)
    values, filled = fill_values(rows, numeric, numbers) if numbers else ({}, [])
    texts = {c: UNKNOWN for c in text_columns(df)}
    clean = rows.select(*[
        (F.coalesce(quoted(f.name), F.lit(UNKNOWN)) if f.name in texts
         else F.coalesce(quoted(f.name), F.lit(values[f.name]).cast(f.dataType)) if f.name in values
         else quoted(f.name)).alias(f.name)
        for f in df.schema
    ])
    gaps = sum((F.when(quoted(c).isNull(), 1).otherwise(0) for c in texts), F.lit(0))
    groups = row_groups(df)
    per_group = F.lit(1) if drop_duplicates else F.col("copies")
    report = groups.agg(
        F.sum("copies").alias("rows_before"), F.sum(per_group).cast("long").alias("rows_after"),
        F.sum(gaps * per_group).cast("long").alias("text_cells_filled"),
        F.lit(sum(r[1] for r in filled if r[2] != "dropped")).cast("long").alias("number_cells_filled"),
    )
    return clean, report


def back_solve(df: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Fill a missing operand from the others, e.g. quantity by
    ``{"quantity": "total / price"}``; only gaps are written."""
    new = {c: F.coalesce(quoted(c), arithmetic(e, df.columns).try_cast(df.schema[c].dataType)) for c, e in inverse.items()}
    return df.withColumns(new)


def change_counts(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Changed cells per shared column, and rows with any change, over the
    rows both tables have."""
    shared = [c for c in before.columns if c in after.columns and c not in key]
    right = after.select(*[quoted(k) for k in key], *[quoted(c).alias(f"__new_{c}") for c in shared])
    joined = ordered.join_on(before, right, key, "inner")
    differs = {c: ~quoted(c).eqNullSafe(quoted(f"__new_{c}")) for c in shared}
    any_change = F.lit(False)
    for d in differs.values():
        any_change = any_change | d
    one = joined.agg(F.count_if(any_change).alias("any"), *[F.count_if(d).alias(f"n{i}") for i, d in enumerate(differs.values())])
    rows = [F.struct(F.lit("(any column)").alias("column"), F.col("any").alias("changed"))]
    rows += [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("changed")) for i, c in enumerate(differs)]
    return one.select(F.inline(F.array(*rows)))


def row_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only one table has, copies counted: (side, …columns)."""
    removed = before.exceptAll(after.select(*before.columns)).withColumn("side", F.lit("removed"))
    return removed.unionByName(after.select(*before.columns).exceptAll(before).withColumn("side", F.lit("added")))
