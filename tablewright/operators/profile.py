"""Profiles: describe, missing, distinct, duplicates, quality, correlation.

Aggregates over several columns are collected in one pass and turned to long
form from the single result row.  Counts of distinct values go through one
(column, value) table with map-side combine, so a hot value costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import alias_of, numeric_columns, quoted, resolve, text_columns
from ..functions.parsing import is_missing, number, timestamp
from ..session import durable
from .bitfilter import BitFilter
from .quantiles import quantiles

# Words in a header which announce a date column.
DATE_NAME_HINTS = ["date", "time", "timestamp", "datetime", "dob", "created", "updated", "modified"]
BOOLEAN_LIKE = ["yes", "no", "y", "n", "true", "false", "0", "1", "on", "off", "enabled", "disabled",
                "available", "not available", "open", "closed"]


def long_form(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Several output rows built from the columns of a one-row table."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


def describe(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per column."""
    columns = list(columns or numeric_columns(df))
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], approximate=approximate)
    expressions = []
    for i, c in enumerate(columns):
        v = number(quoted(c), df.schema[c].dataType)
        expressions += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                        F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    rows = []
    for i, c in enumerate(columns):
        std = F.when(F.col(f"n{i}") == 1, 0.0).when(F.col(f"n{i}") > 1, F.col(f"std{i}"))
        rows.append({"column": F.lit(c), "count": F.col(f"n{i}"), "mean": F.col(f"mean{i}"), "std": std,
                     "min": F.col(f"min{i}"),
                     **{n: F.lit(q).cast("double") for n, q in zip(("q1", "median", "q3"), cuts[c])},
                     "max": F.col(f"max{i}")})
    return long_form(df.agg(*expressions), rows)


def missing(df: DataFrame) -> DataFrame:
    """Null cells per column, as count and percent of rows."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    share = lambda i: F.when(F.col("n") > 0, F.col(f"m{i}") * 100.0 / F.col("n")).otherwise(F.lit(0.0))
    return long_form(
        one, [{"column": F.lit(c), "missing": F.col(f"m{i}"), "missing_percent": share(i)} for i, c in enumerate(df.columns)]
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over the non-null cells, values as text."""
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])).alias("cell")
    )
    return cells.select("cell.*").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column (by its place) and distinct non-null text, which a
    hash of 128 bits stands for: no text is shuffled, however long."""
    made = []
    for i, c in enumerate(columns):
        text = quoted(c).cast("string")
        made.append(F.when(text.isNotNull(), F.struct(F.lit(i).alias("c"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))))
    return df.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("cell")).select("cell.*").distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    columns = list(columns or df.columns)
    if approximate:
        one = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    else:
        one = distinct_cells(df, columns).agg(*[F.count_if(F.col("c") == i).alias(f"d{i}") for i in range(len(columns))])
    return long_form(one, [{"column": F.lit(c), "distinct": F.col(f"d{i}")} for i, c in enumerate(columns)])


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each text column, ties by value."""
    counts = value_counts(df, list(columns or text_columns(df)))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct, most frequent value and its count per text column,
    on the table without duplicate rows (numeric profiles keep them)."""
    numeric = set(numeric_columns(df))
    columns = list(columns or [c for c in df.columns if c not in numeric])
    counts = value_counts(df.dropDuplicates(), columns)
    # Greatest (n, then smallest value): two partial aggregates, no window.
    best = F.max("n")
    stats = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("freq"))
    firsts = counts.groupBy("column", "n").agg(F.min("value").alias("top"))
    return stats.join(firsts.withColumnRenamed("n", "freq"), ["column", "freq"]).select("column", "count", "unique", "top", "freq")


def row_groups(df: DataFrame, columns: Sequence[str] | None = None, out: str = "copies") -> DataFrame:
    """Distinct rows with their number of copies."""
    return df.groupBy(*[quoted(c) for c in (columns or df.columns)]).agg(F.count(F.lit(1)).alias(out))


def twin_groups(df: DataFrame, out: str = "copies") -> DataFrame:
    """Distinct rows with two copies or more.

    Only a 64-bit hash per row is shuffled at first.  The hashes which occur
    twice become a broadcast filter of bits, so rows without a twin are dropped
    where they are read and only suspects meet to be compared whole: a table of
    mostly different rows is never shuffled.  Hash collisions are told apart by
    the rows.
    """
    row_hash = F.xxhash64(*[quoted(c) for c in df.columns])
    hashes = df.select(row_hash.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    twice = BitFilter(durable(hashes.filter("n > 1").select("key")))
    return row_groups(twice.passing(df, row_hash), df.columns, out).filter(F.col(out) > 1)


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, rows beyond the first of their kind, and rows having any twin."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    twins = twin_groups(df).agg(zero(F.sum(F.col("copies") - 1)).alias("duplicate_rows"), zero(F.sum("copies")).alias("duplicated_rows"))
    rows = df.select(F.count(F.lit(1))).scalar()
    return twins.select(rows.alias("rows"), "duplicate_rows", "duplicated_rows")


def looks_like_date(name: str, kind: T.DataType) -> bool | None:
    """True by name or type, False for numbers, None when the values decide."""
    if any(h in name.lower() for h in DATE_NAME_HINTS) or isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return True
    return None if isinstance(kind, T.StringType) else False


def quality_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Critical")
    )


def quality_score(df: DataFrame) -> DataFrame:
    """0–100 mean of four parts: filled cells, rows without a twin, valid
    dates, columns which are not empty.  One scan and one twin search."""
    kinds = {f.name: f.dataType for f in df.schema}
    if not kinds:
        empty = [(0, 0, 0, 0, 0, 0, 0, 100.0, "Excellent")]
        return df.sparkSession.createDataFrame(empty, "rows long, columns int, missing_cells long, duplicated_rows long, invalid_dates long, date_cells long, empty_columns int, quality_score double, quality_grade string")
    twins = twin_groups(df).select(F.coalesce(F.sum("copies"), F.lit(0))).scalar()
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(kinds.items()):
        gone = is_missing(quoted(c), kind)
        sums.append(F.count_if(gone).alias(f"m{i}"))
        if looks_like_date(c, kind) is not False and not isinstance(kind, T.NumericType):
            sums.append(F.count_if(~gone & timestamp(quoted(c), kind).isNotNull()).alias(f"p{i}"))
    one = df.agg(*sums).withColumn("duplicated_rows", twins)
    rows = F.col("rows")
    total = F.lit(0).cast("long")
    missing_cells = sum((F.col(f"m{i}") for i in range(len(kinds))), total)
    empty = sum((F.when(F.col(f"m{i}") == rows, 1).otherwise(0) for i in range(len(kinds))), F.lit(0))
    applicable, invalid = total, total
    for i, (c, kind) in enumerate(kinds.items()):
        verdict = looks_like_date(c, kind)
        if verdict is False:
            continue
        if isinstance(kind, T.NumericType):  # a number always reads as an instant
            applicable = applicable + rows - F.col(f"m{i}")
            continue
        present = rows - F.col(f"m{i}")
        counts = F.lit(True) if verdict else (present > 0) & (F.col(f"p{i}") >= present * 0.8)
        applicable = applicable + F.when(counts, present).otherwise(0)
        invalid = invalid + F.when(counts, present - F.col(f"p{i}")).otherwise(0)
    one = one.select(
        rows, F.lit(len(kinds)).alias("columns"), missing_cells.alias("missing_cells"), "duplicated_rows",
        invalid.alias("invalid_dates"), applicable.alias("date_cells"), empty.alias("empty_columns"),
    )
    rate = lambda part, whole: F.coalesce(F.try_divide(F.col(part), whole), F.lit(0.0))
    # A table without rows has only empty columns by the formula.
    parts = (
        rate("missing_cells", rows * F.col("columns")) + rate("duplicated_rows", rows)
        + rate("invalid_dates", F.col("date_cells")) + F.col("empty_columns") / F.col("columns")
    )
    score = F.round(100.0 - 25.0 * parts, 2)
    return one.withColumn("quality_score", score).withColumn("quality_grade", quality_grade(F.col("quality_score")))


def cleaning_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns removed, missing cells and duplicates on both sides."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        gaps = sum((F.count_if(quoted(c).isNull()) for c in df.columns), F.lit(0))
        extra = twin_groups(df).select(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).scalar()
        one = df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"), gaps.cast("long").alias(f"missing_{tag}"))
        return one.withColumn(f"duplicates_{tag}", extra)

    measures = ["rows", "missing", "duplicates"]
    left = side(before, "before").select(*[F.col(f"{m}_before") for m in measures], *[F.lit(None).cast("long").alias(f"{m}_after") for m in measures])
    right = side(after, "after").select(*[F.lit(None).cast("long").alias(f"{m}_before") for m in measures], *[F.col(f"{m}_after") for m in measures])
    both = left.unionByName(right).agg(*[F.max(c).alias(c) for c in left.columns])
    return both.select(
        *both.columns,
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.lit(len(before.columns) - len(after.columns)).alias("columns_removed"),
    )


PAIRS_PER_PASS = 300


def correlation(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson matrix in long form, on the rows where both values exist.

    Built from moments, since ``corr`` raises on a constant column in ANSI
    mode.  Wide tables are done in passes of ``PAIRS_PER_PASS`` pairs.
    """
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations_with_replacement(columns, 2))
    result = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        batch = pairs[start : start + PAIRS_PER_PASS]
        sums, rows = [], []
        for i, (a, b) in enumerate(batch):
            x, y = (number(quoted(c), df.schema[c].dataType) for c in (a, b))
            both = x.isNotNull() & y.isNotNull()
            sums += [F.covar_pop(x, y).alias(f"xy{i}"), F.var_pop(F.when(both, x)).alias(f"xx{i}"), F.var_pop(F.when(both, y)).alias(f"yy{i}")]
            scale = F.sqrt(F.col(f"xx{i}")) * F.sqrt(F.col(f"yy{i}"))
            value = F.round(F.try_divide(F.col(f"xy{i}"), scale), digits)
            rows.append({"column_a": F.lit(a), "column_b": F.lit(b), "correlation": value})
            if a != b:
                rows.append({"column_a": F.lit(b), "column_b": F.lit(a), "correlation": value})
        part = long_form(df.agg(*sums), rows)
        result = part if result is None else result.unionByName(part)
    return result


def ratio_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of numeric, date, boolean-like, unique and missing cells.

    Numeric, date and missing shares are of all rows; boolean and unique
    shares of the filled ones.  Cells are parsed where they lie, in one scan;
    only hashes of distinct values are shuffled.
    """
    columns = list(columns or df.columns)
    sums, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        kind, text = df.schema[c].dataType, quoted(c).cast("string")
        numeric = isinstance(kind, (T.NumericType, T.BooleanType))
        dated = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        is_date = F.lit(dated) if dated or numeric else timestamp(text).isNotNull()
        sums += [
            F.count(text).alias(f"n{i}"), F.count_if(text.isNotNull() & (F.lit(True) if numeric else number(text).isNotNull())).alias(f"f{i}"),
            F.count_if(text.isNotNull() & is_date).alias(f"t{i}"), F.count_if(F.lower(F.trim(text)).isin(BOOLEAN_LIKE)).alias(f"b{i}"),
            F.avg(F.length(text)).alias(f"m{i}"),
        ]
        filled, ratio = F.col(f"n{i}"), lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        rows.append({
            "column": F.lit(c), "rows": F.col("rows"), "filled": filled, "distinct": F.col(f"d{i}"), "numeric_ratio": ratio(F.col(f"f{i}"), F.col("rows")),
            "datetime_ratio": ratio(F.col(f"t{i}"), F.col("rows")), "boolean_ratio": ratio(F.col(f"b{i}"), filled),
            "unique_ratio": ratio(F.col(f"d{i}"), filled), "missing_ratio": ratio(F.col("rows") - filled, F.col("rows")),
            "mean_length": F.coalesce(f"m{i}", F.lit(0.0)),
        })
    distinct = distinct_cells(df, columns).agg(*[F.count_if(F.col("c") == i).alias(f"d{i}") for i in range(len(columns))])
    # One row each: the distinct counts are put beside the scan's row.
    counts = distinct.select(F.struct(*[F.col(f"d{i}") for i in range(len(columns))])).scalar()
    one = df.agg(*sums).withColumn("d", counts).select("*", "d.*")
    return long_form(one, rows)


def cardinality_bands(df: DataFrame) -> DataFrame:
    """Text columns as few/moderate/many; numbers as continuous or discrete."""
    numeric = numeric_columns(df)
    columns = [*text_columns(df), *numeric]
    per_column = [F.count_if(F.col("column") == c).alias(f"d{i}") for i, c in enumerate(columns)]
    filled = [F.sum(F.when(F.col("column") == c, F.col("n"))).alias(f"n{i}") for i, c in enumerate(columns)]
    one = value_counts(df, columns).agg(*per_column, *filled)
    rows = []
    for i, c in enumerate(columns):
        d = F.col(f"d{i}")
        if c in numeric:
            band = F.when(F.coalesce(F.try_divide(d, F.col(f"n{i}")), F.lit(0.0)) >= 0.5, "continuous").otherwise("discrete")
        else:
            band = F.when(d <= 4, "few").when(d <= 8, "moderate").otherwise("many")
        rows.append({"column": F.lit(c), "distinct": d, "band": band})
    return long_form(one, rows)


def extreme_row(df: DataFrame, column: str, highest: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """The row holding the greatest (or least) number of a column."""
    name = resolve(column, df.columns)
    value = number(quoted(name), df.schema[name].dataType)
    place = F.struct(value if highest else -value, *[quoted(t) for t in tie])
    picked = F.max_by(F.struct(*[quoted(c) for c in df.columns]), F.when(value.isNotNull(), place))
    return df.agg(picked.alias("row")).filter("row is not null").select("row.*")


def single_values(df: DataFrame, column: str) -> DataFrame:
    """Mean, sum, row count and distinct count of one column, in one row."""
    name = resolve(column, df.columns)
    value = number(quoted(name), df.schema[name].dataType)
    return df.agg(
        F.avg(value).alias(alias_of(f"average_{name}")), F.sum(value).alias(alias_of(f"total_{name}")),
        F.count(F.lit(1)).alias("row_count"), F.countDistinct(quoted(name)).alias(alias_of(f"distinct_{name}")),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    name = resolve(column, df.columns)
    return df.select(quoted(name)).filter(quoted(name).isNotNull()).distinct()


def attribute_of(df: DataFrame, name_column: str, named: str, attribute: str, order: Sequence[str]) -> DataFrame:
    """Attribute of the first row whose name contains the given text."""
    name, wanted = resolve(name_column, df.columns), resolve(attribute, df.columns)
    hit = F.contains(F.lower(quoted(name).cast("string")), F.lit(named.lower()))
    first = F.min_by(F.struct(quoted(name), quoted(wanted)), F.struct(*[quoted(o) for o in order]))
    return df.filter(hit).agg(first.alias("row")).filter("row is not null").select("row.*")


def column_sample(df: DataFrame, column: str, n: int = 500, seed: int = 0) -> DataFrame:
    """The same ``n`` non-null values on every run, by the least hash of value
    and seed.  Profiles here read all values; this is for a quick look."""
    name = resolve(column, df.columns)
    values = df.select(quoted(name)).filter(quoted(name).isNotNull())
    return values.orderBy(F.md5(F.concat(quoted(name).cast("string"), F.lit(f":{seed}"))), quoted(name)).limit(n)


# Words which make a column a yes/no column, and words for a gap.
YES_NO_WORDS = ["yes", "no", "y", "n", "ye", "true", "false", "t", "f", "1", "0"]
GAP_WORDS = ["", "none", "null", "na", "n/a", "nan", "unknown"]


def boolean_like(df: DataFrame, columns: Sequence[str] | None = None, most: int = 8) -> DataFrame:
    """Columns whose few distinct values are all yes/no words; words for a gap
    do not count, but a column of nothing else is not boolean."""
    columns = list(columns or text_columns(df))
    folded = value_counts(df.select(*[F.lower(F.trim(quoted(c))).alias(c) for c in columns]), columns)
    gap, word = F.col("value").isin(GAP_WORDS), F.col("value").isin(YES_NO_WORDS)
    verdict = F.every(gap | word) & (F.count_if(word) > 0) & (F.count_if(~gap) <= most)
    return folded.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), verdict.alias("boolean_like"))
