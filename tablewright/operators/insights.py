"""Outliers, trends, seasonality and KPIs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import numeric_columns, quoted, time_columns
from ..functions.parsing import number
from ..session import durable
from . import ordered
from .quantiles import quantiles

# ---- outliers ------------------------------------------------------------

EXAMPLES = 5


def severity(percent: Column) -> Column:
    return F.when(percent >= 20, "Critical").when(percent >= 10, "High").when(percent >= 5, "Medium").otherwise("Low")


def outliers(
    df: DataFrame, columns: Sequence[str] | None = None, methods: Sequence[str] = ("iqr", "zscore"), multiplier: float = 1.5,
    threshold: float = 3.0,
) -> DataFrame:
    """One row per (column, method): count, percent, severity, action,
    confidence and the five outermost examples.

    Columns with fewer than four values or no spread are left out for IQR,
    with fewer than two values or no deviation for z-score.  Both methods are
    turned into a lower and an upper bound, then judged in one pass.
    """
    columns = list(columns or numeric_columns(df))
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError(f"{c!r} is not numeric")
    row = df.agg(*[e for c in columns for e in (F.count(quoted(c)), F.avg(quoted(c)), F.stddev_samp(quoted(c)))]).first()
    stats = {c: row[3 * i : 3 * i + 3] for i, c in enumerate(columns)}
    cases = []
    if "iqr" in methods:
        cuts = quantiles(df, [c for c in columns if stats[c][0] >= 4], [0.25, 0.75])
        for c, (q1, q3) in cuts.items():
            if q3 > q1:
                cases.append((c, "iqr", q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)))
    if "zscore" in methods:
        for c in columns:
            n, mean, deviation = stats[c]
            if n >= 2 and deviation:
                cases.append((c, "zscore", mean - threshold * deviation, mean + threshold * deviation))
    if not cases:
        return df.sparkSession.createDataFrame([], OUTLIER_SCHEMA)

    cells = [
        F.struct(F.lit(i).alias("case"), number(quoted(c), df.schema[c].dataType).alias("value"))
        for i, (c, _, lo, hi) in enumerate(cases)
    ]
    tests = [F.count_if((quoted(c) < lo) | (quoted(c) > hi)).alias(f"n{i}") for i, (c, _, lo, hi) in enumerate(cases)]
    counted = df.agg(*tests)
    rows = [
        F.struct(F.lit(i).alias("case"), F.lit(c).alias("column"), F.lit(m).alias("method"), F.lit(lo).alias("lower_bound"),
                 F.lit(hi).alias("upper_bound"), F.lit(stats[c][0]).alias("total"), F.col(f"n{i}").alias("outlier_count"))
        for i, (c, m, lo, hi) in enumerate(cases)
    ]
    found = counted.select(F.inline(F.array(*rows)))

    # The five values farthest from the middle of the bounds, per case.
    bound = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for _, _, lo, hi in cases])
    outside = (
        df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").withColumn("b", F.get(bound, F.col("case")))
        .filter("value < b.lo or value > b.hi")
    )
    distance = F.greatest(F.col("b.lo") - F.col("value"), F.col("value") - F.col("b.hi"))
    place = Window.partitionBy("case").orderBy(distance.desc(), "value")
    top = outside.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= EXAMPLES)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda e: e["value"])
    examples = top.groupBy("case").agg(listed.alias("examples"))

    joined = found.join(examples, "case", "left")
    percent = F.round(F.col("outlier_count") * 100.0 / F.col("total"), 2)
    joined = joined.withColumn("percentage", percent).withColumn("severity", severity(F.col("percentage")))
    none = F.col("outlier_count") == 0
    action = F.when(none, "Ignore").when(F.col("severity").isin("High", "Critical"), "Validate source").otherwise("Review transaction")
    base = F.when(F.col("method") == "iqr", 0.95).otherwise(0.90)
    trust = F.when(none, base - 0.05).when(F.col("percentage") >= 20, base + 0.02).otherwise(base)
    return joined.select(
        "column", "method", "outlier_count", "total", "percentage", "severity", action.alias("recommended_action"),
        F.round(F.least(trust, F.lit(0.99)), 2).alias("confidence"), "lower_bound", "upper_bound",
        F.coalesce("examples", F.array().cast("array<double>")).alias("examples"),
    )


OUTLIER_SCHEMA = (
    "column string, method string, outlier_count long, total long, percentage double, severity string, recommended_action string, "
    "confidence double, lower_bound double, upper_bound double, examples array<double>"
)


def worst_outliers(findings: DataFrame) -> DataFrame:
    """Per column the method which flags the larger share."""
    place = F.struct("percentage", F.when(F.col("method") == "iqr", 1).otherwise(0))
    return findings.groupBy("column").agg(
        F.max_by("method", place).alias("method"), F.max_by("outlier_count", place).alias("outlier_count"),
        F.max("percentage").alias("percentage"),
    )


# ---- trend ---------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def two_sided_p(t: pd.Series, freedom: pd.Series) -> pd.Series:
    """P(|T| > t) of Student's t: the regularised incomplete beta function by
    its continued fraction (Lentz), on one row per series."""
    x = (freedom / (freedom + t * t)).to_numpy(float)
    a = freedom.to_numpy(float) / 2.0
    return pd.Series([_beta_tail(*pair) for pair in zip(x, a)])


def _beta_tail(x: float, a: float, b: float = 0.5) -> float:
    from math import exp, lgamma, log

    if not np.isfinite(x) or not np.isfinite(a):
        return np.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - front * _fraction(1.0 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + top * d) or tiny)
            c = (1.0 + top / c) or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def period_series(
    df: DataFrame, value: str, period: Column, function: str = "sum", group_by: Sequence[str] = ()
) -> DataFrame:
    """(group, period, value): the table reduced to one row per period."""
    work = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "distinct": F.countDistinct}[function]
    rows = df.select(*[quoted(g) for g in group_by], period.alias("period"), quoted(value).alias("value"))
    return rows.groupBy(*[quoted(g) for g in group_by], "period").agg(work("value").cast("double").alias("value"))


LAGS = range(2, 13)


def trend(
    df: DataFrame, value: str, order: Sequence, period: str | None = None, group_by: Sequence[str] = (), label: str | None = None,
    small: bool = False,
) -> DataFrame:
    """One row per group: direction, growth, extremes, runs, fit, method.

    Rows without a value are skipped; x is the row's place in ``order``.
    ``small=True`` is for series of periods (see ``period_series``); any
    length works without it, through chunked scans.
    """
    for c in [value, *([period] if period else []), *group_by]:
        if c not in df.columns:
            raise ValueError(f"no such column: {c!r}")
    groups, keys = [quoted(g) for g in group_by], list(group_by)
    shown = F.lit(None).cast("string")
    if period:
        shown = F.date_format(quoted(period), "MMMM") if period in time_columns(df) else quoted(period).cast("string")
    names = ordered.order_names(order)
    rows = df.select(*groups, *[quoted(n).alias(f"__o{i}") for i, n in enumerate(names)], shown.alias("label"),
                     number(quoted(value), df.schema[value].dataType).alias("y")).filter("y is not null")
    place = [(f"__o{i}", o[1] if isinstance(o, tuple) else False) for i, o in enumerate(order)]
    rows = ordered.row_index(rows, place, keys, "x", small).select(*groups, "x", "label", "y")
    title = label or value.replace("_", " ").title()
    return _trend_labels((_short_series if small else _long_series)(rows, groups, keys), groups, title)


def _fit() -> dict[str, Column]:
    """Moments, ends and extremes of a series."""
    x, y = (F.col("x") - 1).cast("double"), F.col("y")
    log_y = F.when(y > 0, F.log(y))
    return {
        "n": F.count(y), "mean_y": F.avg(y), "mean_x": F.avg(x), "sxx": F.var_pop(x), "syy": F.var_pop(y), "sxy": F.covar_pop(x, y),
        "first": F.min_by(y, x), "last": F.max_by(y, x), "least": F.min(y), "highest_period": F.max_by("label", F.struct(y, -x)),
        "lowest_period": F.min_by("label", F.struct(y, x)), "lxy": F.covar_pop(x, log_y), "lyy": F.var_pop(log_y),
    }


def _with_line(fitted: DataFrame) -> DataFrame:
    slope = F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))
    square = lambda xy, yy: F.when(F.col(yy) == 0, 1.0).when(F.col("sxx") == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.try_divide(F.col(xy) * F.col(xy), F.col("sxx") * F.col(yy)))
    )
    lined = fitted.withColumns({"slope": slope, "r2": square("sxy", "syy"), "log_r2": square("lxy", "lyy")})
    return lined.withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))


def _short_series(rows: DataFrame, groups, keys: Sequence[str]) -> DataFrame:
    """All of it over windows of the group: one shuffle, one job."""
    whole = Window.partitionBy(*groups)
    fit = _fit()
    fitted = _with_line(rows.select("*", *[c.over(whole).alias(n) for n, c in fit.items()]))
    fitted = fitted.withColumn("residual", F.col("y") - F.col("intercept") - F.col("slope") * (F.col("x") - 1))
    line = whole.orderBy("x")
    seen = fitted.select("*", F.lag("y").over(line).alias("before"), *[F.lag("residual", k).over(line).alias(f"back{k}") for k in LAGS])
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    up, down = (F.coalesce(t, F.lit(False)) for t in (F.col("y") > F.col("before"), F.col("y") < F.col("before")))
    seen = seen.withColumns({"up": up, "down": down})
    # A run's length is the distance to the last row which broke it.
    last_break = lambda flag: F.max(F.when(~F.col(flag), F.col("x"))).over(upto)
    seen = seen.withColumns({"rise": F.col("x") - last_break("up"), "fall": F.col("x") - last_break("down")})
    kept = [*fit, "slope", "r2", "log_r2", "intercept"]
    one = seen.groupBy(*groups).agg(
        *[F.any_value(c).alias(c) for c in kept], *_lag_sums(), F.max("rise").alias("consecutive_increase"), F.max("fall").alias("consecutive_decrease")
    )
    # Without groups an aggregate of no rows is still a row.
    return one.filter("n is not null").withColumn("seasonal_period", _first_lag())


def _long_series(rows: DataFrame, groups, keys: Sequence[str]) -> DataFrame:
    """The same by chunked scans; the indexed rows are written once, as
    several passes start from them."""
    rows = durable(rows)
    fit = _with_line(rows.groupBy(*groups).agg(*[c.alias(n) for n, c in _fit().items()])).filter("n > 0")
    with_fit = _with_groups(rows, fit.select(*groups, "slope", "intercept", "n"), keys)
    with_fit = with_fit.withColumn("residual", F.col("y") - F.col("intercept") - F.col("slope") * (F.col("x") - 1))
    looks = {"before": lambda w: F.lag("y").over(w)}
    looks |= {f"back{k}": (lambda k: lambda w: F.lag("residual", k).over(w))(k) for k in LAGS}
    seen = durable(ordered.with_neighbours(with_fit, ["x"], max(LAGS), looks, keys, index="x"))
    season = seen.groupBy(*groups).agg(F.max("n").alias("n"), *_lag_sums()).select(*groups, _first_lag().alias("seasonal_period"))
    return _with_groups(_with_groups(fit, season, keys), _runs(seen, groups, keys), keys)


def _with_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return ordered.join_on(left, right, keys)
    # Both sides of the condition are constants: the right side is the single
    # row of an aggregate without keys.
    one = F.broadcast(right.withColumn("__one", F.lit(1)))
    return left.withColumn("__left", F.lit(1)).join(one, F.col("__left") == F.col("__one"), "left").drop("__one", "__left")


def _lag_sums() -> list[Column]:
    """Moments of the residuals against themselves k rows before."""
    sums = []
    for k in LAGS:
        a, b = F.when(F.col(f"back{k}").isNotNull(), F.col("residual")), F.col(f"back{k}")
        sums += [F.covar_pop(a, b).alias(f"c{k}"), F.var_pop(a).alias(f"a{k}"), F.var_pop(b).alias(f"b{k}")]
    return sums


def _first_lag() -> Column:
    """First lag with a residual correlation of at least .75."""
    steps = []
    for k in LAGS:
        strong = F.try_divide(F.col(f"c{k}"), F.sqrt(F.col(f"a{k}")) * F.sqrt(F.col(f"b{k}"))) >= 0.75
        allowed = (F.col("n") >= 6) & (F.lit(k) <= F.floor(F.col("n") / 2))
        steps.append(F.when(allowed & strong, k))
    return F.coalesce(*steps)


def _runs(seen: DataFrame, groups, keys: Sequence[str]) -> DataFrame:
    """Longest rising and falling runs: rows between two breaks share the
    number of breaks so far."""
    up, down = F.col("y") > F.col("before"), F.col("y") < F.col("before")
    flagged = seen.select(*groups, "x", F.coalesce(up, F.lit(False)).alias("up"), F.coalesce(down, F.lit(False)).alias("down"))
    flagged = flagged.withColumns({"not_up": (~F.col("up")).cast("int"), "not_down": (~F.col("down")).cast("int")})
    longest = None
    for flag, broken, out in (("up", "not_up", "consecutive_increase"), ("down", "not_down", "consecutive_decrease")):
        islands = ordered.running_total(flagged, broken, ["x"], keys, "island")
        lengths = islands.groupBy(*groups, "island").agg(F.count_if(F.col(flag)).alias("length"))
        part = lengths.groupBy(*groups).agg(F.max("length").alias(out))
        longest = part if longest is None else _with_groups(longest, part, keys)
    return longest


def _trend_labels(t: DataFrame, groups, label: str) -> DataFrame:
    n, slope = F.col("n"), F.col("slope")
    relative = F.coalesce(F.try_divide(slope, F.abs("mean_y")), F.lit(0.0))
    direction = F.when((n == 1) | (F.abs(relative) < 0.01), "Stable").when(relative > 0, "Increasing").otherwise("Decreasing")
    t = t.withColumn("trend", direction)
    growth = F.when(n == 1, 0.0).otherwise(F.round(F.try_divide(F.col("last") - F.col("first"), F.abs("first")) * 100, 1))
    t = t.withColumn("growth_percent", growth)
    # Residual sum of squares and the slope's t statistic.
    sse = F.greatest(F.lit(0.0), n * (F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))))
    perfect = (sse == 0) | (F.col("r2") >= 1.0)
    t_value = F.abs(slope) / F.sqrt(F.try_divide(sse / (n - 2), n * F.col("sxx")))
    tested = two_sided_p(F.when(~perfect & (n > 2), t_value), F.when(n > 2, (n - 2).cast("double")))
    flat = (n < 2) | (F.col("syy") == 0) | (F.col("sxx") == 0)
    p = F.when(flat, 1.0).when((n <= 2) | perfect, F.when(perfect & (slope != 0), 0.0).otherwise(1.0)).otherwise(tested)
    t = t.withColumn("p_value", p)
    stable, rising = F.col("trend") == "Stable", F.col("trend") == "Increasing"
    exponential = rising & (F.col("least") > 0) & (F.col("log_r2") >= 0.8) & (F.col("log_r2") > F.col("r2") + 0.05)
    method = F.when(exponential, "exponential_growth").when(F.col("seasonal_period").isNotNull(), "seasonal_basic").when(
        stable, "stable").otherwise("linear_regression")
    used = F.when(exponential, F.col("log_r2")).otherwise(F.col("r2"))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("p_value")))
    trust = F.when(n == 1, 0.6).when(stable, 0.6 + F.least(F.lit(0.35), F.greatest(F.lit(0.0), 1.0 - used) * 0.35)).otherwise(0.5 * used + 0.5 * sure)
    level = F.when(n == 1, "Low").when(F.col("p_value") < 0.01, "High").when(F.col("p_value") < 0.05, "Medium").otherwise("Low")
    falls = F.col("trend") == "Decreasing"
    decline = F.when(falls & F.col("growth_percent").isNotNull(), F.abs("growth_percent")).otherwise(0.0)
    whole = lambda run: F.col(run) == n - 1
    mixed = " overall throughout the period, with some fluctuation."
    summary = (
        F.when(n == 1, f"Only one period of {label.lower()} data is available, so no trend can be determined.")
        .when(rising & whole("consecutive_increase"), f"{label} increased consistently throughout the period.")
        .when(rising, f"{label} increased{mixed}")
        .when(falls & whole("consecutive_decrease"), f"{label} decreased consistently throughout the period.")
        .when(falls, f"{label} decreased{mixed}")
        .otherwise(f"{label} remained stable throughout the period.")
    )
    return t.select(
        *groups, n.alias("n"), "trend", "growth_percent", decline.alias("decline_percent"), "highest_period", "lowest_period",
        "consecutive_increase", "consecutive_decrease", summary.alias("summary"), F.round(trust, 2).alias("confidence"),
        F.col("growth_percent").alias("growth_rate"), F.when(n == 1, "stable").otherwise(method).alias("method"),
        level.alias("significance_level"), F.round(slope, 6).alias("slope"), "r2", "p_value", "seasonal_period",
    )


# ---- sentiment -----------------------------------------------------------


def sentiment_rollup(labelled: DataFrame, entity: str | None = None, unknown: str = "Unknown") -> DataFrame:
    """Counts per label, mean score and satisfaction of rows which carry
    ``label`` and ``score``; overall, or per entity (blank → unknown)."""
    counts = [F.count_if(F.col("label") == name).alias(name.lower()) for name in ("Positive", "Neutral", "Negative", "Mixed")]
    happy = F.sum(F.when(F.col("label") == "Positive", 1.0).when(F.col("label") == "Mixed", 0.5).otherwise(0.0))
    rows = F.count(F.lit(1))
    measures = [
        rows.alias("reviews"), *counts, F.round(F.avg("score"), 3).alias("average_score"),
        F.round(F.try_divide(happy, rows) * 100, 1).alias("satisfaction"),
    ]
    if entity is None:
        return labelled.agg(*measures)
    text = F.trim(quoted(entity).cast("string"))
    name = F.when(text.isNull() | (text == ""), unknown).otherwise(text)
    return labelled.groupBy(name.alias("entity")).agg(*measures).orderBy(F.desc("satisfaction"), F.desc("reviews"), "entity")
