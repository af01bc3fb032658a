"""Report bundle: only the chosen sections, each dependency once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted, time_columns
from ..operators import findings, insights, kpis, profile
from ..operators.roles import report_columns
from ..session import durable

SECTIONS = ["statistics", "missing_values", "trend", "outliers", "detected_kpis", "recommendations", "data_quality", "executive_summary"]


def build_report(
    df: DataFrame, sections: Sequence[str], value: str | None = None, order: Sequence | None = None, period: Column | None = None
) -> dict[str, DataFrame]:
    """DataFrame per chosen section.

    Results a later section needs (outliers, trend, KPIs) are small and are
    written once; the input itself is scanned with pruned columns, not cached
    whole.  ``period`` is the expression to sum by, by default the month of
    the first time column.
    """
    unknown = [s for s in sections if s not in SECTIONS]
    if unknown:
        raise ValueError(f"unknown sections {unknown}; there are {SECTIONS}")
    wanted = set(sections)
    found_value, found_period = report_columns(df)
    value = value or found_value
    if period is None and order is None and found_period in time_columns(df):
        period = F.date_trunc("month", quoted(found_period))
    summary = "executive_summary" in wanted
    advise = summary or "recommendations" in wanted
    out: dict[str, DataFrame] = {}
    if wanted & {"statistics"} and value:
        out["statistics"] = profile.describe(df, [value])
    if advise or "missing_values" in wanted:
        out["missing_values"] = durable(profile.missing(df))
    if (advise or "trend" in wanted) and value and (period is not None or order is not None):
        if period is not None:
            series = insights.period_series(df, value, period)
            out["trend"] = durable(insights.trend(series, "value", ["period"], "period", label=value.replace("_", " ").title(), small=True))
        else:
            out["trend"] = durable(insights.trend(df, value, order))
    if advise or "outliers" in wanted:
        out["outliers"] = durable(insights.outliers(df))
    if "detected_kpis" in wanted:
        out["detected_kpis"] = kpis.kpis(df, order, period)
    if summary or "data_quality" in wanted:
        out["data_quality"] = durable(profile.quality_score(df))
    if advise:
        table = durable(findings_table(df, out, value))
        advice = findings.recommendations(table, ["dataset"])
        out["recommendations"] = advice
        if summary:
            out["executive_summary"] = findings.health(table, ["dataset"], advice)
    return {s: out[s] for s in sections if s in out}


# Measures whose trend is a trend of revenue, or of the margin.
REVENUE_NAMES = ("revenue", "sales", "total_revenue", "income")
MARGIN_NAMES = ("profit_margin", "margin", "gross_margin", "net_margin")


def findings_table(df: DataFrame, parts: dict[str, DataFrame], value: str | None) -> DataFrame:
    """The one-row input of the recommendation and health rules."""
    gap = F.struct("missing_percent", "column")
    gaps = parts["missing_values"].agg(F.max_by("column", gap).alias("c"), F.max("missing_percent").alias("p"),
                                       F.count_if(F.col("missing_percent") >= 20).alias("n")).first()
    worst = parts["outliers"].agg(
        F.max_by("column", F.struct("percentage", "column")).alias("c"), F.max("percentage").alias("p"),
        F.max_by("severity", "percentage").alias("s"),
    ).first()
    trend = parts["trend"].first() if "trend" in parts else None
    quality = parts["data_quality"].first() if "data_quality" in parts else None
    weight = kpis.find_column([value] if value else [], kpis.REVENUE) or kpis.find_column([value] if value else [], kpis.ORDER_VALUE)
    customer = kpis.find_column(df.columns, kpis.CUSTOMER)
    share = kpis.concentration(df, customer[0], value).first()[0] if customer and weight else None
    of = lambda names: (trend["trend"], trend["decline_percent"]) if trend and value and value.lower() in names else (None, None)
    row = (
        "table", *of(REVENUE_NAMES), *of(MARGIN_NAMES), None, gaps["c"],
        round(gaps["p"], 2), gaps["n"], share, worst["c"], worst["p"], quality["quality_score"] if quality else None, worst["s"],
        trend["trend"] if trend else None, trend["confidence"] if trend else None, trend["decline_percent"] if trend else None,
    )
    schema = (
        "dataset string, revenue_trend string, revenue_decline double, margin_trend string, margin_decline double, margin_change_percent double, "
        "worst_missing_column string, worst_missing_percent double, missing_columns long, top_share_percent double, worst_outlier_column string, "
        "worst_outlier_percent double, quality_score double, outlier_severity string, trend string, trend_confidence double, trend_decline double"
    )
    return df.sparkSession.createDataFrame([row], schema)
