"""Recommendations and health from a table of findings.

The table has one row per dataset or segment with nullable columns
revenue_trend, revenue_decline, margin_trend, margin_decline,
margin_change_percent, worst_missing_column, worst_missing_percent,
missing_columns, top_share_percent, worst_outlier_column,
worst_outlier_percent, quality_score, outlier_severity, trend,
trend_confidence, trend_decline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(value: Column, low: float, high: float) -> Column:
    """Confidence .55–.95 by where the value lies between low and high."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    return F.round(0.55 + share * 0.40, 2)


def priority(value: Column, medium: float, high: float) -> Column:
    return F.when(value >= high, "High").when(value >= medium, "Medium").otherwise("Low")


def rule(test: Column, category: str, advice: str, reason: Column, value: Column, marks: tuple[float, float], span: tuple[float, float]) -> Column:
    level = priority(value, *marks)
    row = F.struct(
        F.lit(category).alias("category"), level.alias("priority"), F.lit(advice).alias("recommendation"), reason.alias("reason"),
        level.alias("impact"), scaled(value, *span).alias("confidence"),
    )
    return F.when(F.coalesce(test, F.lit(False)), row)


def _shown(value: Column) -> Column:
    return value.cast("double").cast("string")


# Texts, marks and spans of the advice.
def default_rules() -> list[Column]:
    revenue = F.coalesce("revenue_decline", F.lit(0.0))
    by_trend = F.coalesce(F.col("margin_trend") == "Decreasing", F.lit(False))
    fell = F.col("margin_change_percent") < 0
    margin = F.when(by_trend, F.coalesce("margin_decline", F.lit(0.0))).when(fell, F.abs("margin_change_percent"))
    margin_reason = F.when(by_trend, F.concat(F.lit("Profit margin is trending downward, declining "), _shown(margin), F.lit("% over the analyzed period."))).otherwise(
        F.concat(F.lit("Profit margin fell by "), _shown(margin), F.lit("% compared to the prior period.")))
    gaps, share, outside = F.col("worst_missing_percent"), F.col("top_share_percent"), F.col("worst_outlier_percent")
    return [
        rule(F.col("revenue_trend") == "Decreasing", "Revenue", "Improve marketing strategy",
              F.concat(F.lit("Revenue is trending downward, declining "), _shown(revenue), F.lit("% over the analyzed period.")),
              revenue, (5.0, 15.0), (2.0, 25.0)),
        rule(by_trend | fell, "Profitability", "Review pricing strategy", margin_reason, margin, (3.0, 10.0), (1.0, 20.0)),
        rule(gaps >= 20, "Data Quality", "Improve data quality",
              F.concat(F.col("missing_columns").cast("string"), F.lit(" column(s) have high missing-value rates (worst: '"),
                       F.col("worst_missing_column"), F.lit("' at "), _shown(gaps), F.lit("% missing).")), gaps, (30.0, 50.0), (20.0, 80.0)),
        rule(share >= 40, "Customers", "Diversify customer base",
              F.concat(F.lit("A single customer (or small group) accounts for "), _shown(share), F.lit("% of revenue, a significant concentration risk.")),
              share, (50.0, 60.0), (40.0, 80.0)),
        rule(outside >= 10, "Data Quality", "Investigate and clean outlier records",
              F.concat(F.lit("Column '"), F.col("worst_outlier_column"), F.lit("' has an unusually high rate of outliers ("), _shown(outside),
                       F.lit("% of values), which may distort analysis.")), outside, (15.0, 25.0), (10.0, 40.0)),
    ]


def recommendations(findings: DataFrame, keys: list[str], rules: list[Column] | None = None) -> DataFrame:
    """Triggered advice per row of the findings, most pressing first.  Rules
    are columns made by ``rule``; pass more, fewer or other ones."""
    rank = F.when(F.col("priority") == "High", 0).when(F.col("priority") == "Medium", 1).otherwise(2)
    fired = F.array_compact(F.array(*(default_rules() if rules is None else rules)))
    rows = findings.select(*keys, F.explode(fired).alias("r")).select(*keys, "r.*")
    return rows.orderBy(*keys, rank, F.desc("confidence"), "recommendation")


LEVELS = ["Healthy", "Needs Attention", "At Risk", "Critical"]


def health(findings: DataFrame, keys: list[str], advice: DataFrame) -> DataFrame:
    """Worst of quality, advice, outlier and trend health per row."""
    score = F.col("quality_score")
    quality = F.when(score < 40, 3).when(score < 60, 2).when(score < 75, 1).otherwise(0)
    outliers = F.when(F.col("outlier_severity") == "Critical", 3).when(F.col("outlier_severity") == "High", 2).when(
        F.col("outlier_severity") == "Medium", 1).otherwise(0)
    sure, fall = F.coalesce("trend_confidence", F.lit(0.0)), F.abs(F.coalesce("trend_decline", F.lit(0.0)))
    down = F.col("trend") == "Decreasing"
    trend = F.when(down & (sure >= 0.8) & (fall >= 15), 2).when(down & ((sure >= 0.65) | (fall >= 5)), 1).otherwise(0)
    worst = advice.groupBy(*keys).agg(
        F.max(F.when(F.col("priority") == "High", 2).when(F.col("priority") == "Medium", 1).otherwise(0)).alias("__advice")
    )
    joined = findings.join(worst, keys, "left")
    level = F.greatest(quality, outliers, trend, F.coalesce("__advice", F.lit(0)))
    names = F.array(*[F.lit(n) for n in LEVELS])
    return joined.select(*keys, F.get(names, level).alias("overall_health"), F.get(names, quality).alias("quality_health"),
                         F.get(names, F.coalesce("__advice", F.lit(0))).alias("advice_health"), F.get(names, outliers).alias("outlier_health"),
                         F.get(names, trend).alias("trend_health"))
