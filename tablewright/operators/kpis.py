"""Business figures found by column names, as ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, quoted, time_columns
from . import insights, ordered
from .profile import long_form

# Words in a column name, with how sure they make us.
REVENUE = [(["revenue"], 0.92), (["total_sales", "gross_sales", "net_sales"], 0.88), (["sales", "income", "turnover"], 0.75)]
PROFIT = [(["profit"], 0.92), (["net_income", "earnings"], 0.85)]
COST = [(["cost", "expense", "cogs"], 0.8)]
ORDER_VALUE = [(["order_total", "order_value", "order_amount"], 0.9), (["amount", "total"], 0.7), (["price"], 0.65)]
ORDER_ID = [(["order_id", "order_number", "invoice_id", "transaction_id"], 0.9)]
CUSTOMER = [(["customer_id", "client_id", "customer_name", "client_name"], 0.88), (["customer", "client"], 0.7)]
PRODUCT = [(["product_id", "product_name", "item_name", "sku"], 0.88), (["product", "item"], 0.7)]
PERIOD_WORDS = ["date", "month", "year", "period", "quarter", "week", "time", "day"]
ABOUT = {
    "Revenue": ("Critical", "Revenue"), "Profit": ("Critical", "Profitability"), "Profit Margin": ("High", "Profitability"),
    "Growth Rate": ("High", "Revenue"), "Order Count": ("High", "Operations"), "Customer Count": ("High", "Customers"),
    "Average Order Value": ("Medium", "Revenue"), "Top Customer": ("Medium", "Customers"), "Top Product": ("Medium", "Inventory"),
}
IMPORTANCE = ["Critical", "High", "Medium", "Low"]


def find_column(columns: Sequence[str], hints) -> tuple[str, float] | None:
    for listed, sure in hints:
        hit = next((c for c in columns if any(w in c.lower() for w in listed)), None)
        if hit is not None:
            return hit, sure
    return None


def period_column(df: DataFrame) -> str | None:
    times = time_columns(df)
    return times[0] if times else next((c for c in df.columns if any(w in c.lower() for w in PERIOD_WORDS)), None)


def top_entity(df: DataFrame, entity: str, value: str | None) -> DataFrame:
    """The entity with the greatest total (or most rows); smallest on ties."""
    weight = F.sum(quoted(value)) if value else F.count(F.lit(1))
    totals = df.filter(quoted(entity).isNotNull()).groupBy(quoted(entity).alias("e")).agg(weight.alias("w"))
    return totals.agg(F.min_by(F.col("e").cast("string"), F.struct(-F.col("w"), F.col("e"))).alias("e"))


def concentration(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Share of the largest entity in the total, in percent."""
    totals = df.groupBy(quoted(entity).alias("e")).agg(F.sum(quoted(value)).alias("w"))
    return totals.agg(F.round(F.try_divide(F.max("w") * 100.0, F.sum("w")), 2).alias("top_share_percent"))


def _measure(value: str | tuple[str, str]) -> Column:
    return quoted(value) if isinstance(value, str) else quoted(value[0]) - quoted(value[1])


def kpis(df: DataFrame, order: Sequence | None = None, period: Column | None = None, extra: Sequence[dict] = ()) -> DataFrame:
    """One row per figure the columns allow: value or name, trend, unit,
    confidence, importance, category, rank.

    Trends follow the rows in ``order``; with ``period`` (an expression such
    as a month) values are summed per period first, which is the form for
    large tables.  Without either there are no trends.  ``extra`` adds
    figures: dicts of name, value (an aggregate), unit, confidence, importance
    and category; they join the one scan of the built-in ones.
    """
    numbers = numeric_columns(df)
    revenue, direct = find_column(numbers, REVENUE), find_column(numbers, PROFIT)
    cost, order_value = find_column(numbers, COST), find_column(numbers, ORDER_VALUE)
    order_id, customer = find_column(df.columns, ORDER_ID), find_column(df.columns, CUSTOMER)
    product, when = find_column(df.columns, PRODUCT), period_column(df)

    sums = [F.count(F.lit(1)).alias("rows")]
    sums += [F.sum(quoted(c)).cast("double").alias(f"sum:{c}") for c in numbers]
    sums += [F.count(quoted(c)).alias(f"n:{c}") for c in numbers]
    if not direct and revenue and cost:
        both = quoted(revenue[0]).isNotNull() & quoted(cost[0]).isNotNull()
        sums.append(F.sum(F.when(both, quoted(revenue[0]) - quoted(cost[0]))).cast("double").alias("derived"))
    sums += [e["value"].cast("double").alias(f"extra:{i}") for i, e in enumerate(extra)]
    one = df.agg(*sums)
    total, filled = (lambda c: F.col(f"`sum:{c}`")), (lambda c: F.col(f"`n:{c}`"))

    known: dict[tuple, Column] = {}
    profit_parts = (revenue[0], cost[0]) if revenue and cost and not direct else None
    if period is not None and when is not None:
        # All series in one pass over the table, all trends in one job.
        series = {(m, "sum"): _measure(m) for m in {c[0] for c in (revenue, direct, order_value) if c} | ({profit_parts} if profit_parts else set())}
        sums = {k: F.sum(c) for k, c in series.items()} | ({(order_id[0], "distinct"): F.countDistinct(quoted(order_id[0]))} if order_id else {})
        names = {f"m{i}": k for i, k in enumerate(sums)}
        per = df.groupBy(period.alias("period")).agg(*[c.cast("double").alias(n) for n, c in zip(names, sums.values())])
        cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])
        long = per.select("period", F.inline(cells)) if names else None
        if long is not None:
            found = insights.trend(long, "value", ["period"], group_by=["measure"], small=True)
            # At most one row per figure, as one scalar of the plan.
            rows = F.map_from_entries(F.collect_list(F.struct("measure", F.struct(*[quoted(c) for c in found.columns]).alias("row"))))
            trends = found.agg(rows.alias("rows")).scalar()
            known = {key: F.try_element_at(trends, F.lit(name)) for name, key in names.items()}

    def trend_of(value: str | tuple[str, str], field: str = "trend", function: str = "sum") -> Column:
        """Field of the trend of a column, or of the difference of two: the
        one row of a series is a scalar of the plan, nothing is collected."""
        if when is None or (order is None and period is None):
            return F.lit(None)
        if (value, function) not in known:
            rows = df.withColumn("__measure", _measure(value))
            if function == "distinct":
                series = insights.period_series(rows, "__measure", quoted(when), function)
                found = insights.trend(series, "value", ["period"])
            else:
                found = insights.trend(rows, "__measure", order)
            known[value, function] = found.select(F.struct(*[quoted(c) for c in found.columns])).scalar()
        return known[value, function].getField(field)

    sure = lambda *parts: round(min(parts), 4)
    rows: list[dict] = []

    def add(name, confidence, unit, value=None, entity=None, trend=None, about=None):
        importance, category = about or ABOUT[name]
        rows.append({
            "name": F.lit(name), "value": (F.lit(None) if value is None else value).cast("double"),
            "entity": (F.lit(None) if entity is None else entity).cast("string"),
            "trend": (F.lit(None) if trend is None else trend).cast("string"), "unit": F.lit(unit).cast("string"),
            "confidence": F.lit(round(confidence, 2)), "importance": F.lit(importance), "category": F.lit(category),
        })

    if revenue:
        revenue_trend = trend_of(revenue[0])
        add("Revenue", revenue[1], "currency", F.round(F.when(filled(revenue[0]) > 0, total(revenue[0])), 2), trend=revenue_trend)
        growth = trend_of(revenue[0], "growth_percent")
        add("Growth Rate", revenue[1], "%", growth, trend=revenue_trend)
    profit = None
    if direct:
        profit, profit_sure, profit_trend = F.when(filled(direct[0]) > 0, total(direct[0])), direct[1], trend_of(direct[0])
    elif revenue and cost:
        profit, profit_sure = F.col("derived"), round(sure(revenue[1], cost[1]) * 0.9, 2)
        profit_trend = trend_of((revenue[0], cost[0]))
    if profit is not None:
        add("Profit", profit_sure, "currency", F.round(profit, 2), trend=profit_trend)
        if revenue:
            margin = F.round(F.try_divide(F.round(profit, 2), F.nullif(total(revenue[0]), F.lit(0.0))) * 100, 2)
            add("Profit Margin", sure(profit_sure, revenue[1]) * 0.95, "%", margin, trend=profit_trend)
    measure = order_value or revenue
    if measure:
        amount = total(measure[0])
        if order_id:
            distinct = df.select(F.countDistinct(quoted(order_id[0]))).scalar()
            add("Average Order Value", sure(measure[1], order_id[1]), "currency", F.round(F.try_divide(amount, distinct), 2),
                trend=trend_of(measure[0]))
        else:
            add("Average Order Value", measure[1] * 0.8, "currency", F.round(F.try_divide(amount, filled(measure[0])), 2),
                trend=trend_of(measure[0]))
    weight = revenue or order_value
    for name, found in (("Top Customer", customer), ("Top Product", product)):
        if found:
            confidence = sure(found[1], weight[1]) if weight else found[1] * 0.75
            add(name, confidence, None, entity=top_entity(df, found[0], weight[0] if weight else None).scalar())
    if order_id:
        count = df.select(F.countDistinct(quoted(order_id[0]))).scalar()
        add("Order Count", order_id[1], "count", count, trend=trend_of(order_id[0], function="distinct"))
    elif weight:
        add("Order Count", 0.55, "count", F.when(F.col("rows") > 0, F.col("rows")))
    if customer:
        add("Customer Count", customer[1], "count", df.select(F.countDistinct(quoted(customer[0]))).scalar())
    for i, e in enumerate(extra):
        add(e["name"], e["confidence"], e.get("unit"), F.col(f"`extra:{i}`"), about=(e.get("importance", "Low"), e.get("category", "Operations")))
    if not rows:
        schema = "name string, value double, entity string, trend string, unit string, confidence double, importance string, category string, rank long"
        return df.sparkSession.createDataFrame([], schema)
    found = long_form(one, rows).filter("value is not null or entity is not null")
    level = F.array_position(F.array(*[F.lit(i) for i in IMPORTANCE]), F.col("importance"))
    keyed = found.withColumns({"__level": level, "__sure": -F.col("confidence")})
    # At most nine rows, one per figure.
    return ordered.row_index(keyed, ["__level", "__sure", "name"], out="rank", small=True).drop("__level", "__sure")
