"""Structured query plan → DataFrame.

A plan is a dict with any of ``derived_columns``, ``filters``, ``group_by``,
``metrics``, ``window``, ``keep_top_n_per_partition``, ``order_by``, ``limit``.
Columns are checked against the schema before anything is built, and the
result is one lazy DataFrame which Catalyst optimises as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import UnknownColumn, alias_of, quoted, resolve, resolve_all
from ..functions.predicates import COMPARISONS, all_of, as_number, literal_for, plan_condition
from ..operators import ordered

AGGREGATES = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}
WINDOWS = ("rank", "dense_rank", "running_total", "moving_average")


def run_plan(df: DataFrame, plan: dict) -> DataFrame:
    if not plan:
        raise ValueError("the plan is empty")
    given = df
    for derived in plan.get("derived_columns") or []:
        df = add_derived(df, derived)
    group = resolve_all(plan.get("group_by") or [], df.columns)
    metrics = [_metric(df, m) for m in plan.get("metrics") or []]
    # A mean to compare with is taken from the table as it was given, where the
    # column is there already: derived columns neither add nor drop rows.
    known = {c.lower() for c in given.columns}
    conditions = [plan_condition(given if str(f.get("column")).strip().lower() in known else df, f) for f in plan.get("filters") or []]

    rows = df.filter(all_of(conditions)) if conditions else df
    if metrics:
        rows = rows.groupBy(*[quoted(g) for g in group]).agg(*[c.alias(name) for name, c in metrics])
    output = [*group, *[name for name, _ in metrics]] or list(df.columns)

    top = plan.get("keep_top_n_per_partition")
    ranked = None
    if plan.get("window"):
        rows, ranked = _add_window(rows, plan["window"], [name for name, _ in metrics], int(top) if top else None)
        output.append(ranked)
    elif top:
        raise ValueError("keep_top_n_per_partition needs a window")

    if plan.get("order_by"):
        rows = rows.orderBy(*[_order_column(rows, o, ranked) for o in plan["order_by"]])
    if plan.get("limit"):
        rows = rows.limit(int(plan["limit"]))
    return rows.select(*[quoted(c) for c in output])


def _metric(df: DataFrame, metric: dict) -> tuple[str, Column]:
    function = str(metric.get("function") or "").lower()
    if function not in AGGREGATES:
        raise ValueError(f"unsupported aggregate {function!r}")
    column = resolve(metric.get("column"), df.columns)
    return alias_of(metric.get("alias") or f"{function}_{column}"), AGGREGATES[function](quoted(column))


def add_derived(df: DataFrame, derived: dict) -> DataFrame:
    """Label each row by comparing an aggregate of its group with a value."""
    case = derived.get("case") or {}
    condition = case.get("condition") or {}
    function = str(condition.get("window_function") or "count").lower()
    if function not in AGGREGATES:
        raise ValueError(f"unsupported aggregate {function!r}")
    keys = resolve_all(condition.get("partition_by") or [], df.columns)
    if not keys:
        raise ValueError("a derived column needs partition_by")
    named = condition.get("column")
    if named or function != "count":
        aggregate = AGGREGATES[function](quoted(resolve(named, df.columns)))
    else:
        aggregate = F.count(F.lit(1))
    operator = condition.get("operator")
    if operator not in COMPARISONS:
        raise ValueError(f"unsupported comparison {operator!r}")

    grouped = ordered.group_value(df, keys, {"__measure": aggregate})
    kind = grouped.schema["__measure"].dataType
    test = COMPARISONS[operator](F.col("__measure"), literal_for(condition.get("value"), kind))
    label = F.when(test, _label(case.get("then"))).otherwise(_label(case.get("else")))
    return grouped.withColumn(alias_of(derived.get("alias") or "derived_col"), label).drop("__measure")


def _label(value) -> Column:
    numeric = as_number(value)
    if numeric is None:
        return F.lit(None if value is None else str(value))
    return F.lit(int(numeric)) if numeric == int(numeric) and "." not in str(value) else F.lit(numeric)


def _ordering(rows: DataFrame, parts: list[dict]) -> list[tuple[str, bool]]:
    return [
        (resolve(p.get("column", ""), rows.columns), (p.get("direction") or "desc").lower() == "desc") for p in parts
    ]


def _add_window(rows: DataFrame, window: dict, metrics: list[str], top: int | None) -> tuple[DataFrame, str]:
    kind = str(window.get("type") or "").lower()
    if kind not in WINDOWS:
        raise ValueError(f"unsupported window {kind!r}")
    keys = resolve_all(window.get("partition_by") or [], rows.columns)
    order = _ordering(rows, window.get("order_by") or [])
    if kind in ("rank", "dense_rank"):
        if top is not None:
            # rank <= n is planned as a group limit before the shuffle.
            over = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*ordered.sort_keys(order))
            ranks = (F.rank() if kind == "rank" else F.dense_rank()).over(over)
            return rows.withColumn("rnk", ranks).filter(F.col("rnk") <= top), "rnk"
        return ordered.rank(rows, order, keys, dense=kind == "dense_rank"), "rnk"
    if not metrics:
        raise ValueError(f"{kind} needs a metric")
    # Ties are broken by the group columns, which are unique after grouping.
    named = {n for n, _ in order}
    order += [(c, False) for c in rows.columns if c not in named and c not in metrics]
    if kind == "running_total":
        rows, alias = ordered.running_total(rows, metrics[0], order, keys, "running_total"), "running_total"
    else:
        size = int(window.get("window_size") or 3)
        rows, alias = ordered.moving_average(rows, metrics[0], order, size, keys, "moving_avg"), "moving_avg"
    return (rows.filter(F.col(alias) <= top) if top is not None else rows), alias


def _order_column(rows: DataFrame, part: dict, ranked: str | None) -> Column:
    name = str(part.get("column", ""))
    if ranked and name.lower() == ranked:
        found = ranked
    else:
        try:
            found = resolve(alias_of(name), rows.columns)
        except UnknownColumn:
            found = resolve(name, rows.columns)
    return ordered.sort_key((found, (part.get("direction") or "desc").lower() == "desc"))


def select_where(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Row filter with values bound as parameters of a SQL statement."""
    if not filters:
        raise ValueError("at least one filter is required")
    signs = {"equals": "=", "not_equals": "!=", "greater_than": ">", "less_than": "<",
             "greater_than_equal": ">=", "less_than_equal": "<="}
    clauses, arguments = [], {}
    for i, f in enumerate(filters):
        name = resolve(f.get("column"), df.columns)
        kind, column = df.schema[name].dataType, "`" + name.replace("`", "``") + "`"
        operator = f.get("operator")
        if operator == "contains":
            arguments[f"v{i}"] = str(f.get("value")).lower()
            clauses.append(f"contains(lower(cast({column} as string)), :v{i})")
            continue
        arguments[f"v{i}"] = _bound(f.get("value"), kind)
        if operator == "between":
            arguments[f"w{i}"] = _bound(f.get("value2"), kind)
            clauses.append(f"{column} between :v{i} and :w{i}")
        elif operator in signs:
            clauses.append(f"{column} {signs[operator]} :v{i}")
        else:
            raise ValueError(f"unsupported filter {operator!r}")
    return df.sparkSession.sql("select * from {rows} where " + " and ".join(clauses), args=arguments, rows=df)


def _bound(value, kind: T.DataType):
    if isinstance(kind, T.NumericType) and as_number(value) is not None:
        numeric = as_number(value)
        return int(numeric) if numeric == int(numeric) else numeric
    return value
