"""Two smaller query forms: role-checked queries and the one-step learner
plan; with audits of results against the predicates they promise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted, resolve, resolve_all
from ..functions.parsing import number, timestamp
from ..functions.predicates import all_of, compare, folded_condition, role_condition
from ..operators import ordered
from ..operators.roles import check_conditions

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "average": F.avg, "mean": F.avg, "min": F.min, "max": F.max}
PREVIEW_ROWS = 25


def run_structured(df: DataFrame, query: dict, roles: dict[str, str]) -> DataFrame:
    """filter, sort, count or group over conditions checked by role.  Null
    groups are kept; sorting is ascending unless told."""
    conditions = query.get("conditions") or []
    check_conditions(conditions, roles)
    rows = df.filter(all_of([role_condition(df, roles[c["column"]], c) for c in conditions])) if conditions else df
    operation = query.get("operation")
    if operation == "filter":
        return rows
    if operation == "sort":
        order = [(resolve(s["column"], df.columns), s.get("direction", "asc") == "desc") for s in query.get("sort") or []]
        return rows.orderBy(*ordered.sort_keys(order))
    if operation == "count":
        return rows.agg(F.count(F.lit(1)).alias("count"))
    if operation in ("group", "aggregate", "report"):
        keys = resolve_all(query.get("group_by") or [], df.columns)
        wanted = query.get("aggregates") or []
        if not wanted:
            return rows.groupBy(*[quoted(k) for k in keys]).count()
        cells = []
        for a in wanted:
            if a.get("function", "count") not in AGGREGATES:
                raise ValueError(f"unsupported aggregate {a.get('function')!r}")
            column = resolve(a["column"], df.columns)
            cells.append(AGGREGATES[a.get("function", "count")](quoted(column)).alias(a.get("alias") or column))
        return rows.groupBy(*[quoted(k) for k in keys]).agg(*cells)
    raise ValueError(f"unsupported operation {operation!r}")


def preview(df: DataFrame, order: Sequence, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of an order with the total count on each."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*ordered.sort_keys(order)).limit(rows).withColumn("total_rows", total)


def run_learner_plan(df: DataFrame, plan: dict, tie: Sequence[str] = ()) -> DataFrame:
    """operation filter, aggregate, trend or rank with one column.

    A measure which is not a number drops its row (not for count), and rows
    without a group are dropped.  ``rank`` sorts by the measure, optionally
    with one (best) row per group; ties follow ``tie``.
    """
    operation, function = plan["operation"], plan.get("function")
    if plan.get("where"):
        df = df.filter(folded_condition(df, plan["where"]))
    if operation == "filter":
        return df.filter(folded_condition(df, plan))
    column = resolve(plan["column"], df.columns)
    group = resolve(plan["group_by"], df.columns) if plan.get("group_by") else None
    if function != "count":
        df = df.withColumn(column, number(quoted(column), df.schema[column].dataType)).filter(quoted(column).isNotNull())
    if operation == "trend":
        if plan.get("frequency") != "month":
            raise ValueError("only monthly trends are known")
        df = df.withColumn(group, F.date_format(timestamp(quoted(group), df.schema[group].dataType), "yyyy-MM"))
    if function:
        if function not in AGGREGATES or group is None:
            raise ValueError("an aggregate needs a known function and a group")
        rows = df.filter(quoted(group).isNotNull())
        df = rows.groupBy(quoted(group)).agg(AGGREGATES[function](quoted(column)).alias(column))
    elif operation != "rank":
        raise ValueError("the plan has no aggregate")
    if operation == "rank":
        down, limit = plan["direction"] == "desc", plan["limit"]
        if plan["direction"] not in ("asc", "desc") or not isinstance(limit, int) or limit < 1:
            raise ValueError("rank needs a direction and a positive limit")
        order = ordered.sort_keys([(column, down), *([group] if group and function else []), *tie])
        if group and not function:
            best = Window.partitionBy(quoted(group)).orderBy(*order)
            df = df.withColumn("__row", F.row_number().over(best)).filter("__row = 1").drop("__row")
        df = df.orderBy(*order).limit(limit)
    return df


def pivot_summary(df: DataFrame, rows: Sequence[str], values: Sequence[dict], column: str | None = None) -> DataFrame:
    """Row fields against (field, operation) pairs; rows without a key are
    dropped.  ``column`` spreads its values over columns (an addition)."""
    keys = resolve_all(rows, df.columns)
    kept = df.dropna(subset=keys)
    cells = []
    for v in values:
        name, operation = resolve(v["field"], df.columns), v["operation"]
        cell = quoted(name) if operation == "count" else number(quoted(name), df.schema[name].dataType)
        cells.append(AGGREGATES[operation](cell).alias(v.get("alias") or f"{operation}_{name}"))
    grouped = kept.groupBy(*[quoted(k) for k in keys])
    return (grouped.pivot(resolve(column, df.columns)) if column else grouped).agg(*cells)


def extreme_rows(df: DataFrame, column: str, n: int, highest: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Rows with the n largest (smallest) numbers; ties follow ``tie``."""
    name = resolve(column, df.columns)
    value = number(quoted(name), df.schema[name].dataType)
    key = value.desc_nulls_last() if highest else value.asc_nulls_last()
    return df.filter(value.isNotNull()).orderBy(key, *ordered.sort_keys(tie)).limit(n)


def audit_result(result: DataFrame, filters: list[dict], needed: Sequence[str] = ()) -> DataFrame:
    """(check, violations): rows which break each promised predicate, and the
    columns the result lacks."""
    checks, cells = [], []
    for i, f in enumerate(filters):
        label = f"{f['column']} {f['operator']} {f['value']}"
        if f["column"] not in result.columns:
            checks.append((f"missing column {f['column']}", F.count(F.lit(1))))
            continue
        test = compare(quoted(f["column"]), result.schema[f["column"]].dataType, f["operator"], f["value"])
        checks.append((label, F.count_if(~F.coalesce(test, F.lit(False)))))
    checks += [(f"missing column {c}", F.lit(1).cast("long")) for c in needed if c not in result.columns]
    if not checks:
        return result.sparkSession.createDataFrame([], "check string, violations long")
    one = result.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(f"v{i}") for i, (_, c) in enumerate(checks)])
    cells = [F.struct(F.lit(n).alias("check"), F.col(f"v{i}").cast("long").alias("violations")) for i, (n, _) in enumerate(checks)]
    return one.select(F.inline(F.array(*cells)))
