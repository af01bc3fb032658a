"""Ordered cleaning steps with a report.

A step which is unknown or names a missing column is recorded as skipped and
the others go on.  Checks use the schema; the data work stays lazy.  Row counts
of the report come from ``observe`` metrics, gathered in one run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, resolve, resolve_all
from ..functions.predicates import cleaning_condition
from ..operators import cleaning, projection
from ..operators.money import convert_column
from ..session import durable

REPORT = "step int, op string, status string, error string, rows_before long, rows_after long, cells_filled long"


def _columns(df: DataFrame, step: dict) -> list[str] | None:
    named = step.get("columns") or step.get("column") or step.get("subset")
    if named is None:
        return None
    return resolve_all([named] if isinstance(named, str) else named, df.columns)


def _fill(df, step):
    strategy = step.get("strategy") or step.get("method") or "smart"
    columns = _columns(df, step)
    if strategy == "forward_fill":
        order, keys = step["order_by"], step.get("partition_by") or ()
        return lambda d: cleaning.forward_fill(d, order, columns, keys), 0
    if strategy == "drop":
        return lambda d: cleaning.drop_missing(d, columns), 0
    if strategy == "backtrack":
        return lambda d: cleaning.back_solve(d, step["inverse"]), 0
    custom = step.get("custom_value", step.get("value"))
    values, report = cleaning.fill_values(df, strategy, columns or df.columns, custom)
    return lambda d: cleaning.apply_fill(d, values), sum(r[1] for r in report if r[2] != "dropped")


def _duplicates(df, step):
    subset = _columns(df, {"subset": step.get("subset")})
    return lambda d: cleaning.remove_duplicates(d, subset, step.get("keep", "first"), step.get("order_by")), 0


def _filter(df, step):
    return lambda d: d.filter(cleaning_condition(d, step["column"], step.get("operator", "not_equals"), step.get("value"))), 0


def _outliers(df, step):
    work = {"cap": cleaning.cap_outliers, "remove": cleaning.remove_outliers, "mark": cleaning.mark_outliers}
    method, multiplier = work[step.get("method", "cap")], step.get("multiplier", 1.5)
    bounds = cleaning.iqr_bounds(df, _columns(df, step) or numeric_columns(df), multiplier)
    return lambda d: method(d, list(bounds), multiplier, bounds=bounds), 0


def _types(df, step):
    kinds = cleaning.text_kinds(df)
    return lambda d: cleaning.to_inferred_types(d, kinds), 0


def _currency(df, step):
    column = resolve(step["column"], df.columns)
    target = step.get("new_column") or f"{column}_{step.get('to', 'converted')}"
    return lambda d: convert_column(d, column, float(step["rate"]), target), 0


def _plain(work):
    return lambda df, step: (lambda d: work(d, step), 0)


# Each entry turns (schema, step) into a table function and the number of
# cells it fills.
_headers = _plain(lambda d, s: projection.standardise_names(d))
STEPS = {
    "standardize_columns": _headers, "standardize_cols": _headers, "clean_headers": _headers,
    "handle_missing_values": _fill, "fill_nulls": _fill,
    "remove_duplicates": _duplicates, "filter_rows": _filter, "handle_outliers": _outliers,
    "normalize_text": _plain(lambda d, s: cleaning.normalise_text(d)),
    "infer_types": _types,
    "remove_empty_rows": _plain(lambda d, s: cleaning.drop_empty_rows(d)),
    "remove_sparse_rows": _plain(lambda d, s: cleaning.drop_sparse_rows(d, s.get("threshold", 0.5))),
    "convert_currency": _currency,
}
# Steps which shuffle the table, and steps which need statistics of it.
SHUFFLING = {"remove_duplicates"}
MEASURING = {"handle_missing_values", "fill_nulls", "handle_outliers", "infer_types"}


@dataclass
class CleaningRun:
    source: DataFrame
    table: DataFrame
    entries: list[dict]

    def report(self) -> DataFrame:
        """One row per step.  Counts the rows after every step in one run of
        a second chain, so that ``table`` itself keeps its pushdown."""
        metrics, current = [], self.source

        def watched(frame: DataFrame) -> DataFrame:
            metrics.append(Observation())
            return frame.observe(metrics[-1], F.count(F.lit(1)).alias("rows"))

        current = watched(current)
        places = []
        for e in self.entries:
            before = len(metrics) - 1
            if e["work"] is not None:
                current = watched(e["work"](current))
            places.append((before, len(metrics) - 1))
        current.write.format("noop").mode("overwrite").save()
        counts = [m.get["rows"] for m in metrics]
        rows = [
            (e["step"], e["op"], e["status"], e["error"], counts[a], counts[b], e["cells"])
            for e, (a, b) in zip(self.entries, places)
        ]
        return self.table.sparkSession.createDataFrame(rows, REPORT)


def run_steps(df: DataFrame, steps: list[dict]) -> CleaningRun:
    """Apply the steps in order.  A shuffled table is written once before
    statistics are taken of it, so that no statistic repeats the shuffle."""
    current, entries, shuffled = df, [], False
    for i, step in enumerate(steps, start=1):
        op = step.get("op")
        entry = {"step": i, "op": op, "status": "done", "error": None, "cells": 0, "work": None}
        entries.append(entry)
        if op not in STEPS:
            entry.update(status="skipped", error=f"unknown step {op!r}")
            continue
        if shuffled and op in MEASURING:
            current, shuffled = durable(current), False
        try:
            work, cells = STEPS[op](current, step)
            current = work(current)
        except (ValueError, KeyError) as error:
            entry.update(status="skipped", error=str(error))
            continue
        entry.update(work=work, cells=cells)
        shuffled = shuffled or op in SHUFFLING
    return CleaningRun(df, current, entries)


def full_clean(df: DataFrame, strategy: str = "smart", outliers: str | None = None) -> CleaningRun:
    """The fixed order: names, duplicates, empty rows, gaps, text, types,
    and outliers on request."""
    steps = [{"op": "standardize_columns"}, {"op": "remove_duplicates"}, {"op": "remove_empty_rows"},
             {"op": "handle_missing_values", "strategy": strategy}, {"op": "normalize_text"}, {"op": "infer_types"}]
    if outliers:
        steps.append({"op": "handle_outliers", "method": outliers})
    return run_steps(df, steps)
