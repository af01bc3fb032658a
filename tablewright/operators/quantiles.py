"""Exact quantiles with bounded memory.

Spark's ``percentile`` keeps every distinct value of a column in one reducer.
That is used up to ``DIRECT_ROWS``.  Above it each wanted rank is bracketed by
approximate quantiles, the rows on both sides of the bracket are counted
exactly, and the bracket shrinks until what is inside fits a short list.  Every
round is one aggregate with map-side combine; the driver sees a few numbers
per column, and the result is exact whatever the distribution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..functions.parsing import number

DIRECT_ROWS = 10_000
LIST_ROWS = 20_000
ACCURACY = 2_000
SLACK = 2.0 / ACCURACY


@dataclass
class Bracket:
    """An open interval around a rank, and the rows at or below its low end
    and inside it."""

    low: float
    high: float
    below: int
    inside: int

    def within(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low > -math.inf:
            test = test & (value > self.low)
        if self.high < math.inf:
            test = test & (value < self.high)
        return F.when(test, value)


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], direct_rows: int | None = None, approximate: bool = False
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; ``None`` for no values."""
    if not columns:
        return {}
    values = {c: number(quoted(c), df.schema[c].dataType) for c in columns}
    wanted = [float(p) for p in probabilities]
    ends = sorted({min(1.0, max(0.0, p + d)) for p in wanted for d in (-SLACK, SLACK)})
    asked = F.array(*[F.lit(p) for p in (wanted if approximate else ends)])
    first = df.agg(*[
        e for i, v in enumerate(values.values()) for e in (F.count(v).alias(f"n{i}"), F.percentile_approx(v, asked, ACCURACY).alias(f"q{i}"))
    ]).first()
    if approximate:
        return {c: list(first[f"q{i}"] or [None] * len(wanted)) for i, c in enumerate(columns)}

    sizes = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    limit = DIRECT_ROWS if direct_rows is None else direct_rows
    result: dict[str, list[float | None]] = {c: [None] * len(wanted) for c in columns if sizes[c] == 0}
    small = [c for c in columns if 0 < sizes[c] <= limit]
    if small:
        points = F.array(*[F.lit(p) for p in wanted])
        row = df.agg(*[F.percentile(values[c], points).alias(f"c{i}") for i, c in enumerate(small)]).first()
        result.update({c: list(row[f"c{i}"]) for i, c in enumerate(small)})

    large = [c for c in columns if sizes[c] > limit]
    if large:
        ranks = {(c, f(p * (sizes[c] - 1))) for c in large for p in wanted for f in (math.floor, math.ceil)}
        guesses = {c: sorted(set(first[f"q{i}"])) for i, c in enumerate(columns) if c in large}
        found = _by_rank(df, values, sizes, ranks, guesses)
        for c in large:
            result[c] = []
            for p in wanted:
                place = p * (sizes[c] - 1)
                low, high = found[c, math.floor(place)], found[c, math.ceil(place)]
                result[c].append(low + (high - low) * (place - math.floor(place)))
    return {c: result[c] for c in columns}


def _by_rank(df: DataFrame, values: dict[str, Column], sizes: dict[str, int], ranks, guesses: dict[str, list[float]]):
    """Value at each (column, 0-based rank)."""
    brackets = {t: Bracket(-math.inf, math.inf, 0, sizes[t[0]]) for t in ranks}
    found: dict[tuple[str, int], float] = {}
    while brackets:
        _narrow(df, values, brackets, guesses, found)
        short = sorted(t for t, b in brackets.items() if b.inside <= LIST_ROWS)
        if short:
            # Targets of one bracket share its list.
            lists = {(t[0], brackets[t].low, brackets[t].high): brackets[t].within(values[t[0]]) for t in short}
            row = df.agg(*[F.array_sort(F.collect_list(v)).alias(f"l{i}") for i, v in enumerate(lists.values())]).first()
            held = {k: row[f"l{i}"] for i, k in enumerate(lists)}
            for t in short:
                b = brackets.pop(t)
                found[t] = held[t[0], b.low, b.high][t[1] - b.below]
        if brackets:
            guesses = _guess(df, values, brackets)
    return found


def _guess(df: DataFrame, values: dict[str, Column], brackets) -> dict[str, list[float]]:
    """Approximate ends closer around the open ranks."""
    targets = list(brackets)
    cells = []
    for i, t in enumerate(targets):
        b = brackets[t]
        share = (t[1] - b.below) / b.inside
        ends = F.array(F.lit(max(0.0, share - SLACK)), F.lit(min(1.0, share + SLACK)))
        cells.append(F.percentile_approx(b.within(values[t[0]]), ends, ACCURACY).alias(f"q{i}"))
    row = df.agg(*cells).first()
    guesses: dict[str, set[float]] = {}
    for i, t in enumerate(targets):
        guesses.setdefault(t[0], set()).update(row[f"q{i}"])
    return {c: sorted(ends) for c, ends in guesses.items()}


def _narrow(df: DataFrame, values: dict[str, Column], brackets, guesses: dict[str, list[float]], found) -> None:
    """Count the rows below and up to each guess and shrink the brackets; a
    rank which falls on a guess itself is found."""
    ends = [(c, e) for c, listed in guesses.items() for e in listed]
    row = df.agg(*[
        x for i, (c, e) in enumerate(ends)
        for x in (F.count_if(values[c] < e).alias(f"lt{i}"), F.count_if(values[c] <= e).alias(f"le{i}"))
    ]).first()
    for t in list(brackets):
        b = brackets[t]
        upper = b.below + b.inside
        for i, (c, e) in enumerate(ends):
            if c != t[0]:
                continue
            under, upto = row[f"lt{i}"], row[f"le{i}"]
            if under <= t[1] < upto:
                found[t] = e
                del brackets[t]
                break
            if upto <= t[1] and e > b.low:
                b.low, b.below = e, upto
            elif t[1] < under and e < b.high:
                b.high, upper = e, under
        else:
            b.inside = upper - b.below
