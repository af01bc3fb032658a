"""Work which follows an order, spread over many tasks.

A plain window sends each of its partitions, or the whole table when there is
none, to one task.  Here the rows are range-partitioned by (keys, order)
instead: a hot key is cut into consecutive chunks, each chunk is scanned by its
own task, and only one summary row per (key, chunk) is combined across chunks.

The chunk number is taken from the physical partition, so the chunked table is
checkpointed before it is used twice.  ``small=True`` is for series whose length
is bounded by their meaning (months, report lines); it uses a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import durable

CHUNK, INDEX, BLOCK = "__chunk", "__index", "__block"


def sort_key(spec: str | tuple[str, bool]) -> Column:
    """``"c"`` or ``("c", descending)``; nulls last either way."""
    name, descending = (spec, False) if isinstance(spec, str) else spec
    column = quoted(name)
    return column.desc_nulls_last() if descending else column.asc_nulls_last()


def sort_keys(order: Sequence) -> list[Column]:
    return [sort_key(o) for o in order]


def order_names(order: Sequence) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which nulls match each other; the keys come from the left."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def _split(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    ranged = df.repartitionByRange(*[quoted(k).asc_nulls_last() for k in keys], *sort_keys(order))
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _carried(chunks: DataFrame, keys: Sequence[str], summary: dict[str, Column], carry) -> DataFrame:
    """Add to each row the state left by the earlier chunks of its key.

    The table of summaries has one row per (key, chunk): at most the number
    of chunks for any key, however hot.
    """
    per_chunk = chunks.groupBy(*[quoted(k) for k in keys], CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    earlier = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    states = per_chunk.select(*[quoted(k) for k in keys], CHUNK, *[carry(n).over(earlier).alias(n) for n in summary])
    return join_on(chunks, states, [*keys, CHUNK])


def row_index(df: DataFrame, order: Sequence, keys: Sequence[str] = (), out: str = INDEX, small: bool = False) -> DataFrame:
    """Row number from 1 in each key."""
    if small:
        window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*sort_keys(order))
        return df.withColumn(out, F.row_number().over(window).cast("long"))
    chunks = _split(df, keys, order)
    inside = Window.partitionBy(CHUNK, *[quoted(k) for k in keys]).orderBy(*sort_keys(order))
    state = _carried(chunks, keys, {"__before": F.count(F.lit(1))}, F.sum)
    return state.withColumn(out, F.row_number().over(inside) + F.coalesce("__before", F.lit(0))).drop("__before", CHUNK)


def running_total(
    df: DataFrame, value: str, order: Sequence, keys: Sequence[str] = (), out: str = "running_total", small: bool = False
) -> DataFrame:
    """Sum over the rows up to and including this one, in each key."""
    if small:
        window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*sort_keys(order))
        return df.withColumn(out, F.sum(quoted(value)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = _split(df, keys, order)
    inside = Window.partitionBy(CHUNK, *[quoted(k) for k in keys]).orderBy(*sort_keys(order))
    local = F.sum(quoted(value)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    state = _carried(chunks, keys, {"__before": F.sum(quoted(value))}, F.sum)
    total = F.coalesce(local + F.col("__before"), local, F.col("__before"))
    return state.withColumn(out, total).drop("__before", CHUNK)


def with_neighbours(
    df: DataFrame, order: Sequence, reach: int, columns: dict, keys: Sequence[str] = (), small: bool = False, index: str | None = None
) -> DataFrame:
    """Window expressions which look back at most ``reach`` rows.

    ``columns`` maps a name to ``f(window) -> Column``.  Rows are cut into
    blocks by their index; the last ``reach`` rows of a block are also sent to
    the next one as context and dropped after use.
    """
    if small:
        window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*sort_keys(order))
        return df.select("*", *[f(window).alias(n) for n, f in columns.items()])
    position = index or INDEX
    numbered = df if index else row_index(df, order, keys, INDEX)
    length = max(1 << 16, 8 * (reach + 1))
    own = F.floor((F.col(position) - 1) / F.lit(length)).cast("long")
    last_rows = (F.col(position) - 1) % length >= length - reach
    spread = numbered.withColumn("__own", own).withColumn(
        BLOCK, F.explode(F.when(last_rows, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own")))
    )
    window = Window.partitionBy(*[quoted(k) for k in keys], BLOCK).orderBy(position)
    looked = spread.select("*", *[f(window).alias(n) for n, f in columns.items()]).filter(F.col(BLOCK) == F.col("__own"))
    return looked.drop(BLOCK, "__own") if index else looked.drop(BLOCK, "__own", INDEX)


def moving_average(
    df: DataFrame, value: str, order: Sequence, size: int = 3, keys: Sequence[str] = (), out: str = "moving_avg", small: bool = False
) -> DataFrame:
    """Mean of this row and the ``size - 1`` before it, in each key."""
    reach = max(size - 1, 0)
    mean = lambda w: F.avg(quoted(value)).over(w.rowsBetween(-reach, 0))
    return with_neighbours(df, order, reach, {out: mean}, keys, small)


def rank(df: DataFrame, order: Sequence, keys: Sequence[str] = (), dense: bool = False, out: str = "rnk") -> DataFrame:
    """``rank`` or ``dense_rank`` without sorting a whole key in one task.

    The rank of a row depends only on how many rows (or distinct values)
    come before its order value, so values are counted first and scanned.
    """
    names = list(dict.fromkeys([*keys, *order_names(order)]))
    counts = df.groupBy(*[quoted(n) for n in names]).agg(F.lit(1).alias("__one") if dense else F.count(F.lit(1)).alias("__one"))
    scanned = running_total(counts, "__one", order, keys, "__upto")
    first = F.col("__upto") if dense else F.col("__upto") - F.col("__one") + 1
    return join_on(df, scanned.select(*[quoted(n) for n in names], first.cast("long").alias(out)), names)


def forward_fill(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Replace nulls by the last value before them.  Leading nulls stay."""
    chunks = _split(df, keys, order)
    inside = Window.partitionBy(CHUNK, *[quoted(k) for k in keys]).orderBy(*sort_keys(order))
    place = F.struct(*[quoted(n) for n in order_names(order)])
    # Order is ascending here, so the greatest place with a value is the last.
    summary = {f"__last_{c}": F.max_by(quoted(c), F.when(quoted(c).isNotNull(), place)) for c in columns}
    state = _carried(chunks, keys, summary, lambda n: F.last(n, ignorenulls=True))
    filled = {
        c: F.coalesce(
            F.last(quoted(c), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"__last_{c}")
        )
        for c in columns
    }
    return state.withColumns(filled).select(*[quoted(c) for c in df.columns])


def group_value(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of each row's group, put on the row.

    Grouped with map-side combine and joined back, so that a hot group is
    not buffered by one window task (the join may split it).
    """
    summary = df.groupBy(*[quoted(k) for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])
    return join_on(df, summary, keys)
