"""Equal columns of one table, and keys across tables, from sketches.

Comparing every pair of columns cell by cell, or every value of every table,
grows with the square of the columns or moves all tables.  Here a first pass
takes a sketch of each column, pairs which the sketches rule out are never
looked at, and only the pairs left are counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from copy import copy
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import durable
from .profile import long_form

# Suffixes of a key's name.
KEY_SUFFIXES = ("_id", "_key", "_code")
#: Standard errors by which a sketch must miss before a pair is ruled out.
ERRORS = 6


def foreign_key_name(name: str, position: int, suffixes: Sequence[str] = KEY_SUFFIXES) -> bool:
    low = name.strip().lower()
    keyed = low.endswith(tuple(suffixes)) or (low.endswith("id") and len(low) > 2)
    return keyed and position > 0


def cell_text(column: str) -> Column:
    return quoted(column).cast("string")


# ---- equal columns -----------------------------------------------------------

#: Bands of sampled rows, the most rows in a band, pairs counted in one pass.
BANDS, BAND_ROWS, PAIRS_PER_PASS = 128, 16, 400
#: Below this share of equal rows bands tell nothing and all pairs are counted.
LOOSE = 0.3
PAIR = "column_a string, column_b string, equal_ratio double"


def duplicate_columns(df: DataFrame, minimum: float = 0.98) -> DataFrame:
    """Column pairs whose texts agree in at least this share of rows; two
    nulls agree.

    One scan gives each column a signature of all its cells and one per band
    of sampled rows (a row's cells are hashed with the row's own random tag).
    Columns with one signature are equal and are represented by the first of
    them.  Representatives which agree as often as asked share many bands;
    those pairs are counted exactly, PAIRS_PER_PASS in an aggregate.
    """
    columns = df.columns
    if minimum < LOOSE:
        return _counted(df, [(a, b) for a, b in combinations(range(len(columns)), 2)], minimum)
    signs = _signatures(df, minimum)
    whole = signs.groupBy("c").agg(F.bit_xor("sign").alias("sign"))
    classes = durable(whole.select("c", F.col("sign").alias("whole")).join(whole.groupBy(F.col("sign").alias("whole")).agg(F.min("c").alias("first")), "whole").select("c", "first"))
    bands = signs.join(classes.filter("c = first").select("c"), "c", "left_semi").filter("band >= 0")
    left, right = (bands.select("band", "sign", F.col("c").alias(n)) for n in "ab")
    met = left.join(right, ["band", "sign"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    candidates = [(r["a"], r["b"]) for r in met.filter(F.col("met") >= _least_met(df.count(), minimum)).sort("a", "b").collect()]
    counted = _counted(df, candidates, minimum, by_place=True)
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "c int, name string")

    members = {n: classes.select(F.col("first").alias(f"{n}_first"), F.col("c").alias(n)) for n in "ab"}
    inside = members["a"].join(members["b"], F.col("a_first") == F.col("b_first")).filter("a < b").select("a", "b", F.lit(1.0).alias("equal_ratio"))
    across = counted.join(members["a"], "a_first").join(members["b"], "b_first").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "equal_ratio")
    for n in "ab":
        named = names.select(F.col("c").alias(n), F.col("name").alias(f"column_{n}"))
        inside, across = inside.join(named, n), across.join(named, n)
    # Without rows no pair agrees in any share of them.
    return inside.unionByName(across).select("column_a", "column_b", "equal_ratio")


def _band_rows(minimum: float) -> int:
    return min(BAND_ROWS, max(1, int(math.log(LOOSE) / math.log(minimum)))) if minimum < 1 else BAND_ROWS


def _signatures(df: DataFrame, minimum: float) -> DataFrame:
    """(band, c, sign): the signature of column number ``c`` in each band of
    sampled rows, and in the rest of the rows as band -1."""
    rows = df.count()
    share = min(1.0, BANDS * _band_rows(minimum) / max(rows, 1))
    band = F.when(F.col("__tag") < share, F.floor(F.col("__dealt") * BANDS)).otherwise(-1).cast("int")
    tagged = df.withColumns({"__tag": F.rand(17), "__dealt": F.rand(18)})
    sums = [F.bit_xor(F.xxhash64("__tag", cell_text(c))).alias(f"s{i}") for i, c in enumerate(df.columns)]
    per_band = tagged.withColumn("__band", band).groupBy(F.col("__band").alias("band")).agg(*sums)
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"s{i}").alias("sign")) for i in range(len(df.columns))]))
    return durable(per_band.select("band", cells))


def _least_met(rows: int, minimum: float) -> int:
    """Bands which two columns as equal as asked have in common all but surely."""
    width = _band_rows(minimum)
    if rows < BANDS * width:
        return 1
    equal = math.exp(-width * (1 - minimum))
    return max(1, int(BANDS * equal - ERRORS * math.sqrt(BANDS * equal * (1 - equal))))


def _counted(df: DataFrame, pairs: Sequence[tuple[int, int]], minimum: float, by_place: bool = False) -> DataFrame:
    """The pairs of column numbers whose share of equal rows is large enough."""
    schema = "a_first int, b_first int, equal_ratio double" if by_place else PAIR
    result = df.sparkSession.createDataFrame([], schema)
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        batch = pairs[start : start + PAIRS_PER_PASS]
        equal = lambda a, b: cell_text(df.columns[a]).eqNullSafe(cell_text(df.columns[b])).cast("double")
        one = df.agg(*[F.avg(equal(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(batch)])
        named = (lambda a: F.lit(a)) if by_place else (lambda a: F.lit(df.columns[a]))
        ends = result.columns
        rows = [{ends[0]: named(a), ends[1]: named(b), "equal_ratio": F.round(F.col(f"p{i}"), 4), "raw": F.col(f"p{i}")} for i, (a, b) in enumerate(batch)]
        result = result.unionByName(long_form(one, rows).filter(F.col("raw") >= minimum).drop("raw"))
    return result


# ---- keys across tables ----------------------------------------------------

#: Sampled values of a column: between this and about four times as many.
SAMPLE = 1_024
#: Relative error of the counts of distinct values, and signs of a range's ends.
SPREAD, RANGE_SIGNS = 0.02, 64
#: Uniqueness × filled share at which a column may be a key, halved for a
#: column without a key-like name.
KEY_LIKENESS = 0.45
#: Sources' values which are broadcast at most.
BROADCAST_VALUES = 500_000
#: Cells of which one task looks for the distinct ones or their counterparts.
TASK_CELLS = 1_000_000


def value_overlap(source: DataFrame, source_column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Share of the source's distinct values which the target has."""
    left = source.select(cell_text(source_column).alias("value")).filter("value is not null").distinct()
    right = target.select(cell_text(target_column).alias("value")).filter("value is not null").distinct()
    hit = left.join(right.withColumn("hit", F.lit(1)), "value", "left")
    return hit.agg(F.count(F.lit(1)).alias("source_values"), F.count("hit").alias("shared"),
                   F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("overlap"))


class Columns:
    """What one scan tells of the columns of several tables: number, rows,
    filled cells, an estimate of the distinct texts and the ends of their range."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables, self.spark = tables, next(iter(tables.values())).sparkSession
        self._number({t: df.columns for t, df in tables.items()})
        parts = []
        for name, df in tables.items():
            sums = [F.count(F.lit(1)).alias("rows")]
            for i, c in enumerate(df.columns):
                sums += [measure.alias(f"{n}{i}") for n, measure in _facts(cell_text(c)).items()]
            rows = [{"c": F.lit(self.ids[name, c]), "rows": F.col("rows"), **{n: F.col(f"{n}{i}") for n in _facts(F.lit(""))}} for i, c in enumerate(df.columns)]
            parts.append(long_form(df.agg(*sums), rows))
        # One row per column.
        self.facts = {r["c"]: r for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}

    def _number(self, names: dict[str, Sequence[str]]) -> None:
        self.names = names
        self.ids = {key: i for i, key in enumerate((t, c) for t, columns in names.items() for c in columns)}
        self.keys = list(self.ids)

    def may_be_key(self, c: int) -> bool:
        fact = self.facts[c]
        if fact["rows"] <= 1:
            return False
        distinct = min(fact["distinct"] * (1 + ERRORS * SPREAD), fact["filled"])
        return distinct / fact["rows"] * (fact["filled"] / fact["rows"]) * 0.5 >= KEY_LIKENESS - 0.0001

    def level(self, c: int) -> int:
        """Leading zeros a hash must have to be sampled."""
        return max(0, math.ceil(math.log2(max(self.facts[c]["distinct"], 1) / (2 * SAMPLE))))

    def apart(self, a: int, b: int) -> bool:
        """Whether no text of one column can be one of the other."""
        a, b = self.facts[a], self.facts[b]
        return not a["filled"] or not b["filled"] or a["high"] < b["low"] or b["high"] < a["low"]

    def cells(self, wanted: Iterable[int], cell, levels: dict[int, int] | None = None) -> DataFrame | None:
        """One row per cell which is not null (and sampled at its column's
        level) of the wanted columns: ``c`` and the struct ``cell(text)``."""
        wanted, parts = set(wanted), []
        for name, df in self.tables.items():
            made = []
            for c in df.columns:
                i, text = self.ids[name, c], cell_text(c)
                if i in wanted:
                    good = text.isNotNull() if not levels else text.isNotNull() & (_zeros(F.xxhash64(text)) >= levels[i])
                    made.append(F.when(good, F.struct(F.lit(i).alias("c"), cell(text).alias("cell"))))
            if made:
                parts.append(df.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("x.c", "x.cell.*"))
        return reduce(DataFrame.unionByName, parts) if parts else None


class LongColumns(Columns):
    """The same for tables whose cells lie in one long table (dataset,
    position, value), one row per cell, so that jobs and plans do not grow with
    the number of tables."""

    #: Columns told by what ``number`` makes of their text, not by the text.
    numeric: frozenset[int] = frozenset()
    number: Column | None = None

    def __init__(self, names: dict[str, Sequence[str]], long: DataFrame) -> None:
        self.spark = long.sparkSession
        self._number(names)
        places = [(t, p, self.ids[t, c]) for t, columns in names.items() for p, c in enumerate(columns)]
        # One row per column, which travels to the cells.
        places = F.broadcast(self.spark.createDataFrame(places, "dataset string, position int, c int"))
        self.long = long.join(places, ["dataset", "position"]).select("c", "value")
        # The ends of a range as numbers: extremes of texts would be found by sorting all cells.
        facts = _facts(F.col("value")) | {"low": F.min(_place(F.col("value"))), "high": F.max(_place(F.col("value")))}
        found = self.long.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in facts.items()])
        self.facts = {r["c"]: r for r in found.collect()}
        nothing = {"rows": 0, "filled": 0, "distinct": 0, "low": None, "high": None}
        self.facts |= {c: nothing for c in self.ids.values() if c not in self.facts}

    def cells(self, wanted: Iterable[int], cell, levels: dict[int, int] | None = None) -> DataFrame | None:
        wanted = sorted(set(wanted))
        if not wanted:
            return None
        chosen = F.broadcast(self.spark.createDataFrame([(c, (levels or {}).get(c, 0), c in self.numeric) for c in wanted], "c int, level int, numeric boolean"))
        text = F.col("value") if self.number is None else F.when(F.col("numeric"), self.number).otherwise(F.col("value"))
        rows = self.long.filter("value is not null").join(chosen, "c")
        if levels:
            rows = rows.filter(_zeros(F.xxhash64(text)) >= F.col("level"))
        return rows.select("c", cell(text).alias("cell")).select("c", "cell.*")

    def distinct_counts(self, numeric: Iterable[int], number: Column) -> DataFrame:
        """(c, distinct): exact numbers of distinct cells, which are told by
        the column ``number`` of ``value`` in numeric columns, else by text."""
        read = copy(self)
        read.numeric, read.number = frozenset(numeric), number
        cells = _distinct(read, (c for c, fact in self.facts.items() if fact["filled"]))
        if cells is None:
            return self.spark.createDataFrame([], "c int, distinct long")
        return cells.groupBy("c").agg(F.count(F.lit(1)).alias("distinct"))


def _dealt(found: Columns, wanted: Iterable[int], also: int = 0) -> tuple[DataFrame | None, int]:
    """The cells of the wanted columns as 128-bit hashes, dealt by them into as
    many parts as hold TASK_CELLS each (``also`` counts with them), and how
    many these are.  Nothing is held where the cells lie, so a task's memory
    does not follow the size of its file."""
    wanted = list(wanted)
    cells = found.cells(wanted, _long_hash)
    parts = max(1, math.ceil((sum(found.facts[c]["filled"] for c in wanted) + also) / TASK_CELLS))
    return None if cells is None else cells.repartition(parts, "h", "g"), parts


def _distinct(found: Columns, wanted: Iterable[int]) -> DataFrame | None:
    """The distinct cells of the wanted columns.  Those of columns of few
    values, TASK_CELLS in all, are first brought together where they lie; the
    others are dealt at once, as hardly fewer would be left of them there or
    too many for a task."""
    few, many, held = [], [], 0.0
    for c in sorted(set(wanted), key=lambda c: found.facts[c]["distinct"]):
        held += found.facts[c]["distinct"] * (1 + ERRORS * SPREAD)
        (few if held <= TASK_CELLS and found.facts[c]["distinct"] * 4 <= found.facts[c]["filled"] else many).append(c)
    parts = [cells.distinct() for cells in (found.cells(few, _long_hash) if few else None, _dealt(found, many)[0] if many else None) if cells is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _facts(text: Column) -> dict[str, Column]:
    short = F.substring(text, 1, RANGE_SIGNS)
    return {"filled": F.count(text), "distinct": F.approx_count_distinct(text, SPREAD), "low": F.min(short), "high": F.max(short)}


def _place(text: Column) -> Column:
    """The first three signs as a number, in order of their code points."""
    signs = [F.ascii(F.substring(text, i, 1)).cast("long") for i in (1, 2, 3)]
    return F.shiftleft(signs[0], 42) + F.shiftleft(signs[1], 21) + signs[2]


def _hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"))


def _long_hash(text: Column) -> Column:
    """128 bits, which stand for the text."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def _zeros(h: Column) -> Column:
    return F.lit(64) - F.length(F.bin(h)) + F.when(h == 0, 1).otherwise(0)


LINK = "source_dataset string, source_column string, target_dataset string, target_column string, confidence double"


def relationships(
    tables: dict[str, DataFrame] | Columns, candidates: dict[str, Sequence[str]] | None = None, minimum: float = 0.8, suffixes: Sequence[str] = KEY_SUFFIXES
) -> DataFrame:
    """Foreign keys: candidate columns whose values lie in a key-like or
    same-named column of another table.

    Four jobs over all tables at once, whatever their number:

    1. counts, estimates and ranges of every column;
    2. of columns which may be an end, the hashes with enough leading zeros.
       All columns are sampled by the same rule, so the share of a source's
       sampled values which a target has estimates the share of all.  A pair
       stays unless it misses ``minimum`` by ERRORS standard errors;
    3. for pairs left, the source's distinct values are looked up in the
       targets' cells, exactly, by 128-bit hashes; cells which no source has
       are dropped where they lie if the values are few;
    4. for targets of pairs which really overlap, the exact number of distinct
       values decides whether they are key-like.

    Hashes are dealt into parts by the counts of job 1, so that a task holds
    TASK_CELLS of them, however large the tables or their files are.

    The driver sees numbers per column and per pair of columns.
    """
    found = tables if isinstance(tables, Columns) else Columns(tables)
    if candidates is None:
        candidates = {t: [c for i, c in enumerate(columns) if foreign_key_name(c, i, suffixes)] for t, columns in found.names.items()}
    sources = [found.ids[t, c] for t, cs in candidates.items() for c in cs if (t, c) in found.ids]
    pairs = _possible(found, sources, minimum)
    shared = _shared(found, pairs)
    pairs = {p: share for p, share in shared.items() if share >= minimum}
    asked = {t for s, t in pairs if not _same_name(found, s, t)}
    counts = _distinct(found, asked)
    distinct = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()} if counts is not None else {}

    def is_key(c: int) -> bool:
        fact = found.facts[c]
        return fact["rows"] > 1 and round(distinct.get(c, 0) / fact["rows"] * (fact["filled"] / fact["rows"]) * 0.5, 4) >= KEY_LIKENESS

    links = [(*found.keys[s], *found.keys[t], round(share, 4)) for (s, t), share in sorted(pairs.items()) if _same_name(found, s, t) or is_key(t)]
    return found.spark.createDataFrame(links, LINK)


def _same_name(found: Columns, s: int, t: int) -> bool:
    return found.keys[s][1].strip().lower() == found.keys[t][1].strip().lower()


def _possible(found: Columns, sources: Sequence[int], minimum: float) -> list[tuple[int, int]]:
    """Pairs which neither names, ranges nor samples rule out."""
    names = {found.keys[s][1].strip().lower() for s in sources}
    targets = [c for key, c in found.ids.items() if found.may_be_key(c) or key[1].strip().lower() in names]
    fits = [(s, t) for s in sources for t in targets if found.keys[s][0] != found.keys[t][0] and not found.apart(s, t) and (found.may_be_key(t) or _same_name(found, s, t))]
    levels = {c: found.level(c) for c in {c for p in fits for c in p}}
    samples = found.cells(levels, _hash, levels) if fits else None
    if samples is None:
        return []
    samples = durable(samples.distinct())
    own = {(r["c"], r["zeros"]): r["n"] for r in samples.groupBy("c", _zeros(F.col("h")).alias("zeros")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = samples.filter(F.col("c").isin(sorted({s for s, _ in fits}))).withColumnRenamed("c", "s")
    right = samples.filter(F.col("c").isin(sorted({t for _, t in fits}))).withColumnRenamed("c", "t")
    met = {(r["s"], r["t"]): r["n"] for r in left.join(right, "h").filter("s <> t").groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = []
    for s, t in fits:
        level = max(levels[s], levels[t])
        n = sum(count for (c, zeros), count in own.items() if c == s and zeros >= level)
        if met.get((s, t), 0) >= n * minimum - ERRORS * math.sqrt(n * minimum * (1 - minimum)):
            kept.append((s, t))
    return kept


def _shared(found: Columns, pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Of each pair, the exact share of the source's values in the target."""
    if not pairs:
        return {}
    sources = {s for s, _ in pairs}
    values = durable(_distinct(found, sources).withColumnRenamed("c", "s"))
    sizes = {r["s"]: r["n"] for r in values.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    targets, looked = {t for _, t in pairs}, sum(sizes.values())
    if looked <= BROADCAST_VALUES:
        cells = found.cells(targets, _long_hash).join(F.broadcast(values.select("h", "g").distinct()), ["h", "g"], "left_semi")
    else:
        cells, parts = _dealt(found, targets, looked)
        values = values.repartition(parts, "h", "g")
    cells = cells.distinct().withColumnRenamed("c", "t")
    wanted = F.broadcast(found.spark.createDataFrame(list(pairs), "s int, t int"))
    met = values.join(cells, ["h", "g"]).join(wanted, ["s", "t"], "left_semi").groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))
    return {(r["s"], r["t"]): r["n"] / sizes[r["s"]] for r in met.collect()}


def upgrade_foreign_keys(roles: DataFrame, links: DataFrame) -> DataFrame:
    """Role ``foreign_key`` for columns with a found relationship, whether or
    not a rule gave them a role before."""
    best = links.groupBy(F.col("source_dataset").alias("dataset"), F.col("source_column").alias("column")).agg(F.max("confidence").alias("__c"))
    joined = roles.join(best, ["dataset", "column"], "full_outer")
    found = F.col("__c").isNotNull()
    return joined.select(
        "dataset", "column", F.when(found, "foreign_key").otherwise(F.col("role")).alias("role"),
        F.when(found, F.col("__c")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(found, "relationship").otherwise(F.col("rule")).alias("rule"), "evidence",
    )
