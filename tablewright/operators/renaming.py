"""Known names replaced by their aliases, however many there are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..session import durable, written
from .bitfilter import BitFilter, unused

#: Names which travel to the tasks at most, and their signs; more are joined.
TRAVELLING_NAMES, TRAVELLING_SIGNS = 200_000, 20_000_000
#: Names beyond which a table is refused, which no cluster's table reaches.
MOST_NAMES = 1 << 40
#: Candidates which a task hands on at once.
CANDIDATES = 50_000


def folded(text: str) -> str:
    """Lower case sign by sign, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def is_word(sign: str) -> bool:
    return sign.isalnum() or sign == "_"  # also no sign at all is none


def put(text: str, low: str, found: list[tuple[int, str, int]], aliases: dict[str, str]) -> str:
    """``text`` with the names ``found`` (minus length, name, place) replaced,
    the longest first, of names as long the smaller first."""
    held, taken = bytearray(len(text)), []
    for size, name, at in sorted(found):
        end = at - size
        if not any(held[at:end]):
            held[at:end] = b"\x01" * (end - at)
            taken.append((at, end, aliases[name]))
    out, last = [], 0
    for at, end, alias in sorted(taken):
        out += [text[last:at], alias]
        last = end
    return "".join([*out, text[last:]])


class Names:
    """Names by themselves, and their lengths by the word or sign they begin
    with: at each place of a text a few lengths are looked up."""

    #: A run of word signs, or one other sign.
    START = re.compile(r"\w+|\W", re.DOTALL)

    def __init__(self, aliases: list[tuple[str, str]]) -> None:
        lengths: dict[str, set[int]] = {}
        self.aliases = {folded(n): a for n, a in sorted(aliases, reverse=True)}
        for name in self.aliases:
            lengths.setdefault(self.START.match(name)[0], set()).add(len(name))
        self.lengths = {start: sorted(found) for start, found in lengths.items()}

    def replaced(self, text: str) -> str:
        low, found = folded(text), []
        for start in self.START.finditer(low):
            at = start.start()
            for length in self.lengths.get(start[0], ()):
                end = at + length
                name = low[at:end]
                free = (at == 0 or not is_word(low[at - 1])) and not is_word(low[end : end + 1])
                if free and end <= len(low) and name in self.aliases:
                    found.append((-length, name, at))
        return put(text, low, found, self.aliases)


def rename_names(df: DataFrame, column: str, aliases: DataFrame, name: str = "name", alias: str = "alias") -> DataFrame:
    """``df`` with the names of the table ``aliases`` replaced in a text column:
    whole words in any case, longest names first, of names as long the smaller
    first; an alias is not searched again.  Null and empty names are skipped,
    of a name with several aliases the smallest counts.

    The table of names is looked at first: up to TRAVELLING_NAMES names it
    travels to every task, where a text is searched once for all names.  Larger
    ones stay where they are and are joined (``_joined``).
    """
    known = aliases.select(quoted(name).cast("string").alias("n"), quoted(alias).cast("string").alias("a")).filter("n <> '' and a is not null")
    known = known.groupBy("n").agg(F.min("a").alias("a"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("n") + F.length("a")), F.lit(0)).alias("signs")).first()
    if size["n"] > MOST_NAMES:
        raise ValueError(f"{size['n']} names are too many")
    texts, at = df.withColumn(column, quoted(column).cast("string")), df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(df.schema)])
    if size["n"] > TRAVELLING_NAMES or size["signs"] > TRAVELLING_SIGNS:
        return _joined(texts, column, known, schema)
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [None if t is None else names.replaced(t) for t in part.column(at).to_pylist()]
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return texts.mapInArrow(run, schema)


def _joined(texts: DataFrame, column: str, known: DataFrame, schema: T.StructType) -> DataFrame:
    """The same by a join of what may be a name in a text with the names.

    A text is searched for runs as long as some name which stand by themselves;
    a filter of bits drops most that are no names where the texts lie, the rest
    meets the names, and the names found are brought back to their texts.  A
    task holds some texts, never the names; the driver sees their lengths.
    """
    row, hits = unused(texts, "row"), unused(texts, "hits")
    # Names which differ in case only are one name; the smallest of them counts.
    names = known.mapInArrow(_folded_names, "name string, n string, a string")
    names = written(names.groupBy("name").agg(F.min(F.struct("n", "a")).alias("first")).select("name", F.col("first.a").alias("alias")), "names")
    lengths = sorted(r["size"] for r in names.select(F.length("name").alias("size")).distinct().collect())
    numbered = texts.withColumn(row, F.monotonically_increasing_id())
    # The numbers of rows must not change between their uses; some types cannot be written as Parquet.
    odd = re.search(r"\b(void|interval|variant)\b", numbered.schema.simpleString())
    numbered = durable(numbered) if odd else written(numbered, "texts")
    candidates = numbered.filter(quoted(column).isNotNull()).select(F.col(row).alias("row"), quoted(column).alias("text")).mapInArrow(_candidates(lengths), "row long, at int, name string")
    passing = BitFilter(names.select(F.xxhash64("name").alias("key"))).passing(candidates, F.xxhash64("name"))
    found = passing.join(names, "name").groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("at", "name", "alias")).alias(hits))
    at = texts.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                done = []
                for text, here in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    done.append(put(text, folded(text), [(-len(h["name"]), h["name"], h["at"]) for h in here], {h["name"]: h["alias"] for h in here}) if here else text)
                columns = [pa.array(done, pa.string()) if i == at else part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return numbered.join(found, row, "left").select(*[quoted(c) for c in texts.columns], quoted(hits)).mapInArrow(run, schema)


def _folded_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = pa.array([folded(n) for n in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([low, *batch.columns], names=["name", "n", "a"])


def _candidates(lengths: list[int]):
    """A task's function: (row, at, name) of all runs of a text, in lower case,
    which are as long as some name and stand by themselves."""

    def runs(low: str) -> Iterator[tuple[int, str]]:
        for start in Names.START.finditer(low):
            at = start.start()
            if at and is_word(low[at - 1]):
                continue
            for length in lengths:
                end = at + length
                if end > len(low):
                    break
                if not is_word(low[end : end + 1]):
                    yield at, low[at:end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, names = [], [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, name in runs(folded(text)):
                    rows.append(number)
                    places.append(at)
                    names.append(name)
                    if len(rows) == CANDIDATES:
                        yield _batch(rows, places, names)
                        rows, places, names = [], [], []
            yield _batch(rows, places, names)

    return run


def _batch(rows: list[int], places: list[int], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(names, pa.string())], names=["row", "at", "name"])
