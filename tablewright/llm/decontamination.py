"""Benchmark decontamination by word windows, in DataFrame functions only.

Words are runs of digits, ASCII letters (A-Z lower-cased) and signs outside
ASCII.  A benchmark item yields all its windows of ``window`` words; a shorter
item is one window.  A document word inside an occurrence of a window is hit.

A window of L words holds, at any place of a document, exactly one *anchor*: a
run of g = L - s + 1 words which starts at a multiple of s = (L + 1) // 2.  So
a document is scanned at every s-th word only: the 64-bit hash of each anchor
is looked up in the set of all g-word runs of the items, and only where it is
found are the windows around it compared, as text, with the items' windows.
The scan neither loses a window nor finds one twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bitfilter import BitFilter
from .common import durable, free_names, quoted, row_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A benchmark with more runs and windows than this is joined by a shuffle; a
#: run takes about 40 bytes of an executor, a window about 300.
BROADCAST_RUNS = 1_000_000


def word_array(text: Column) -> Column:
    """The words of a text; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NO_WORD), "")


def stride(length: int) -> int:
    return (length + 1) // 2


def starts(words: Column, run: int, step: int, least: int) -> Column:
    """0, step, 2 * step ... while ``run`` words follow, given ``least`` words."""
    n = F.size(words)
    return F.when(n >= least, F.sequence(F.lit(0), n - run, F.lit(step))).otherwise(F.array().cast("array<int>"))


def run_hash(words: Column, at: Column, run: int, length: int) -> Column:
    return F.xxhash64(F.lit(length), F.slice(words, at + 1, F.lit(run)))


def anchors(words: Column, length: int) -> Column:
    """(length, position, hash, words around) of each anchor of a document."""
    step = stride(length)
    run = length - step + 1

    def one(at: Column) -> Column:
        low = F.greatest(at - step + 1, F.lit(0))
        around = F.array_join(F.slice(words, low + 1, at - low + length), " ")
        return F.struct(F.lit(length).alias("length"), low.alias("low"), run_hash(words, at, run, length).alias("run"), around.alias("around"))

    return F.transform(starts(words, run, step, length), one)


class Windows:
    """The items' windows, and their runs; read once, in two small tables."""

    def __init__(self, benchmark: DataFrame, item_id: str, text: str, window: int) -> None:
        names = F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit(""))
        items = durable(benchmark.select(names.alias("item"), word_array(F.col(quoted(text))).alias("words")).filter("size(words) > 0"))
        length = F.least(F.size("words"), F.lit(window))
        # At most ``window`` values, whatever the benchmark's size.
        self.lengths = sorted(r[0] for r in items.select(length.alias("length")).distinct().collect())
        at, words = F.sequence(F.lit(0), F.size("words") - length), F.col("words")
        windows = items.select("item", length.alias("length"), F.explode(F.transform(at, lambda a: F.array_join(F.slice(words, a + 1, length), " "))).alias("window"))
        self.windows = durable(windows.groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items")))
        parts = [self.runs_of(items.filter(F.least(F.size("words"), F.lit(window)) == n), n) for n in self.lengths]
        runs = reduce(DataFrame.unionByName, parts) if parts else items.select(F.lit(0).cast("long").alias("run")).limit(0)
        self.runs = durable(runs.distinct().withColumn("known", F.lit(True)))
        self.filter = None
        if self.runs.count() + self.windows.count() <= BROADCAST_RUNS:
            self.runs, self.windows = F.broadcast(self.runs), F.broadcast(self.windows)
        else:
            self.filter = BitFilter(self.runs.select(F.col("run").alias("key")))

    @staticmethod
    def runs_of(items: DataFrame, length: int) -> DataFrame:
        run = length - stride(length) + 1
        at = F.sequence(F.lit(0), F.size("words") - run)
        return items.select(F.explode(F.transform(at, lambda a: run_hash(F.col("words"), a, run, length))).alias("run"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, hit_parts: int = 20) -> DataFrame:
    """One row per document: its id, ``text_hash``, ``n_words``, ``n_hit``,
    ``items`` (sorted strings), ``spans`` (hit words as [start, end) pairs) and
    ``contaminated``: at least one of ``hit_parts`` equal parts is hit.

    Null and empty texts have no words and are clean; repeated rows give
    repeated rows; an item without id counts under the empty string; an empty
    benchmark leaves all documents clean.
    """
    known = Windows(benchmark, item_id, item_text, window)
    id_column, text_hash = row_keys(doc_id, text)
    empty = F.array().cast("array<struct<length:int,low:int,run:bigint,around:string>>")
    base = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("low"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("string").alias("around")))
    words = docs.select(id_column.alias("id"), text_hash.alias("text_hash"), word_array(F.col(quoted(text))).alias("words"))
    listed = F.concat(empty, *[anchors(F.col("words"), n) for n in known.lengths])
    if known.filter is None:
        # Each document's first row is its own; the others are its anchors.
        scanned = words.select("id", "text_hash", F.size("words").alias("n_words"), F.explode_outer(F.concat(base, listed)).alias("a"))
        found = scanned.select("id", "text_hash", "n_words", "a.*").join(known.runs, "run", "left").filter("length = 0 OR known").drop("known")
    else:
        # Own rows pass by; of the anchors only those a filter lets through go
        # on, and the comparison of windows below is exact.
        own = words.select("id", "text_hash", F.size("words").alias("n_words"), F.explode(base).alias("a")).select("id", "text_hash", "n_words", "a.*")
        scanned = words.select("id", "text_hash", F.size("words").alias("n_words"), F.explode(listed).alias("a")).select("id", "text_hash", "n_words", "a.*")
        found = own.unionByName(known.filter.passing(scanned, F.col("run")))

    def places(n: int) -> Column:
        around = F.split("around", " ")
        last = F.least(F.lit(stride(n) - 1), F.size(around) - n)
        one = lambda k: F.struct((F.col("low") + k).alias("start"), F.array_join(F.slice(around, k + 1, F.lit(n)), " ").alias("window"))
        return F.when(F.col("length") == n, F.transform(F.sequence(F.lit(0), last), one))

    # No window has this name, and own rows spread over the tasks by it.
    name = F.concat(F.lit("own "), F.xxhash64("id", "text_hash").cast("string"))
    nowhere = F.array(F.struct(F.lit(0).alias("start"), name.alias("window")))
    placed = found.select("id", "text_hash", "n_words", "length", F.explode_outer(F.coalesce(*[places(n) for n in known.lengths], nowhere)).alias("w"))
    hits = placed.select("id", "text_hash", "n_words", "length", "w.*").join(known.windows, ["length", "window"], "left").filter("length = 0 OR items IS NOT NULL")
    span = F.when(F.col("length") > 0, F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    grouped = hits.groupBy("id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum((F.col("length") == 0).cast("int")).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    counted = merged(grouped, "spans", window).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
    verdict = (F.col("n_hit") > 0) & (hit_parts * F.col("n_hit") >= F.col("n_words"))
    return counted.withColumn("contaminated", verdict).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(doc_id), "text_hash", "n_words", "n_hit", "items", "spans", "contaminated")


def merged(rows: DataFrame, spans: str, longest: int) -> DataFrame:
    """``rows`` with the sorted [start, end) pairs of ``spans`` which touch or
    overlap made one.

    Of one start the longest span counts.  A span of at most ``longest`` words
    can only be reached by the ``longest`` ones before it, so each looks at
    that many and the work grows with the number of spans.
    """
    columns = rows.columns
    of_start = F.filter(spans, lambda s, i: ~s["start"].eqNullSafe(F.get(F.col(spans), i + 1)["start"]))
    rows = rows.withColumn("all_spans", of_start)
    reach = lambda i, n: F.array_max(F.transform(F.slice("all_spans", F.greatest(i - n + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(n))), lambda s: s["end"]))
    fresh = lambda s, i: (i == 0) | (s["start"] > reach(i - 1, longest))
    rows = rows.withColumn("starts", F.filter(F.transform("all_spans", lambda s, i: F.when(fresh(s, i), i)), lambda i: i.isNotNull()))
    last = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("all_spans")) - 1
    made = F.transform("starts", lambda i, k: F.struct(F.get(F.col("all_spans"), i)["start"].alias("start"), reach(last(k), longest).alias("end")))
    return rows.withColumn(spans, made).select(*columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the
    hit words cut out of every text, the signs between kept words staying."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = contamination(docs, benchmark, doc_id, text, **options)
    nameless, named, hashed, cut = free_names(docs, "nameless", "named", "hashed", "cut")
    names = [nameless, named, hashed]

    def identity(id_column: Column, text_hash: Column) -> list[Column]:
        return [id_column.isNull(), F.coalesce(id_column.cast("string"), F.lit("")), text_hash]

    marked = docs.withColumns(dict(zip(names, identity(*row_keys(doc_id, text)))))
    columns = [F.col(quoted(c)) for c in docs.columns]
    chosen = found.filter("contaminated" if remove == "documents" else "n_hit > 0")
    keys = [c.alias(n) for n, c in zip(names, identity(F.col(quoted(doc_id)), F.col("text_hash")))]
    chosen = durable(chosen.select(*keys, F.col("spans").alias(cut)).dropDuplicates(names))
    if remove == "documents":
        return marked.join(chosen.drop(cut), names, "left_anti").select(*columns)
    joined = marked.join(chosen, names, "left")
    pieces = F.regexp_extract_all(F.col(quoted(text)), F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    tail = F.regexp_extract(F.col(quoted(text)), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    words, = free_names(joined, "words")
    joined = joined.withColumn(words, F.when(F.col(cut).isNotNull(), pieces))
    # What lies between the end of one span and the start of the next.
    before = lambda i: F.when(i > 0, F.get(F.col(cut), i - 1)["end"]).otherwise(0)
    kept = F.flatten(F.transform(cut, lambda s, i: F.slice(words, before(i) + 1, s["start"] - before(i))))
    rest = F.slice(words, F.element_at(cut, -1)["end"] + 1, F.size(words))
    done = F.when(F.col(cut).isNull(), F.col(quoted(text))).otherwise(F.concat(F.array_join(F.concat(kept, rest), ""), tail))
    return joined.select(*[done.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
