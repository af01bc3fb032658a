"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target of words.  Whole epochs of a source are taken first;
the rest of its target is a weighted sample without replacement: a document
with weight w draws the exponential key -ln(u) / w, documents are taken in the
order of their keys, and the prefix sum of their words meets the rest.

No source is sorted whole.  Keys are dealt into buckets of even expected size;
the sums of the buckets tell in which one the rest is met, and only that
bucket's documents are sorted.  The outcome is one row per source (epochs,
bucket, last document taken), against which every document decides by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import row_index
from .common import durable, quoted

#: Documents expected in a bucket of keys.
BUCKET = 4_000
#: Bands of weights for each doubling of a weight.
BANDS = 4
#: Source tables up to this length are broadcast.
BROADCAST_SOURCES = 100_000
ODD_SIGNS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight in [0.1, 1], less for texts full of odd signs."""
    whole = F.length(text)
    odd = whole - F.length(F.translate(text, ODD_SIGNS, ""))
    return F.when(whole > 0, F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * odd / whole)).otherwise(F.lit(0.1))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), the same in every run; documents without an id draw by text."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def drawn(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, weight: Column | None = None) -> DataFrame:
    """_row (the row of ``docs``), _own (its id), _id, _name (source, never
    null), _size, _w and _key; no column of ``docs`` is touched."""
    body = F.col(quoted(text))
    chance = quality_weight(body) if weight is None else weight.cast("double")
    packed = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), F.col(quoted(doc_id)).alias("_own"), body.alias("_text"),
        F.coalesce(F.concat(F.lit("="), F.col(quoted(source))), F.lit("")).alias("_name"), chance.alias("_w"))
    named = {"_id": F.coalesce(F.col("_own").cast("string"), F.md5(F.coalesce("_text", F.lit("")))), "_size": word_count(F.col("_text"))}
    # A weight of zero would never be drawn, one below zero has no meaning.
    rows = packed.withColumns({**named, "_w": F.greatest("_w", F.lit(1e-9))})
    return rows.withColumn("_key", -F.log(uniform(F.col("_own"), F.col("_text"), seed)) / F.col("_w")).drop("_text")


def targets(sources: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """``sources`` (_name, _source_size) with _target: ``budget`` times all
    sizes shared by weight, at most ``most`` times the source's size; what is
    above is shared anew by weight among the others until none is above."""
    order = sources.withColumn("_null", (F.col("_name") == "").cast("int"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = row_index(order, ["_null", "_name"], out="_rank").withColumn("_weight", F.element_at(cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = durable(weighed.withColumn("_most", F.lit(float(most)) * F.col("_source_size")).drop("_null", "_rank"))
    total = weighed.agg(F.sum("_source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:  # ends: every round adds sources to those that are full
        above = F.lit(share) * F.col("_weight") > F.col("_most") if full >= 0 else F.lit(False)
        n, capped, open_weight = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("_most")).otherwise(0.0)), F.sum(F.when(~above, F.col("_weight")).otherwise(0.0))).first()
        if n == full or not open_weight:
            break
        full, share = n, (budget * total - capped) / open_weight
    return weighed.withColumn("_target", F.least(F.lit(share) * F.col("_weight"), F.col("_most")))


def plan(slim: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """One row per source of ``slim`` (_id, _name, _size, _w, _key): its target and where it is met."""
    bands = slim.groupBy("_name", F.floor(F.log2("_w") * BANDS).alias("_band")).agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_n"), F.avg("_w").alias("_w"))
    spread = F.array_sort(F.collect_list(F.struct("_band", "_n", "_w"))).alias("_spread")
    sources = bands.groupBy("_name").agg(F.sum("_size").alias("_source_size"), F.sum("_n").alias("_n"), spread)
    aimed = targets(sources, weights, budget, most)
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    rest = F.col("_target") - F.col("_epochs") * F.col("_source_size")
    aimed = durable(aimed.withColumn("_epochs", epochs).withColumn("_rest", rest).withColumn("_buckets", F.ceil(F.col("_n") / BUCKET)))
    dealt = with_sources(slim, aimed).withColumn("_bucket", bucket())
    sums = dealt.groupBy("_name", "_bucket").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for BUCKET documents of a source goes through this window.
    met = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).filter("_before < _rest").groupBy("_name").agg(F.max(F.struct("_bucket", "_before")).alias("m"))
    aimed = durable(aimed.join(met, "_name", "left").withColumns({"_last": F.coalesce("m._bucket", F.lit(-1)), "_before": F.coalesce("m._before", F.lit(0))}).drop("m"))
    inside = with_sources(slim, aimed).filter(bucket() == F.col("_last"))
    grouped = inside.groupBy("_name", "_key", "_id").agg(F.sum("_size").alias("_words"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    start = F.col("_before") + F.coalesce(F.sum("_words").over(Window.partitionBy("_name").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The document which crosses the rest is taken if more of it lies below.
    cut = grouped.withColumn("_start", start).filter(F.col("_start") + F.col("_words") / 2.0 < F.col("_rest")).groupBy("_name").agg(F.max(F.struct("_key", "_id")).alias("_cut"))
    return durable(aimed.join(cut, "_name", "left").select("_name", "_source_size", "_target", "_epochs", "_n", "_spread", "_buckets", "_last", F.col("_cut._key").alias("_cut_key"), F.col("_cut._id").alias("_cut_id")))


def bucket() -> Column:
    """The share of a source's documents whose key is expected below this one,
    as a bucket.  Documents are told apart by bands of their weights, so a
    bucket is as full as another whatever the weights are."""
    below = lambda n, b: n + b["_n"] * (F.lit(1.0) - F.exp(-F.col("_key") * b["_w"]))
    even = F.aggregate("_spread", F.lit(0.0), below) / F.col("_n")
    return F.least(F.floor(even * F.col("_buckets")), F.col("_buckets") - 1)


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, "_name")


def decided(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and _taken, the words the mix takes."""
    in_cut = (F.col("_bucket") == F.col("_last")) & ((F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (F.col("_id") <= F.col("_cut_id"))))
    chosen = F.coalesce((F.col("_bucket") < F.col("_last")) | in_cut, F.lit(False))
    joined = with_sources(rows, planned).withColumn("_bucket", bucket())
    return joined.withColumn("_taken", F.col("_size") * (F.col("_epochs") + chosen.cast("int")))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 0, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per document: its id, ``size`` (words), ``source_size``,
    ``target`` of its source and ``taken``, the words taken with repeats.

    Null and empty texts have size 0 and are never taken; documents without a
    source are one source, the last in order; repeated rows share a key and are
    taken or left together.  An empty table gives an empty result.
    """
    slim = durable(drawn(docs, doc_id, text, source, seed, weight).select("_own", "_id", "_name", "_size", "_w", "_key"))
    result = decided(slim, plan(slim, weights, budget, most))
    return result.select(F.col("_own").alias(doc_id), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 0, doc_id: str = "doc_id",
                    text: str = "text", source: str = "source") -> DataFrame:
    """The documents the mix takes, as they are, with ``taken_words`` and
    ``repeats`` (how often each is taken) in place of columns of these names.

    The texts stay where they are: each row is held against its source's plan.
    """
    rows = drawn(docs, doc_id, text, source, seed)
    slim = durable(rows.select("_id", "_name", "_size", "_w", "_key"))
    columns = [F.col(f"_row.{quoted(c)}") for c in docs.columns if c.lower() not in ("taken_words", "repeats")]
    result = decided(rows, plan(slim, weights, budget, most)).filter("_taken > 0")
    return result.select(*columns, F.col("_taken").cast("long").alias("taken_words"), (F.col("_taken") / F.col("_size")).cast("long").alias("repeats"))
