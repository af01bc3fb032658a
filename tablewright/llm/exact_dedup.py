"""Exact duplicates by progressive refinement, in native expressions only.

Texts are equal when they are identical after every ASCII white space sign has
been deleted.  They are told apart by what is cheap first:

1. the length of the normalised text;
2. where a length occurs twice, a hash of its first PREFIX signs;
3. where length and prefix occur twice, SHA-256 of the whole.

Each level hands the next one a filter of bits, set for the keys which occur
twice.  It is broadcast, its size has a fixed upper bound (32 MB of bits), and a
key which shares its bit with another only costs that row the next level's
work.  So texts are never moved: the levels shuffle numbers, and the last one
digests of the texts still in question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.bitfilter import BitFilter
from .common import durable, free_names, quoted, row_keys

WHITE = r"[\x20\x09-\x0D]"
#: Signs of the normalised text which the second level looks at.
PREFIX = 128


def normalised(text: Column) -> Column:
    """The text without white space; a null is an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


class Refinement:
    """The first two levels over ``docs``, ready to mark the texts in question."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        self.docs, self.doc_id, self.text = docs, doc_id, text
        plain = docs.select(normalised(F.col(quoted(text))).alias("plain"))
        slim = durable(plain.select(*[c.alias(n) for n, c in self.levels("plain").items()]))
        lengths = slim.groupBy("length").count().filter("count > 1").select(F.xxhash64("length").alias("key"))
        self.by_length = BitFilter(durable(lengths))
        open_rows = self.by_length.marked(slim.withColumn("key", F.xxhash64("length")), "key", "repeated").filter("repeated")
        heads = open_rows.groupBy("length", "head").count().filter("count > 1").select(F.xxhash64("length", "head").alias("key"))
        self.by_head = BitFilter(durable(heads))

    @staticmethod
    def levels(plain: str) -> dict[str, Column]:
        return {"length": F.octet_length(plain), "head": F.xxhash64(F.substring(plain, 1, PREFIX))}

    def marked(self, every_digest: bool) -> DataFrame:
        """Slim rows (id, points, text_hash, suspect, digest, tag); the digest
        is there for suspects, or for all."""
        id_column, text_hash = row_keys(self.doc_id, self.text)
        text = F.col(quoted(self.text))
        points = F.coalesce(F.length(text), F.lit(0)).alias("points")
        rows = self.docs.select(id_column.alias("id"), points, text_hash.alias("text_hash"), normalised(text).alias("plain"))
        rows = rows.withColumns(self.levels("plain")).withColumn("key", F.xxhash64("length", "head"))
        rows = self.by_head.marked(rows, "key", "suspect")
        whole = F.sha2("plain", 256)
        digest = whole if every_digest else F.when(F.col("suspect"), whole)
        # The tag tells repeated rows apart; it is fixed once written.
        return durable(rows.select("id", "points", "text_hash", "suspect", digest.alias("digest"), F.monotonically_increasing_id().alias("tag")))

    def classes(self, every_digest: bool = False) -> DataFrame:
        """Rows (id, text_hash, digest, keep_id, group_size, kept)."""
        rows = self.marked(every_digest)
        suspects = rows.filter("suspect")
        order = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("nameless"), "id", "tag")
        best = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
        # Written first: the join is then between plain shuffles, whose hot
        # digest adaptive execution can split.
        best = durable(best.select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.tag").alias("keep_tag")))
        told = suspects.join(best, "digest").select("id", "text_hash", "digest", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"))
        alone = rows.filter(~F.col("suspect")).select(
            "id", "text_hash", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        return told.unionByName(alone)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every_digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id`` (the id of the row which
    stays), ``group_size``, ``kept`` and ``text_sha256`` of the normalised text
    (null for texts told apart without it, unless ``every_digest``).

    Of equal texts the row with the most code points stays, then the smallest
    id, missing ids last; of repeated rows just one.  Null, empty and blank
    texts are equal to each other.  Other columns of ``docs`` play no part.
    """
    found = Refinement(docs, doc_id, text).classes(every_digest)
    return found.select(F.col("id").alias(doc_id), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` which stay, with their columns.

    Rows in no question pass as they are; only suspects meet with the table of
    what stays.
    """
    made = Refinement(docs, doc_id, text)
    staying = made.classes().filter("kept").select(*_identity(F.col("id"), F.col("text_hash")))
    key, suspect, plain, nameless, named, hashed, turn = free_names(docs, "key", "suspect", "plain", "nameless", "named", "hashed", "turn")
    rows = docs.withColumn(plain, normalised(F.col(quoted(text))))
    rows = rows.withColumn(key, F.xxhash64(*made.levels(plain).values())).drop(plain)
    rows = made.by_head.marked(rows, key, suspect)
    columns = [F.col(quoted(c)) for c in docs.columns]
    names = [nameless, named, hashed]
    same = Window.partitionBy(*names).orderBy(hashed)
    asked = rows.filter(F.col(suspect)).withColumns(dict(zip(names, _identity(*row_keys(doc_id, text)))))
    asked = asked.withColumn(turn, F.row_number().over(same)).filter(F.col(turn) == 1)
    chosen = asked.join(durable(staying.toDF(*names)), names, "left_semi")
    return rows.filter(~F.col(suspect)).select(*columns).unionByName(chosen.select(*columns))


def _identity(id_column: Column, text_hash: Column) -> list[Column]:
    return [id_column.isNull(), F.coalesce(id_column.cast("string"), F.lit("")), text_hash]
