"""A Merkle manifest of a dataset, and proofs climbed by a recursive query.

Each row is a leaf.  Per source, every RUN consecutive nodes become one, level
by level, until the source's *subroot* is left; the subroots, ordered by
source, give the *root* in the same way.

Building takes LEVELS levels at once: FAN neighbours are grouped, their levels
are folded inside the row, and the group becomes one node of the next *hop*.
Each hop's nodes are written as rows which hold their key (tree, hop, place),
the siblings met on the way up to the next hop, and their parent's key.

Verifying is one recursive query over these rows: it starts with the digests
as they are found, joins each with its node, folds in the siblings, appends
them to the proof and goes on with the parent's key.  It ends at the root.  A
node under which many leaves lie is stored once per FANIN of them, and a leaf
picks one of these copies by its place, so no key of the join is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import row_index
from .common import durable, quoted, shared_folder

RUN, LEVELS = 3, 6
FAN = RUN**LEVELS
#: Tables of sources up to this length are broadcast.
BROADCAST_SOURCES = 100_000
#: Leaves which meet in one key of the climb.
FANIN = 8_192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Trees of sources are named by "s" and the source, or "n" for a missing one.
TOP, NAMELESS, NAMED = "t", "n", "s"


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def tree_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit(NAMED), source.cast("string")), F.lit(NAMELESS))


def _steps(size: Column) -> Column:
    """Levels left above a level of ``size`` nodes, LEVELS at most."""
    return sum((F.when(size > RUN**j, 1).otherwise(0) for j in range(LEVELS)), F.lit(0))


def _level_above(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(level, k * RUN + 1, RUN), "")))


def _grouped(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per FAN neighbours: ``members`` and the digests of ``level0`` up
    to the level of the node above them."""
    own = [c for c in nodes.columns if c not in ("tree", "place")]
    member = F.struct("place", *own)
    groups = nodes.groupBy("tree", F.floor(F.col("place") / FAN).alias("above")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.sum("leaves").alias("below"))
    # Few sources are broadcast, so that a hot one's groups are not brought together.
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    groups = groups.join(F.broadcast(sizes) if few else sizes, "tree").withColumns({"steps": _steps(F.col("size")), "level0": F.transform("members", lambda m: m["hash"])})
    for j in range(LEVELS):
        here = F.col(f"level{j}")
        groups = groups.withColumn(f"level{j + 1}", F.when(F.col("steps") > j, _level_above(here)).otherwise(here))

    return groups


def _members(groups: DataFrame) -> DataFrame:
    """The members of each group, each with its path to the node above."""

    def siblings(p: Column, j: int) -> Column:
        q = F.floor(p / RUN**j).cast("int")
        before = q % RUN
        here = F.col(f"level{j}")
        left = F.array_join(F.slice(here, q - before + 1, before), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(here, q + 2, F.lit(RUN - 1) - before), "").alias("right"))

    rows = groups.select("*", F.posexplode("members").alias("p", "member"))
    path = F.slice(F.array(*[siblings(F.col("p"), j) for j in range(LEVELS)]), F.lit(1), F.col("steps"))
    return rows.select("tree", "above", "below", (F.col("size") <= FAN).alias("last"), "member.*", path.alias("path"))


def _folded(nodes: DataFrame, sizes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Members of each hop's groups, and one row (tree, hop, hash, leaves) per
    tree, of its root."""
    hops, roots = [], None
    while True:
        groups = durable(_grouped(nodes, sizes))
        hops.append(_members(groups))
        above = groups.select("tree", F.col("above").alias("place"), F.element_at(f"level{LEVELS}", 1).alias("hash"), F.col("below").alias("leaves"), "size")
        ended = above.filter(F.col("size") <= FAN).select("tree", F.lit(len(hops)).alias("hop"), "hash", "leaves")
        roots = ended if roots is None else roots.unionByName(ended)
        sizes = durable(sizes.filter(F.col("size") > FAN).select("tree", F.ceil(F.col("size") / FAN).alias("size")))
        if sizes.isEmpty():
            return hops, roots
        nodes = above.filter(F.col("size") > FAN).drop("size")


@dataclass
class Manifest:
    """``nodes``: the stored rows; ``subroots``: (tree, hash, leaves); ``start``:
    the leaves, with the first hop's path; ``root``: null without leaves."""

    nodes: DataFrame
    subroots: DataFrame
    start: DataFrame
    root: str | None


def _salts(leaves: Column) -> Column:
    return F.ceil(leaves / FANIN).cast("long")


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, source: str = "source", order: str = "doc_id", found: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``found`` names fields which are read
    otherwise when their leaves are verified.

    Leaves ascend by ``order``, missing values last and ties by their digest.
    Nulls in a field, empty and very long texts have digests of their own;
    repeated rows are leaves of their own; other columns play no part.
    """
    spark = docs.sparkSession
    kept = digest(*[field(F.col(quoted(f))) for f in fields])
    seen = digest(*[field((found or {}).get(f, F.col(quoted(f)))) for f in fields])
    rows = durable(docs.select(tree_name(F.col(quoted(source))).alias("tree"), F.col(quoted(order)).alias("id"), kept.alias("hash"), seen.alias("seen")))
    sizes = durable(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("size")))
    placed = row_index(rows, ["id", "hash"], ["tree"], "place").withColumn("place", F.col("place") - 1)
    hops, roots = _folded(placed.withColumn("leaves", F.lit(1).cast("long")), sizes)
    roots = durable(roots)
    # Sources in the order of their bytes; the name of a missing one comes first.
    ranked = row_index(roots.select("hash", "leaves", F.col("tree").alias("own_tree"), F.col("hop").alias("own_hop"), F.lit(TOP).alias("tree")), ["own_tree"], ["tree"], "place")
    tops = durable(ranked.withColumn("place", F.col("place") - 1))
    top_hops, top_root = _folded(tops, tops.groupBy("tree").agg(F.count(F.lit(1)).alias("size")))

    def node_rows(rows: DataFrame, tree: Column, hop: Column, place: Column, next_hop: int, top: bool, subroot: Column) -> DataFrame:
        # Of the top tree's last group there is nothing above.
        goes_on = ~F.col("last") if top else F.lit(True)
        up = {"up_tree": F.col("tree"), "up_hop": F.lit(next_hop), "up_place": F.col("above"), "up_salts": _salts(F.col("below"))}
        copies = F.explode(F.sequence(F.lit(0).cast("long"), _salts(F.col("leaves")) - 1)).alias("salt")
        return rows.select(
            tree.alias("tree"), hop.cast("int").alias("hop"), place.cast("long").alias("place"), copies, "path", subroot.alias("subroot"),
            *[F.when(goes_on, c).alias(name) for name, c in up.items()],
        )

    none = F.lit(None).cast("binary")
    parts = [node_rows(rows, F.col("tree"), F.lit(k), F.col("place"), k + 1, False, none) for k, rows in enumerate(hops) if k]
    parts.append(node_rows(top_hops[0], F.col("own_tree"), F.col("own_hop"), F.lit(0), 1, True, F.unhex("hash")))
    parts += [node_rows(rows, F.col("tree"), F.lit(k), F.col("place"), k + 1, True, none) for k, rows in enumerate(top_hops) if k]
    folder = shared_folder(spark, "manifest")
    for part in parts:
        part.write.mode("append").parquet(folder)
    first = top_root.first()
    return Manifest(spark.read.parquet(folder), roots.select("tree", "hash", "leaves"), hops[0], first["hash"] if first else None)


@contextmanager
def _recursion_without_row_limit(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: The siblings of a path as bytes, and a digest folded up that path.
APPENDED = "unhex(array_join(transform({path}, x -> concat(x.left, x.right)), ''))"
FOLD = "aggregate({path}, {hash}, (h, x) -> sha2(concat(x.left, h, x.right), 256))"

CLIMB = f"""
WITH RECURSIVE climb MAX RECURSION LEVEL 200 AS (
  SELECT id, unhex(hash) AS leaf, place AS pick, {FOLD.format(path="path", hash="seen")} AS folded, {APPENDED.format(path="path")} AS proof,
         CAST(NULL AS BINARY) AS subroot, tree, CAST(1 AS INT) AS hop, above AS place, pmod(place, CAST(ceil(below / {{fanin}}) AS BIGINT)) AS salt
  FROM {{start}}
  UNION ALL
  SELECT c.id, c.leaf, c.pick, {FOLD.format(path="n.path", hash="c.folded")}, concat(c.proof, {APPENDED.format(path="n.path")}),
         coalesce(c.subroot, n.subroot), n.up_tree, n.up_hop, n.up_place, pmod(c.pick, n.up_salts)
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.hop = n.hop AND c.place = n.place AND c.salt = n.salt
)
SELECT id, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot, {{proof}}, folded AS folded_root FROM climb WHERE tree IS NULL
"""
PROOFS = {True: "proof", False: "sha2(lower(hex(proof)), 256) AS proof_sha256"}


def climb(manifest: Manifest, whole_proofs: bool = True) -> DataFrame:
    """One row per leaf: id, ``leaf``, ``subroot``, ``root``, ``proof`` (the
    siblings from leaf to root, 32 bytes each, left to right on each level) or
    ``proof_sha256`` of their hex digits, ``folded_root`` made from the digest
    found, and ``verified``."""
    spark = manifest.nodes.sparkSession
    names = {key: f"merkle_{key}_{uuid.uuid4().hex}" for key in ("start", "nodes")}
    manifest.start.createOrReplaceTempView(names["start"])
    manifest.nodes.createOrReplaceTempView(names["nodes"])
    try:
        with _recursion_without_row_limit(spark):
            found = durable(spark.sql(CLIMB.format(**names, fanin=FANIN, proof=PROOFS[whole_proofs])))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)
    root = F.lit(manifest.root).cast("string")
    proof = "proof" if whole_proofs else "proof_sha256"
    return found.select("id", "leaf", "subroot", root.alias("root"), proof, "folded_root", (F.col("folded_root") == root).alias("verified"))
