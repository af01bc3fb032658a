"""SimHash near-duplicates by chains of segments (pigeonring).

A fingerprint of 64 bits is cut into SEGMENTS segments, seen as a ring.  Where
two fingerprints differ in at most ``distance`` bits, some segment starts a
chain whose first j segments together differ in at most j * distance /
SEGMENTS bits, for every j.  With five segments and a distance of four the
first segment of that chain is equal and the second differs in one bit at
most.  Both facts make the join key: (start, first segment, second segment),
once as it is and, for fingerprints whose second segment has an even number of
ones, also with each of its bits turned (of two segments one bit apart exactly
one is even).  Fingerprints which meet under a key must pass the rest of the
chain before they count as linked, and the last step of the chain is the full
Hamming check.

Equal fingerprints are joined before any of this, and a key's fingerprints
yield a spanning forest of their links, not all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_names, quoted, row_keys, with_arrow_columns
from .components import components

SEED = 42
SEGMENTS = 5
#: A start segment shared by more fingerprints than this, and by HOT_TIMES the
#: mean, is dealt out over pairs of blocks.
HOT_LEAST, HOT_TIMES = 20_000, 20
#: Keys with at most so many fingerprints compare them by shifts of the sorted
#: column, larger ones by a search which leaves out what is already linked.
SHORT = 16


def word_list(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = word_list(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    last, digest = ends[size - 1 :].tolist(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), last)), np.uint64, len(last))
    # The bits of each byte position are counted apart, in bounded blocks.
    ones = np.zeros(64, np.int64)
    for block in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[block : block + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with ``fingerprint_bits`` (long) in place of a column of that name."""
    return with_arrow_columns(docs, text, {"fingerprint_bits": "bigint"}, lambda texts: {"fingerprint_bits": [fingerprint(t, shingle) for t in texts]})


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; the wider ones come first."""
    short, wide = divmod(64, segments)
    widths = [short + (i < wide) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def cut(bits: np.ndarray, i: int) -> np.ndarray:
    first, width = segment_bounds()[i % SEGMENTS]
    return (bits.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)


def chain_holds(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, distance: int) -> np.ndarray:
    """Whether the chain of all segments from ``start`` keeps within its
    budgets; its last budget is the Hamming distance itself."""
    different = (a ^ b).view(np.uint64)
    parts = np.stack([np.bitwise_count(cut(different, i)) for i in range(SEGMENTS)]).astype(np.int64)
    rows = np.arange(len(different))
    total, holds = np.zeros(len(different), np.int64), np.ones(len(different), bool)
    for j in range(SEGMENTS):
        total += parts[(start + j) % SEGMENTS, rows]
        holds &= SEGMENTS * total <= (j + 1) * distance
    return holds


def chain_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and, for each key, the row it belongs to."""
    keys, rows = [], []
    everyone = np.arange(len(bits))
    for i in range(SEGMENTS):
        first, second = cut(bits, i), cut(bits, i + 1)
        width = segment_bounds()[(i + 1) % SEGMENTS][1]
        head = (np.uint64(i) << np.uint64(48)) | (first << np.uint64(24))
        keys.append(head | second)
        rows.append(everyone)
        even = np.flatnonzero(np.bitwise_count(second) % 2 == 0)
        for bit in range(width):
            keys.append(head[even] | (second[even] ^ np.uint64(1 << bit)))
            rows.append(even)
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def search_links(bits: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``bits``: each found fingerprint is
    compared only with those not found yet."""
    rest, ends = bits, ([], [])
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = chain_holds(rest, np.full(len(rest), here), start, distance)
            if near.any():
                found = rest[near]
                ends[0].append(np.full(len(found), here))
                ends[1].append(found)
                queue.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *ends[0]]), np.concatenate([empty, *ends[1]])


def links_of_sorted(keys: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys, the keys being in order."""
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    size_of = np.repeat(sizes, sizes)
    start = (keys.view(np.uint64) >> np.uint64(48)).astype(np.int64) % 8
    left, right = [], []
    for shift in range(1, SHORT):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & (size_of[shift:] <= SHORT))
        if not len(at):
            break
        at = at[chain_holds(bits[at], bits[at + shift], start[at], distance)]
        left.append(bits[at])
        right.append(bits[at + shift])
    for k in np.flatnonzero(sizes > SHORT):
        a, b = search_links(np.unique(bits[edges[k] : edges[k + 1]]), int(start[edges[k]]), distance)
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) which connect the ``bits`` at most ``distance`` apart.

    Every link of a key's fingerprints is there, or a path of links between its
    two ends.  A hot start segment, found by counting its 5 x 8,192 possible
    values (so its table is small at any size), is dealt out: its fingerprints
    are put in blocks, and each pair of blocks becomes a key of its own.
    """
    if SEGMENTS * 1 <= distance:
        raise ValueError(f"distance must be below {SEGMENTS}")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SEGMENTS << 13, np.int64)
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(SEGMENTS):
                counts += np.bincount((cut(bits, i) | np.uint64(i << 13)).astype(np.int64), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["head", "n"])

    total = distinct.count()
    least = max(HOT_LEAST, HOT_TIMES * total // (1 << 13))
    counted = distinct.select("bits").mapInArrow(heads, "head long, n long").groupBy("head").agg(F.sum("n").alias("n"))
    hot = {r["head"]: -(-r["n"] // least) for r in counted.filter(F.col("n") > least).collect()} if total > least else {}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, rows = chain_keys(bits)
            blocks = np.zeros(len(keys), np.int64)
            if hot:
                head = ((keys >> 48) << 13) | ((keys >> 24) & 0xFFF_FFF)
                parts = [(keys, rows, blocks)]
                for value, n in hot.items():
                    chosen = np.flatnonzero(head == value)
                    own = (bits[rows[chosen]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                    for other in range(n):
                        pair = 1 + np.minimum(own, other) * n + np.maximum(own, other)
                        parts.append((keys[chosen], rows[chosen], pair))
                cool = ~np.isin(head, np.fromiter(hot, np.int64, len(hot)))
                parts[0] = (keys[cool], rows[cool], blocks[cool])
                keys, rows, blocks = (np.concatenate(x) for x in zip(*parts))
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(blocks[part]), pa.array(bits[rows[part]])], names=["key", "block", "bits"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of (key, block); an open group is carried on."""
        held: list[np.ndarray] = []

        def made(rows: np.ndarray) -> pa.RecordBatch:
            turn = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
            number = np.repeat(np.arange(len(turn)), np.diff(np.append(turn, len(rows))))
            # The group's number and its start segment stand in for the key.
            group = (number << 3) | (rows[:, 0] >> 48)
            a, b = links_of_groups(group, rows[:, 2], distance)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if not len(rows):
                continue
            ends = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut_at = ends[-1] + 1 if len(ends) else 0
            if cut_at:
                yield made(np.concatenate([*held, rows[:cut_at]]))
                held = []
            elif held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield made(np.concatenate(held))
                held = []
            held.append(rows[cut_at:])
        if held:
            yield made(np.concatenate(held))

    return (
        distinct.select("bits").mapInArrow(keyed, "key long, block long, bits long")
        .repartition("key", "block").sortWithinPartitions("key", "block", "bits")
        .mapInArrow(linked, "a long, b long").distinct()
    )


def links_of_groups(group: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As links_of_sorted; the start segment is in the low three bits."""
    return links_of_sorted(((group & 7) << 48) | (group >> 3), bits, distance)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4,
                    with_root: bool = False) -> DataFrame:
    """One row per document: its id, ``text_hash`` (xxhash64 of the text),
    ``fingerprint_bits`` and ``component_id``, the smallest id reachable by
    links of at most ``distance`` bits, itself included.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows give repeated rows.  A null id is never a component's id
    unless all its ids are null.  ``with_root`` adds ``root``, the fingerprint
    which tells components apart where ids are repeated or null.
    """
    id_column, text_hash = row_keys(doc_id, text)
    slim = docs.select(id_column.alias("id"), text_hash.alias("text_hash"), F.col(quoted(text)).alias("text"))
    marked = durable(fingerprints(slim, "text", shingle).drop("text"))
    distinct = durable(marked.groupBy(F.col("fingerprint_bits").alias("bits")).agg(F.min("id").alias("first_id")))
    roots = components(links(distinct, distance), "a", "b")  # node, root
    rooted = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    smallest = durable(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    # Written first, so that the joins below are between plain shuffles, whose
    # hot fingerprint adaptive execution can split.
    root = ["root"] if with_root else []
    named = durable(rooted.join(smallest, "root").select(F.col("bits").alias("fingerprint_bits"), "component_id", *root))
    return marked.join(named, "fingerprint_bits").select(F.col("id").alias(doc_id), "text_hash", "fingerprint_bits", "component_id", *root)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the
    document with the smallest id stays, of repeated rows one.

    Documents without an id form components by their texts alone; the one with
    the smallest text hash stays where all ids of a component are null.
    """
    found = near_duplicates(docs, doc_id, text, shingle, distance, with_root=True)
    return one_of_each(docs, found.select(F.col(quoted(doc_id)).alias("id"), "text_hash", "root"), doc_id, text)


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each ``root`` of ``found`` (id, text_hash, root),
    which has a row for each of ``docs``; of repeated rows one."""

    def identity(id_column: Column, text_hash: Column) -> dict[str, Column]:
        return {nameless: id_column.isNull(), named: F.coalesce(id_column.cast("string"), F.lit("")), hashed: text_hash}

    nameless, named, hashed, turn = free_names(docs, "nameless", "named", "hashed", "turn")
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash")
    groups = found.groupBy("root").agg(F.min(first).alias("kept"))
    kept = groups.select(*[c.alias(n) for n, c in identity(F.col("kept.id"), F.col("kept.text_hash")).items()])
    # All but one of a task's repeated rows go before the texts are moved.
    same = Window.partitionBy(nameless, named, hashed).orderBy(hashed)
    marked = docs.withColumns(identity(*row_keys(doc_id, text))).withColumn(turn, F.row_number().over(same)).filter(F.col(turn) == 1)
    return marked.join(durable(kept), [nameless, named, hashed], "left_semi").select(*[F.col(quoted(c)) for c in docs.columns])
