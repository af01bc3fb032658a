"""Reply trees to conversations.

Messages point to their parents.  Pointers are doubled by self-joins, so paths
of any depth take a logarithmic number of rounds: after round k each message
knows its ancestor 2^k steps up and the scores on the way.  The leaves of a
tree are ranked by the mean score of their branch, and the chosen branches are
spelled out by the same tables, the largest step first.  Texts are joined once,
at the end, and each branch becomes one formatted conversation with the spans
of its loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

# Control strings of the template all begin with "<", which texts never hold
# once escaped: "\\" becomes "\\\\", "<" becomes "\\l"; in roles also ">" and
# line ends, as "\\g" and "\\n".
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n"}
BACK = {v[1]: k for k, v in ESCAPES.items()}
TURN = re.compile(r"<turn ([^<>\n]*)>\n([^<]*)\n</turn>\n")


def escape(text: str, signs: str = "\\<") -> str:
    return re.sub(f"[{re.escape(signs)}]", lambda m: ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m.group(1)], text, flags=re.S)


def format_turns(turns: Iterable[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the [start, end) spans (in code points) of
    the texts whose role is ``learned``."""
    parts, spans, length = [], [], 0
    for role, text in turns:
        head, body, tail = f"<turn {escape(role, ''.join(ESCAPES))}>\n", escape(text), "\n</turn>\n"
        if role == learned:
            spans.append((length + len(head), length + len(head) + len(body)))
        parts += [head, body, tail]
        length += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def told_once(messages: DataFrame) -> DataFrame:
    """``messages`` with one row for each (tree, id): of repeated ones the
    first by parent, score, role and text.  Rows are moved only if any repeat."""
    if messages.groupBy("tree", "id").count().filter("count > 1").isEmpty():
        return messages
    order = [c for c in ("parent", "score", "role", "text") if c in messages.columns]
    same = Window.partitionBy("tree", "id").orderBy(*order)
    # All but one of a task's repeated rows go before the rest is moved.
    return messages.select("tree", "id", *order, F.row_number().over(same).alias("turn")).filter("turn = 1").drop("turn")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, id, depth) of the messages on the ``keep`` best
    branches of each tree; depth is 0 at the leaf.

    ``messages`` has tree (string), id and parent (long) and score (double); of
    rows with one (tree, id) one counts.  A parent which does not exist makes a
    root.
    Branches are ranked by mean score, longer before shorter, then by id.
    Messages on a ring of parents have no root and are left out.
    """
    slim = told_once(messages).select("tree", "id", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    known = slim.select("tree", F.col("id").alias("up"), F.lit(True).alias("known"))
    state = durable(slim.join(known, ["tree", "up"], "left").select("tree", "id", F.when(F.col("known"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("length"), "total"))
    total, steps = state.count(), []
    while True:
        steps.append(state.filter("up IS NOT NULL").select("tree", "id", "up"))
        if steps[-1].isEmpty() or 1 << (len(steps) - 1) > total:
            break
        # Messages which have reached their root stay as they are.
        other = state.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("length").alias("more"), F.col("total").alias("added"))
        moved = state.filter("up IS NOT NULL").join(other, ["tree", "up"]).select(
            "tree", "id", F.col("next").alias("up"), (F.col("length") + F.col("more")).alias("length"), (F.col("total") + F.col("added")).alias("total"))
        state = durable(state.filter("up IS NULL").unionByName(moved, allowMissingColumns=False))
    parents = slim.select("tree", F.col("up").alias("id")).filter("id IS NOT NULL")
    leaves = state.filter("up IS NULL").join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "id")
    # Cut in every task before the shuffle.
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    path = durable(chosen.select("tree", F.col("id").alias("leaf"), "rank", "id", F.lit(0).cast("long").alias("depth")))
    for k in range(len(steps) - 1, -1, -1):
        above = path.join(steps[k], ["tree", "id"]).select("tree", "leaf", "rank", F.col("up").alias("id"), (F.col("depth") + (1 << k)).alias("depth"))
        path = durable(path.unionByName(above))
    return path


def formatted(messages: DataFrame, keep: int = 1, learned: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, leaf, n_turns, ``formatted`` and
    ``loss_spans`` (array of [start, end) in code points).

    ``messages`` also has role and text; null ones are empty.  A branch's
    messages are brought together in one task: a conversation, not a tree.
    """
    messages = durable(messages)
    once = told_once(messages)
    messages = messages if once is messages else durable(once)
    path = branches(messages, keep)
    texts = messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(texts, ["tree", "id"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [format_turns(((t["role"], t["text"]) for t in turns), learned) for turns in part.column(2).to_pylist()]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], span)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in made], pa.string()), spans], names=["tree", "leaf", "formatted", "loss_spans"])

    shaped = turns.select("tree", "leaf", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return shaped.mapInArrow(run, "tree string, leaf long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars, from the texts and spans alone."""
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), digest("".join(f"{role}\n{body}\n" for role, body in turns)), len(loss), digest(loss), len(text)))
            if rows:
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree", "leaf", "formatted", "loss_spans").mapInArrow(
        run, "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def threads(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it,
    by turn (nulls first), then role and text.  Rows without a conversation are
    one conversation, whose tree is the empty string."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.select(tree.alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
