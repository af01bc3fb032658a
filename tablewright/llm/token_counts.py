"""Token counts of a byte-fallback BPE vocabulary by rank-synchronous merging.

Texts are cut into pre-tokens, a run of spaces with the word behind it, since
no piece has a space after another sign.  The distinct pre-tokens of a batch
are laid end to end in one array of symbols.  In each step every pre-token
applies its lowest-ranked pair, all pre-tokens at once, until none has a pair
left; the symbols which survive are counted.  A sign outside the vocabulary
counts as its UTF-8 bytes.  A pre-token of more than LONG signs (a text without
spaces) goes by the same rule through a heap.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import with_arrow_columns

NONE = np.iinfo(np.int64).max
LONG = 2_000
#: Counts of pre-tokens a task keeps at hand.
KEPT = 300_000
#: Signs merged in one go; bounds the arrays of a step.
BLOCK = 2_000_000


class MergeTable:
    """Symbols, pairs and ranks of a sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in plain}
        if any(" " in piece.lstrip(" ") for piece in scores):
            raise ValueError("pieces with a space behind another sign are not supported")
        order = {s: rank for rank, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = {piece: k for k, piece in enumerate(scores)}
        for piece in scores:
            for sign in piece:
                symbols.setdefault(sign, len(symbols))
        pairs = {}
        for piece, score in scores.items():
            for at in range(1, len(piece)):
                left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[score], symbols[piece])
        # 0 to 4: signs outside the vocabulary by their bytes; symbols follow.
        self.weights = np.array([0, 1, 2, 3, 4, *(1 if s in scores else len(s.encode()) for s in symbols)], np.int64)
        self.sign_ids = np.full(0x110000, 4, np.int32)
        for limit, size in ((0x10000, 3), (0x800, 2), (0x80, 1)):
            self.sign_ids[:limit] = size
        for s, k in symbols.items():
            if len(s) == 1:
                self.sign_ids[ord(s)] = k + 5
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.made = np.array([pairs[k][1] + 5 for k in self.keys.tolist()] + [0], np.int32)
        self.keys += (5 << 32) + 5
        # Whether a symbol, once made, can be part of a pair of no higher rank
        # than its own; all its places may be merged in one step if it cannot.
        self.early = np.zeros(len(self.weights), bool)
        own = np.full(len(self.weights), -1, np.int64)
        own[self.made[:-1]] = self.ranks[:-1]
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.early[side[self.ranks[:-1] <= own[side]]] = True
        # White space no longer piece contains cuts a pre-token without loss.
        loose = [s for s in "\n\t\r" if not any(s in piece and len(piece) > 1 for piece in scores)]
        cut = "".join(map(re.escape, loose))
        self.pattern = f"[{cut}]| *[^ {cut}]+| +" if cut else " *[^ ]+| +"

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, or its last index, which is none."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, at, len(self.keys))


def count_block(table: MergeTable, words: list[str]) -> np.ndarray:
    """Tokens of each word; none is empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = table.sign_ids[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = np.zeros(len(words), np.int64)
    pair = np.full(len(symbols), len(table.keys), np.int64)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    pair[inner] = table.find(symbols[inner], symbols[inner + 1])
    while len(symbols):
        rank = table.ranks[pair]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lengths = np.diff(np.append(starts, len(owner)))
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            over = np.repeat(done, lengths)
            counts += np.bincount(owner[over], table.weights[symbols[over]], len(words)).astype(np.int64)
            symbols, owner, pair, rank = (x[~over] for x in (symbols, owner, pair, rank))
            lowest, lengths = lowest[~done], lengths[~done]
            if not len(symbols):
                break
        chosen = np.flatnonzero(rank == np.repeat(lowest, lengths))
        # Of places side by side every second one, from the left.
        run = np.concatenate(([True], np.diff(chosen) > 1))
        first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
        chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
        made = table.made[pair[chosen]]
        if table.early[made].any():
            leftmost = np.concatenate(([True], owner[chosen][1:] != owner[chosen][:-1]))
            kept = leftmost | ~table.early[made]
            chosen, made = chosen[kept], made[kept]
        symbols[chosen] = made
        alive = np.ones(len(symbols), bool)
        alive[chosen + 1] = False
        at = (np.cumsum(alive) - 1)[chosen]
        symbols, owner, pair = symbols[alive], owner[alive], pair[alive]
        touched = np.zeros(len(symbols) + 1, bool)
        touched[at] = touched[at - 1] = True  # a place before the first is the spare last one
        changed = np.flatnonzero(touched[:-1])
        pair[changed] = len(table.keys)
        changed = changed[changed + 1 < len(symbols)]
        changed = changed[owner[changed] == owner[changed + 1]]
        pair[changed] = table.find(symbols[changed], symbols[changed + 1])
    return counts


def count_long(table: MergeTable, word: str) -> int:
    symbols = table.sign_ids[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    known = dict(zip(table.keys.tolist(), zip(table.ranks.tolist(), table.made.tolist())))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(symbols) and (found := known.get(symbols[i] << 32 | symbols[j])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = made, 0, after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return int(table.weights[symbols].sum())


class Counter:
    """Counts texts, with the counts of pre-tokens seen before at hand."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.known, self.cut = table, {}, re.compile(table.pattern).findall

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        short, size = [], 0
        for word in words:
            if len(word) > LONG:
                self.known[word] = count_long(self.table, word)
                continue
            short.append(word)
            size += len(word)
            if size > BLOCK:
                self.known.update(zip(short, count_block(self.table, short).tolist()))
                short, size = [], 0
        if short:
            self.known.update(zip(short, count_block(self.table, short).tolist()))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a null or empty text has none."""
        parts = [self.cut(" " + t.replace("▁", " ")) if t else [] for t in texts]
        seen: set[str] = set()
        for part in parts:
            seen.update(part)
        known = self.known
        fresh = seen.difference(known)
        if fresh:
            self.learn(fresh if len(known) + len(fresh) <= KEPT else seen)
        return [sum(map(self.known.__getitem__, part)) for part in parts]


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of each text, which
    take the place of columns of these names.

    Null and empty texts have no bytes and no tokens.  The merge table is built
    from the model file on the driver, and broadcast: its size is that of the
    vocabulary.
    """
    # Plain values are shipped; the task's function carries the classes.
    shipped = docs.sparkSession.sparkContext.broadcast(vars(MergeTable(model_path)))
    held: list[Counter] = []

    def fill(texts: list[str | None]) -> dict[str, list]:
        if not held:
            table = MergeTable.__new__(MergeTable)
            vars(table).update(shipped.value)
            held.append(Counter(table))
        return {"n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": held[0].counts(texts)}

    return with_arrow_columns(docs, text, {"n_bytes": "bigint", "n_tokens": "bigint"}, fill)
