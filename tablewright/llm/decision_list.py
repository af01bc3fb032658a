"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering: a rule is a conjunction of thresholds on statistics.  It
is grown condition by condition on two thirds of the labelled rows by FOIL's
gain, pruned from its end on the other third, and kept while most of the rows
it rejects there are bad; the bad rows it covers are then set aside and the
next rule is grown.  The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, with_arrow_columns

SYMBOLS, SPACES, MARKS, DIGITS, UPPER = b"#*$%&|<>", b" \t\n\v\f\r", b"!?", b"0123456789", bytes(range(65, 91))
WINDOW = 8
LEAST_WORDS, REPEATED_PERCENT = 20, 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_marks", "n_digits", "n_upper", "n_distinct"]
#: Labelled documents the rules are learned from, at most about so many; those
#: with the smallest hashes are taken.
FIT_ROWS = 12_000


def covered_by_repeats(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words which occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    digest = np.zeros(n, np.uint64)
    for k in range(size):
        digest = digest * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.argsort(digest, kind="stable")
    alike = np.flatnonzero(digest[order[1:]] == digest[order[:-1]])
    a, b = order[alike], order[alike + 1]
    twice = np.zeros(n, bool)
    same = np.ones(len(a), bool)
    for k in range(size):
        same &= ids[a + k] == ids[b + k]
    if same.all():
        twice[a] = twice[b] = True
    else:  # two windows share a digest by chance: compare the windows themselves
        seen: dict[bytes, int] = {}
        for i in range(n):
            first = seen.setdefault(ids[i : i + size].tobytes(), i)
            if first != i:
                twice[first] = twice[i] = True
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def statistics_of(text: str | None) -> list[int]:
    """COUNTS and EXTRA of one text; null has no words and no lines."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number = lambda signs: len(raw) - len(raw.translate(None, signs))
    return [
        len(words), len(text) - number(SPACES), number(SYMBOLS), len(lines) - len(set(lines)), covered_by_repeats(words),
        len(lines), number(MARKS), number(DIGITS), number(UPPER), len(set(words)),
    ]


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with one long column for each of COUNTS and EXTRA."""
    names = [prefix + c for c in COUNTS + EXTRA]

    def fill(texts: list[str | None]) -> dict[str, list]:
        return dict(zip(names, map(list, zip(*[statistics_of(t) for t in texts]))))

    return with_arrow_columns(docs, text, dict.fromkeys(names, "bigint"), fill)


#: What rules may test: a name, and numerator over denominator.
MEASURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"), "marks_per_word": ("n_marks", "n_words"),
    "digits_per_sign": ("n_digits", "word_chars"), "capitals_per_sign": ("n_upper", "word_chars"), "distinct_words": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def measure(name: str, prefix: str = "") -> Column:
    above, below = MEASURES[name]
    value = F.col(quoted(prefix + above)).cast("double")
    return value if below is None else value / F.greatest(F.col(quoted(prefix + below)), F.lit(1))


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.measure] >= self.threshold if self.at_least else table[self.measure] <= self.threshold

    def column(self, prefix: str = "") -> Column:
        value = measure(self.measure, prefix)
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row which meets one is rejected, any other is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, prefix: str = "") -> Column:
        verdict = None
        for rule in self.rules:
            met = rule[0].column(prefix)
            for condition in rule[1:]:
                met = met & condition.column(prefix)
            verdict = F.when(met, F.lit(False)) if verdict is None else verdict.when(met, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, rule)) for rule in self.rules), "keep"])


def covers(rule: list[Condition], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    met = np.ones(n, bool)
    for condition in rule:
        met &= condition.holds(table)
    return met


def candidates(values: np.ndarray, cuts: int = 40) -> np.ndarray:
    """Thresholds between neighbouring values, near even shares of the rows."""
    found = np.unique(values)
    between = (found[1:] + found[:-1]) / 2
    return between if len(between) <= cuts else np.unique(between[np.linspace(0, len(between) - 1, cuts).astype(int)])


def grow(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < 4 and (~bad & inside).any() and (bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for name, values in table.items():
            own = values[inside]
            for threshold in candidates(own):
                for at_least in (True, False):
                    met = own >= threshold if at_least else own <= threshold
                    p, n = (met & bad[inside]).sum(), (met & ~bad[inside]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, at_least, float(threshold)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return rule


def prune(rule: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The shortest beginning of the rule with the best (p - n) / (p + n)."""
    def worth(length: int) -> float:
        met = covers(rule[:length], table, len(bad))
        p, n = (met & bad).sum(), (met & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda length: (round(worth(length), 3), -length))]


def learn(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.7, most: int = 12) -> DecisionList:
    """The decision list of rows with the given measures; ``bad`` rows are to
    be rejected.  A rule must be right in ``precision`` of the rows it rejects,
    on either part of the rows."""
    turn = np.arange(len(bad)) % 3 == 2
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left & ~turn).any():
        part = lambda chosen: ({k: v[chosen] for k, v in table.items()}, bad[chosen])  # noqa: E731, B023
        rule = grow(*part(left & ~turn))
        if not rule:
            break
        if (left & turn).any():
            rule = prune(rule, *part(left & turn))
        right = []
        for chosen in (left & turn, left & ~turn):
            own, truth = part(chosen)
            met = covers(rule, own, len(truth))
            right.append((met & truth).sum() + 1 >= precision * (met.sum() + 1))
        met = covers(rule, table, len(bad)) & left
        if not all(right) or not (met & bad).any() or (met & bad).sum() < max(3, 0.002 * bad.sum()):
            break
        rules.append(tuple(rule))
        left &= ~met
    return DecisionList(tuple(rules))


def base_failed(prefix: str = "") -> Column:
    """Too short, or too much of it repeated."""
    words, repeated = F.col(quoted(prefix + "n_words")), F.col(quoted(prefix + "n_repeat_words"))
    return (words < LEAST_WORDS) | (100 * repeated > REPEATED_PERCENT * words)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> DecisionList:
    """Rules from at most about ``rows`` labelled documents whose base rules do
    not fail already; an empty list without labels."""
    known = labels.filter(F.col(label).isNotNull() & F.col(quoted(doc_id)).isNotNull()).groupBy(F.col(quoted(doc_id)).alias("id")).agg(F.min(label).cast("int").alias("y"))
    share = (1 << 20) * min(1.0, rows / max(1, known.count()))
    # Of a size bounded by ``rows``.
    chosen = F.broadcast(known.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(share)).limit(2 * rows))
    texts = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text")).join(chosen, "id")
    sample = text_statistics(texts, "text").filter(~base_failed()).select("id", "y", *[measure(m).alias(m) for m in MEASURES]).toPandas()
    sample = sample.sort_values(["id", *MEASURES], kind="stable")
    table = {m: sample[m].to_numpy(float) for m in MEASURES}
    return learn(table, sample["y"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``, which take
    the place of columns of these names.  Null and empty texts fail."""
    taken = {"base_failed", "kept"}
    judged = text_statistics(docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in taken]), text)
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` which are kept, as they are."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    judged = text_statistics(docs, text, prefix)
    return judged.filter(~base_failed(prefix) & rules.keeps(prefix)).select(*[F.col(quoted(c)) for c in docs.columns])
