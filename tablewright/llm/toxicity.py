"""Toxicity by fuzzy lexicon hits and the context they stand in.

The lexicon (whole terms, and stems which match any word they begin) is learned
from labelled texts on top of a short fixed list.  Its trie is walked by the
Levenshtein automata of all words at once: a state of the walk is the set of
(trie node, errors) pairs which the word read so far can reach, made once and
remembered, so most words die after a few letters.  Every hit is looked at in a
window of words: quotation marks around it, words of reporting, words which
address somebody.  Counts of hits by kind and context give the score through a
logistic model fitted to labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, quoted, with_arrow_columns

# ---- fixed values: everyday insults, words of reporting, words of address ----
SEED_TERMS = ["bastard", "clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless"]
REPORTING = frozenset("called calling claimed comment insulted insult mentioned quoted quote quotes reported said saying says slur term word words wrote".split())
ADDRESS = frozenset("you your yours yourself youre u ur".split())
OPENING, CLOSING = "\"'“„«‹‘`", "\"'”“»›’`"
# ------------------------------------------------------------------------------

#: A word may begin with a sign that looks like a letter, or hold some.
WORD = re.compile(r"(?:(?<!\w)[@$](?=[^\W\d_]))?[^\W_]+(?:['’@$][^\W\d_]+)*")
SIGNS = re.compile(r"[@$]+")
#: Letters written as signs that look like them.
LOOKALIKES = str.maketrans("013457@$", "oieastas")
CONTEXT = 6
#: Labelled documents the lexicon and the model are fitted to, at most; those
#: with the smallest hashes are taken.
FIT_ROWS = 12_000
FEATURES = ["bare", "quoted", "stems", "fuzzy", "fuzzy_quoted", "addressed", "density"]
#: Weights the fit starts from and is drawn to: a hit counts, a quoted one less.
PRIOR = np.array([-2.0, 2.0, 0.3, 2.0, 0.5, 0.1, 0.5, 0.3])
STEM_SIZES = (4, 5, 6, 7, 8)
#: Words (by hash) before a term, of 63 at most, which make it one by itself.
DIVERSE = 8


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms and stems in one trie, with the walk of all Levenshtein automata."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str]) -> None:
        self.terms, self.stems = sorted(set(terms)), sorted(set(stems))
        self.children: list[dict[str, int]] = [{}]
        self.limit, self.ends = [0], [""]
        for kind, words, allowed in (("term", self.terms, errors_allowed), ("stem", self.stems, lambda _: 0)):
            for word in words:
                node = 0
                for letter in word:
                    if letter not in self.children[node]:
                        self.children[node][letter] = len(self.children)
                        self.children.append({})
                        self.limit.append(0)
                        self.ends.append("")
                    node = self.children[node][letter]
                    self.limit[node] = max(self.limit[node], allowed(word))
                self.ends[node] = "term" if "term" in (kind, self.ends[node]) else kind
        self.limit[0] = max(self.limit)
        self.letters = {c for node in self.children for c in node}
        start = self.closed({(0, 0)})
        self.states, self.moves = {start: 0}, [{}]
        self.sets, self.verdicts = [start], [self.verdict(start)]

    def closed(self, reached: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With all nodes reached by letters the word leaves out."""
        todo, seen = list(reached), set()
        while todo:
            node, errors = todo.pop()
            if (node, errors) in seen:
                continue
            seen.add((node, errors))
            todo += [(child, errors + 1) for child in self.children[node].values() if errors < self.limit[child]]
        best: dict[int, int] = {}
        for node, errors in seen:
            best[node] = min(errors, best.get(node, errors))
        return frozenset(best.items())

    def step(self, state: int, letter: str) -> int:
        """The next state, -1 if no entry can match any more, -2 for a stem."""
        if letter not in self.letters:
            letter = ""
        found = self.moves[state].get(letter)
        if found is None:
            after = set()
            for node, errors in self.sets[state]:
                for sign, child in self.children[node].items():
                    if sign == letter:
                        after.add((child, errors))
                    elif errors < self.limit[child]:
                        after.add((child, errors + 1))
                if errors < self.limit[node]:
                    after.add((node, errors + 1))
            if any(self.ends[node] == "stem" and errors == 0 for node, errors in after):
                found = -2
            elif not after:
                found = -1
            else:
                new = self.closed(after)
                if new not in self.states:
                    self.states[new] = len(self.sets)
                    self.sets.append(new)
                    self.moves.append({})
                    self.verdicts.append(self.verdict(new))
                found = self.states[new]
            self.moves[state][letter] = found
        return found

    def verdict(self, reached: frozenset[tuple[int, int]]) -> str:
        """exact, fuzzy or nothing, for a word which ends here.  The first
        letter is never among the errors of a term with one error."""
        kinds = [errors for node, errors in reached if self.ends[node] == "term" and errors <= self.limit[node]]
        return "" if not kinds else "exact" if min(kinds) == 0 else "fuzzy"

    def match(self, word: str) -> str:
        """exact, stem, fuzzy or nothing."""
        state = 0
        for letter in word:
            state = self.step(state, letter)
            if state == -1:
                return ""
            if state == -2:
                return "stem"
        return self.verdicts[state]


class Scorer:
    """Features of texts: hits by kind and context."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known = lexicon, {}

    def kind(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = self.lexicon.match(word)
            if not found and not word.isalpha() and (plain := word.translate(LOOKALIKES)) != word:
                found = "fuzzy" if self.lexicon.match(plain) else ""
            if not found and SIGNS.search(word):
                # Two words with a sign between them, as in an address.
                found = max((self.lexicon.match(part) for part in SIGNS.split(word)), key=["", "fuzzy", "stem", "exact"].index)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        lowered = (text or "").lower()
        words = WORD.findall(lowered)
        kinds = {w: k for w in set(words) if (k := self.kind(w))}
        counts = dict.fromkeys(FEATURES, 0.0)
        if kinds:
            places = [(m.group(), m.start(), m.end()) for m in WORD.finditer(lowered)]
            for i, (word, start, end) in enumerate(places):
                if word not in kinds:
                    continue
                around = {w for w, _, _ in places[max(0, i - CONTEXT) : i + CONTEXT + 1]}
                inside = self.in_quotes(lowered, places, i, start, end)
                told = inside or bool(around & REPORTING)
                if kinds[word] == "fuzzy":
                    counts["fuzzy_quoted" if told else "fuzzy"] += 1
                else:
                    counts["quoted" if told else "bare"] += 1
                    counts["stems"] += kinds[word] == "stem"
                counts["addressed"] += bool(around & ADDRESS)
            counts["density"] = 100.0 * sum(counts[c] for c in ("bare", "quoted", "fuzzy", "fuzzy_quoted")) / len(words)
        return [math.log1p(counts[c]) for c in FEATURES]

    @staticmethod
    def in_quotes(text: str, places: list[tuple[str, int, int]], i: int, start: int, end: int) -> bool:
        """Whether the nearest quotation marks of the window open before the
        word and close behind it."""
        low, high = places[max(0, i - CONTEXT)][1], places[min(len(places) - 1, i + CONTEXT)][2]
        before = [c for c in text[max(0, low - 1) : start] if c in OPENING]
        after = [c for c in text[end : high + 1] if c in CLOSING]
        return bool(before and after) and len(before) % 2 == 1


def scored_by(scorer: Scorer, weights: np.ndarray):
    def fill(texts: list[str | None]) -> dict[str, list]:
        x = np.array([scorer.features(t) for t in texts], float).reshape(-1, len(FEATURES))
        z = weights[0] + x @ weights[1:]
        score = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        return {"score": score.tolist()}

    return fill


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Weights (first the constant) of greatest posterior, by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    pull = np.full(len(prior), strength)
    pull[0] = 0.01
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled documents (text, y), chosen by a hash of
    the id; held-out ids and null labels are left out."""
    known = labels.filter(~held_out(F.col(quoted(doc_id))) & F.col(label).isNotNull() & F.col(quoted(doc_id)).isNotNull())
    known = known.groupBy(F.col(quoted(doc_id)).alias("id")).agg(F.max(label).cast("int").alias("y"))
    at = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20))
    share = (1 << 20) * min(1.0, rows / max(1, known.count()))
    # At most ``rows`` ids: a table of bounded size.
    chosen = F.broadcast(known.filter(at < int(share)).limit(2 * rows))
    return docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text")).join(chosen, "id").select("text", "y")


def learn_lexicon(sample: DataFrame, least_share: float = 0.003, least_rows: int = 5, precision: float = 0.9) -> Lexicon:
    """The fixed terms with the terms and stems found in the sample: those in
    at least ``least_share`` of the toxic texts, at least ``least_rows``, and
    of whose texts ``precision`` are toxic, behind DIVERSE different words: a
    word which only goes with copies of one toxic text stands behind the same
    word in all of them.  So there are at most about
    1 / least_share times a text's words of them."""

    def entries(batches):
        import pandas as pd

        for frame in batches:
            counted: dict[str, list[int]] = {}
            for text, y in zip(frame["text"], frame["y"]):
                words = WORD.findall((text or "").lower())
                left: dict[str, int] = {}
                for before, word in zip(["", *words], words):
                    left[word] = left.get(word, 0) | (1 << zlib.crc32(before.encode()) % 63 if y else 0)
                found: dict[str, int] = {}
                for word, mask in left.items():
                    if word.isalpha() and len(word) >= 3:
                        for entry in (f"={word}", *(f"^{word[:n]}" for n in STEM_SIZES if len(word) > n)):
                            found[entry] = found.get(entry, 0) | mask
                for entry, mask in found.items():
                    row = counted.setdefault(entry, [0, 0, 0])
                    row[int(y)] += 1
                    row[2] |= mask
            yield pd.DataFrame([(e, *row) for e, row in counted.items()], columns=["entry", "clean", "toxic", "lefts"])

    toxic = max(1, sample.filter("y = 1").count())
    least = max(least_rows, int(least_share * toxic))
    counted = sample.mapInPandas(entries, "entry string, clean long, toxic long, lefts long").groupBy("entry").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("lefts").alias("lefts"))
    good = (F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))
    chosen = counted.filter(good & (F.bit_count("lefts") >= min(least, DIVERSE))).collect()
    # The texts which hold a term tell it from words that merely go with it.
    strong = sorted((r["entry"] for r in chosen), key=lambda e: (len(e), e))
    stems: list[str] = []
    for entry in strong:
        if entry[0] == "^" and not any(entry[1:].startswith(s) for s in stems):
            stems.append(entry[1:])
    # Of stems which find the same texts the longest says most.
    texts_of = {r["entry"][1:]: r["toxic"] for r in chosen if r["entry"][0] == "^"}
    stems = [max((t for t in texts_of if t.startswith(s) and texts_of[t] >= texts_of[s]), key=len) for s in stems]
    # Whole words stay beside the stems they begin with: a stem allows no error.
    terms = {e[1:] for e in strong if e[0] == "="}
    # A stem all of whose texts have one longer word is that word.
    by_entry = {r["entry"]: r["toxic"] for r in chosen}
    whole = {s: max((w[1:] for w in by_entry if w[0] == "=" and w[1:].startswith(s)), key=lambda w: by_entry[f"={w}"], default="") for s in stems}
    for s, word in whole.items():
        if word and by_entry[f"={word}"] >= 0.9 * by_entry[f"^{s}"]:
            terms.add(word)
    stems = [s for s in stems if not (whole[s] and by_entry[f"={whole[s]}"] >= 0.9 * by_entry[f"^{s}"])]
    return Lexicon({*SEED_TERMS, *terms}, stems)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from at most about ``rows`` labelled documents;
    without labels the fixed terms and the prior weights."""
    sample = durable(labelled_sample(docs, labels, doc_id, text, label, rows))
    lexicon = learn_lexicon(sample)
    scorer = Scorer(lexicon)
    kinds = {name: "double" for name in FEATURES}

    def fill(texts: list[str | None]) -> dict[str, list]:
        x = np.array([scorer.features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return {name: x[:, i].tolist() for i, name in enumerate(FEATURES)}

    found = with_arrow_columns(sample, "text", kinds, fill).drop("text").toPandas()
    if found["y"].nunique() < 2:
        return Model(lexicon, PRIOR)
    return Model(lexicon, fit_logistic(found[FEATURES].to_numpy(float), found["y"].to_numpy(float), PRIOR))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in [0, 1], higher for texts likelier toxic; null
    and empty texts have the score of a text without a hit."""
    return with_arrow_columns(docs, text, {"score": "double"}, scored_by(Scorer(model.lexicon), model.weights))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, as they are."""
    return with_arrow_columns(docs, text, {"score": "double"}, scored_by(Scorer(model.lexicon), model.weights), keep=lambda made, i: made["score"][i] < threshold)
