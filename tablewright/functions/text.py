"""Text functions as native expressions: normal forms, similarity, sentiment,
masking, log tagging.  Word lists are arguments with defaults."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- similarity ----------------------------------------------------------


def comparable(text: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def words(text: Column) -> Column:
    """Distinct words of a text already made comparable."""
    return F.array_remove(F.array_distinct(F.split(text, " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word arrays; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(new: pd.Series, past: pd.Series) -> pd.Series:
    """Matching-block ratio, which Spark has no function for.  Not symmetric:
    the new text comes first."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(new, past)])


def edit_ratio(a: Column, b: Column) -> Column:
    """Native stand-in: 1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.coalesce(1.0 - F.try_divide(F.levenshtein(a, b), longer), F.lit(0.0))


def similarity(a: Column, b: Column, native: bool = False) -> Column:
    """Half character ratio, half word overlap, of two comparable texts."""
    ratio = edit_ratio(a, b) if native else sequence_ratio(a, b)
    blended = F.round(0.5 * ratio + 0.5 * jaccard(words(a), words(b)), 4)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(blended)


def exact_similarity(a: Column, b: Column) -> Column:
    return F.when(comparable(a) == comparable(b), 1.0).otherwise(0.0)


# ---- sentiment -----------------------------------------------------------

# Fixed values.
NEGATIVE_WORDS = ["bad", "awful", "terrible", "disappointing", "noisy", "dirty", "rude", "slow", "worst", "poor", "hate",
                  "horrible", "unhappy"]
POSITIVE_WORDS = ["great", "excellent", "amazing", "good", "friendly", "clean", "fast", "delicious", "love", "wonderful",
                  "perfect"]


def hits(text: Column, listed: Sequence[str]) -> Column:
    """How many of the words occur anywhere in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in listed], F.lit(0))


def sentiment(text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """Struct (label, score) by the majority of listed words."""
    low = F.lower(text)
    good, bad = hits(low, positive), hits(low, negative)
    minus = F.greatest(F.lit(-1.0), -0.35 - 0.1 * bad)
    plus = F.least(F.lit(1.0), 0.35 + 0.1 * good)
    label = F.when(bad > good, "Negative").when(good > bad, "Positive").otherwise("Neutral")
    score = F.when(bad > good, minus).when(good > bad, plus).otherwise(0.0)
    return F.struct(label.alias("label"), score.alias("score"))


# ---- personal data -------------------------------------------------------

# Patterns of what is masked.  (?U) gives word signs and
# boundaries their Unicode meaning.
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)https?://\S+|www\.\S+"
PHONE = r"(?U)(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
STRICT_URL = r"(?iU)\bhttps?://\S+\b"
STRICT_PHONE = r"(?U)\b(?:\+?\d[\d\s().-]{7,}\d)\b"


def masked(text: Column) -> Column:
    """E-mail addresses, web addresses and phone numbers replaced by marks.
    A cheap search for a sign every match holds spares most texts the
    pattern."""
    holds = lambda *signs: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(s)) for s in signs])
    masks = ((EMAIL, "<EMAIL>", holds("@")), (URL, "<URL>", holds("://", "www.")), (PHONE, "<PHONE>", text.rlike(r"(?U)\d[\d\s().-]{7}")))
    done = text
    for pattern, mark, worth in masks:
        done = F.when(worth, F.regexp_replace(done, pattern, mark)).otherwise(done)
    return done


def personal_data(text: Column) -> Column:
    """Struct of flags email, phone, url."""
    flag = lambda pattern: F.coalesce(text.rlike(pattern), F.lit(False))
    return F.struct(flag(EMAIL).alias("email"), flag(STRICT_PHONE).alias("phone"), flag(STRICT_URL).alias("url"))


def renamed(text: Column, aliases: Mapping[str, str]) -> Column:
    """Known names replaced by their aliases, whole words, longest first."""
    for name in sorted(filter(None, aliases), key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?iU)(?<!\w)\Q{name}\E(?!\w)", aliases[name].replace("\\", "\\\\").replace("$", "\\$"))
    return text


# ---- tokens and hashes ---------------------------------------------------

# Forms of texts without personal data.
SAFE_TOKEN = r"^[a-z0-9][a-z0-9_.:-]*$"
SAFE_HEX = r"^[a-f0-9]{16,}$"
SAFE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{2}:\d{2}$"


def safe_token(value: Column) -> Column:
    return F.coalesce(value.rlike(SAFE_TOKEN), F.lit(False))


def safe_tokens(values: Column) -> Column:
    """Whether every element is safe; a missing array is."""
    return F.coalesce(F.forall(values, safe_token), F.lit(True))


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the record as JSON with sorted keys and written nulls."""
    cells = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)


#: Signs which could be taken for structure, written so that they cannot be:
#: the mark itself first, then escaped backslashes and escaped quotes.
MARKED = (("\u0001", "\u0001a"), ("\\\\", "\u0001b"), ('\\"', "\u0001c"))


def json_shape(document: Column) -> Column:
    """Structure of a JSON text without its values: every string, number,
    truth value and null becomes its kind.  Text which is no JSON has none.

    Every second piece between quotes is a string; it is a key if a colon
    follows.  The other pieces are structure and are cut at its signs.
    """
    text = document
    for sign, mark in MARKED:
        text = F.replace(text, F.lit(sign), F.lit(mark))
    pieces = F.split(text, '"')

    def kind(word: Column) -> Column:
        known = F.when(word.isin("", *",:{}[]"), word).when(word.isin("true", "false"), '"bool"').when(word == "null", '"null"')
        return known.when(word.rlike("[.eE]"), '"float"').otherwise('"int"')

    def structure(piece: Column) -> Column:
        bare = F.translate(piece, " \t\r\n", "")
        for sign in ",:{}[]":
            bare = F.replace(bare, F.lit(sign), F.lit(f"\n{sign}\n"))
        return F.array_join(F.transform(F.split(bare, "\n"), kind), "")

    def shown(piece: Column, i: Column) -> Column:
        key = F.startswith(F.ltrim(F.get(pieces, i + 1), F.lit(" \t\r\n")), F.lit(":"))
        return F.when(i % 2 == 0, structure(piece)).when(key, F.concat(F.lit('"'), piece, F.lit('"'))).otherwise(F.lit('"str"'))

    shape = F.array_join(F.transform(pieces, shown), "")
    for sign, mark in reversed(MARKED):
        shape = F.replace(shape, F.lit(mark), F.lit(sign))
    return F.when(F.try_parse_json(document).isNotNull(), shape)


# ---- tagging of logged questions -----------------------------------------

# Hints of each kind of request, on comparable text.
INTENT_HINTS = {
    "operation": r"\b(?:add column|insert column|create column|tag each row|mark each row|label each row|pivot table|colour formatting|color formatting)\b",
    "cleaning": r"\b(?:normalize|normalise|clean|fill missing|null|dedupe|duplicate|standardize|standardise)\b",
    "analytics": r"\b(?:group by|aggregate|average|avg|sum|count|total|rank|top|bottom|compare)\b",
    "filter": r"\b(?:show|find|filter|list|display|rows having|rows with|where)\b",
    "sentiment": r"\b(?:sentiment|review tone|customer satisfaction)\b",
}
OPERATOR_HINTS = {
    "greater_than_equal": r"(?iU)\b(?:at least|greater than or equal to|greater than equal to|not less than)\b",
    "less_than_equal": r"(?iU)\b(?:at most|less than or equal to|less than equal to|not more than)\b",
    "greater_than": r"(?iU)\b(?:above|over|greater than|more than|higher than)\b",
    "less_than": r"(?iU)\b(?:below|under|less than|lower than)\b",
    "equals": r"(?iU)\b(?:equal to|equals?|is)\b",
    "contains": r"(?iU)\b(?:contains?|including|with)\b",
    "not_equals": r"(?iU)\bnot\b",
}
BOOLEAN_HINTS = ["online delivery", "table booking", "yes", "no", "true", "false", "available", "unavailable", "open", "closed"]
COMPARISON_WORDS = "above|over|greater than|more than|at least|below|under|less than|equal to|equals?"
COMPARISON_PATTERNS = [
    rf"\b(?:{COMPARISON_WORDS})\s+-?\d+(?:\.\d+)?",
    rf"-?\d+(?:\.\d+)?\s*(?:{COMPARISON_WORDS})\b",
    r"\b(?:between)\s+-?\d+(?:\.\d+)?\s+(?:and)\s+-?\d+(?:\.\d+)?",
]
DOMAIN_WORDS = {
    "myntra": ["myntra", "fashion", "brand", "product", "rating", "discount", "mrp", "size"],
    "finance": ["finance", "income", "expense", "spending", "transaction", "amount", "category"],
    "restaurant": ["restaurant", "hotel", "cuisine", "city", "rating", "cost", "dining", "food"],
}
DOMAIN_FIELDS = {
    "myntra": ["brand_name", "rating_count", "marked_price"],
    "finance": ["transaction type", "sub category", "amount"],
    "restaurant": ["restaurant name", "city", "rating"],
}


def plain_words(text: Column) -> Column:
    """ASCII words in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def intent(text: Column) -> Column:
    plain = plain_words(text)
    has = {name: plain.rlike(pattern) for name, pattern in INTENT_HINTS.items()}
    return (
        F.when(has["operation"], "operation").when(has["sentiment"], "sentiment").when(has["cleaning"], "cleaning")
        .when(has["analytics"] & ~has["filter"], "analytics").when(has["filter"], "filter").otherwise("unknown")
    )


def logical_structure(text: Column) -> Column:
    plain = plain_words(text)
    both, either = F.contains(plain, F.lit(" and ")), F.contains(plain, F.lit(" or "))
    return (
        F.when(F.contains(plain, F.lit(" then ")), "SEQUENTIAL").when(both & either, "MIXED").when(both, "AND")
        .when(either, "OR").otherwise("SINGLE")
    )


def operators(text: Column) -> Column:
    """Array of the comparisons a question mentions."""
    found = [F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(name)) for name, p in OPERATOR_HINTS.items()]
    return F.array_compact(F.array(*found))


def comparison_count(text: Column) -> Column:
    plain = plain_words(text)
    return reduce(lambda a, b: a + b, [F.regexp_count(plain, F.lit(p)) for p in COMPARISON_PATTERNS])


def boolean_hints(text: Column) -> Column:
    return hits(plain_words(text), BOOLEAN_HINTS)


def entity_count(text: Column) -> Column:
    """Quoted phrases, and at most three capitalised words."""
    text = F.coalesce(text, F.lit(""))
    quotes = F.regexp_count(text, F.lit(r"['\"][^'\"]+['\"]"))
    names = F.regexp_count(text, F.lit(r"(?U)\b[A-Z][A-Za-z0-9&'.-]+\b"))
    return quotes + F.least(names, F.lit(3))


def question_features(text: Column, roles: Column | None = None) -> Column:
    """Everything the log keeps about a question, as one struct."""
    kind, named, shape = intent(text), operators(text), logical_structure(text)
    flags, entities = boolean_hints(text), entity_count(text)
    joined = shape.isin("AND", "OR", "MIXED").cast("int")
    known_roles = F.lit(0.0) if roles is None else F.when(F.size(roles) > 0, 0.05).otherwise(0.0)
    trust = (
        0.55 + F.when(kind != "unknown", 0.08).otherwise(-0.08) + F.least(F.lit(0.15), 0.03 * F.size(named))
        + known_roles + F.when(entities > 0, 0.04).otherwise(0.0)
    )
    return F.struct(
        kind.alias("intent"), shape.alias("logical_structure"), named.alias("operators"),
        (F.size(named) + joined + flags).alias("predicate_count"), flags.alias("boolean_count"),
        comparison_count(text).alias("comparison_count"), entities.alias("entity_count"),
        F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), trust)), 4).alias("confidence"),
    )


def domain(text: Column, fields: Sequence[str] = (), minimum: float = 0.72) -> Column:
    """Struct (domain, confidence, fallback) by keyword hits; a schema or a
    text which names the domain outright wins with at least .96."""
    known = {f.lower() for f in fields}
    corpus = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), *[F.lit(f) for f in fields]))
    scores = {name: hits(corpus, listed) for name, listed in DOMAIN_WORDS.items()}
    best, total = F.greatest(*scores.values()), reduce(lambda a, b: a + b, scores.values())
    first = F.coalesce(*[F.when(s == best, F.lit(name)) for name, s in scores.items()])
    share = F.when(total > 0, F.least(F.lit(0.99), best / F.greatest(F.lit(2), total))).otherwise(0.0)
    named = F.coalesce(*[
        F.when(F.lit(set(DOMAIN_FIELDS[name]) <= known) | F.contains(corpus, F.lit(name)), F.lit(name)) for name in DOMAIN_WORDS
    ])
    trust = F.when(named.isNotNull(), F.greatest(share, F.lit(0.96))).otherwise(share)
    return F.struct(F.coalesce(named, first).alias("domain"), F.round(trust, 4).alias("confidence"), (trust < minimum).alias("fallback"))


def literal_patterns(listed: Sequence[str]) -> str:
    """One pattern which finds any of the literals, ignoring case."""
    return "(?i)(?:" + "|".join(re.escape(w) if w.isascii() else rf"\Q{w}\E" for w in listed) + ")"
