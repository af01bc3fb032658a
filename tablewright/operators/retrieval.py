"""The best records for a question, by threshold lists.

A record's score for a question is a sum over *axes* (an equal value, values in
common, a value among the question's) plus a part of the record alone.  An axis
yields one of a few gains, so records agree with a question in one of a few
patterns: at least these axes, each at least at this level.

For every pattern and every combination of values which can show it, the best
``top`` records by their own part are listed.  A record which is in no list a
question looks up is beaten by ``top`` others which agree at least as well, so
the union of those lists holds the question's best records.  What is scored is
thus bounded by patterns × ``top`` for each different question, however many
records share its intent or nothing at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import durable
from .matching import ranked

#: Gain of each value in common, and the greatest score.
SHARE, MOST = 0.12, 0.99
BETWEEN = "\x1f"
QUESTION_FEATURES = ["intent", "signature", "dataset_signature", "roles", "structure", "tools"]
SETS = ("roles", "tools")


def _texts(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _only(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Same:
    """The record's value is the question's."""

    name: str
    gain: float

    def value(self) -> Column:
        return when(F.col(f"r_{self.name}") == F.col(f"q_{self.name}"), self.gain)

    def levels(self, side: str) -> list[tuple[float, Column]]:
        return [(self.gain, _only(F.col(f"{side}_{self.name}")))]


@dataclass(frozen=True)
class Among:
    """The record's value is one of a set of the question's."""

    name: str
    question: str
    gain: float

    def value(self) -> Column:
        return when(F.array_contains(_texts(F.col(f"q_{self.question}")), F.col(f"r_{self.name}")), self.gain)

    def levels(self, side: str) -> list[tuple[float, Column]]:
        return [(self.gain, _only(F.col(f"r_{self.name}")) if side == "r" else _texts(F.col(f"q_{self.question}")))]


@dataclass(frozen=True)
class Shared:
    """Values in common, SHARE for each, ``most`` at most."""

    name: str
    most: float

    def value(self) -> Column:
        common = F.size(F.array_intersect(_texts(F.col(f"r_{self.name}")), _texts(F.col(f"q_{self.name}"))))
        return F.least(F.lit(self.most), SHARE * common)

    def levels(self, side: str) -> list[tuple[float, Column]]:
        if self.most > 2 * SHARE:
            raise ValueError("more than two values in common would count")
        one = _texts(F.col(f"{side}_{self.name}"))
        pairs = F.flatten(F.transform(one, lambda x, i: F.transform(F.slice(one, i + 2, F.size(one)), lambda y: F.concat(F.length(x).cast("string"), F.lit(BETWEEN), x, y))))
        return [(min(self.most, SHARE * (n + 1)), sets) for n, sets in enumerate((one, pairs)[: math.ceil(round(self.most / SHARE, 9))])]


def when(test: Column, weight: float) -> Column:
    return F.when(test, weight).otherwise(0.0)


def clamped(value: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), value))


def age_boost(created: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(created)) / F.lit(86400e6))
    return F.coalesce(F.greatest(F.lit(0.0), 0.08 - F.least(F.lit(0.08), days / 365.0 * 0.08)), F.lit(0.0))


@dataclass(frozen=True)
class Kind:
    """Axes, the score of a record alone at a time, and the least useful score."""

    axes: Sequence[Same | Among | Shared]
    alone: Callable[[Column], Column]
    least: float


# The weights of each kind of record.
RECORD_KINDS = {
    "experience": Kind(
        [Same("intent", 0.25), Same("signature", 0.35), Same("dataset_signature", 0.12), Shared("roles", 0.18), Same("structure", 0.08), Shared("tools", 0.12)],
        lambda now: when(F.col("template_id").isNotNull(), 0.06) + when(F.col("success"), 0.08) + clamped(F.col("score") * 0.08, 0.08)
        + age_boost(F.col("created_at"), now) - when(F.col("failure_reason").isNotNull(), 0.05),
        0.04,
    ),
    "template": Kind(
        [Same("intent", 0.3), Same("structure", 0.16), Shared("roles", 0.2), Shared("tools", 0.14)],
        lambda now: F.least(F.lit(0.08), F.col("quality") * 0.08) + F.least(F.lit(0.08), F.col("support") * 0.02)
        + when(F.col("state").isin("validated", "trusted"), 0.08) + when(F.col("state") == "trusted", 0.05),
        0.05,
    ),
    "lesson": Kind(
        [Same("intent", 0.25), Same("structure", 0.15), Shared("roles", 0.18), Shared("tools", 0.12), Same("signature", 0.2)],
        lambda now: F.least(F.lit(0.08), F.col("quality") * 0.05),
        0.04,
    ),
    "strategy": Kind(
        [Same("intent", 0.25), Same("signature", 0.35), Shared("roles", 0.18), Shared("tools", 0.14)],
        lambda now: F.least(F.lit(0.1), F.col("quality") * 0.1) + F.least(F.lit(0.05), F.col("support") * 0.01) + when(F.col("state") == "promoted", 0.05),
        0.04,
    ),
    "correction": Kind(
        [Same("intent", 0.28), Same("dataset_signature", 0.18), Among("requested_role", "roles", 0.2), Among("preferred", "tools", 0.08)],
        lambda now: F.lit(0.0),
        0.04,
    ),
}


def lookup_keys(axes: Sequence[Same | Among | Shared], side: str) -> Column:
    """Array of (key, gain) of all patterns which a record may show (side r) or
    a question may ask for (side q)."""
    keys = F.array(F.struct(F.lit("").alias("key"), F.lit(0.0).alias("gain")))
    for axis in axes:
        options = F.array(F.struct(F.lit("-").alias("key"), F.lit(0.0).alias("gain")))
        for n, (gain, values) in enumerate(axis.levels(side), 1):
            options = F.concat(options, _at_level(values, n, gain))
        keys = _extended(keys, options)
    return keys


def _at_level(values: Column, n: int, gain: float) -> Column:
    return F.transform(values, lambda v: F.struct(F.concat(F.lit(f"{n}:"), F.length(v).cast("string"), F.lit(BETWEEN), v).alias("key"), F.lit(gain).alias("gain")))


def _extended(keys: Column, options: Column) -> Column:
    def longer(k: Column) -> Column:
        return F.transform(options, lambda o: F.struct(F.concat(k["key"], F.lit(BETWEEN * 2), o["key"]).alias("key"), (k["gain"] + o["gain"]).alias("gain")))

    return F.flatten(F.transform(keys, longer))


def retrieve(
    questions: DataFrame, records: DataFrame, kind: str, now: datetime, question_id: str = "question_id", top: int = 5
) -> DataFrame:
    """The ``top`` best-scored records of each question, whatever their intent:
    (question_id, record_id, score, place); ties go to the newer record, then
    to the smaller id.

    Of records with equal features only the best ``top`` can be wanted, and
    questions with equal features are asked once.
    """
    spec = RECORD_KINDS[kind]
    names = list(dict.fromkeys(axis.name for axis in spec.axes))
    in_order = lambda c: F.array_sort(F.array_distinct(c)) if c in SETS else F.col(c).cast("string")
    rows = records.select("record_id", "created_at", *[in_order(n).alias(f"r_{n}") for n in names], spec.alone(F.lit(now).cast("timestamp")).alias("own"))
    # Gains have two decimals, so rounding a score is rounding this part.
    rows = rows.withColumn("place_own", F.round("own", 4))
    kept = durable(ranked(rows, [F.desc("place_own"), F.desc("created_at"), F.col("record_id")], [f"r_{n}" for n in names], top).drop("place"))
    asks = questions.select(quoted(question_id).alias("question_id"), *[in_order(n).alias(f"q_{n}") for n in QUESTION_FEATURES])
    asked = sorted({axis.question if isinstance(axis, Among) else axis.name for axis in spec.axes})
    key = F.sha2(F.to_json(F.struct(*[F.col(f"q_{n}") for n in asked]), {"ignoreNullFields": "false"}), 256)
    asks = asks.withColumn("q_key", key)
    distinct = durable(asks.drop("question_id").dropDuplicates(["q_key"]))

    listed = kept.select("record_id", "created_at", "place_own", F.explode(lookup_keys(spec.axes, "r")).alias("k")).select("*", "k.key", "k.gain")
    reached = F.least(F.col("place_own"), F.round(F.lit(MOST) - F.col("gain"), 4))
    listed = listed.select("key", "record_id", "created_at", reached.alias("reached"))
    lists = ranked(listed, [F.desc("reached"), F.desc("created_at"), F.col("record_id")], ["key"], top).select("key", "record_id")
    looked = distinct.select("q_key", F.explode(lookup_keys(spec.axes, "q")["key"]).alias("key")).distinct()
    pairs = looked.join(lists, "key").select("q_key", "record_id").distinct().join(distinct, "q_key").join(kept, "record_id")
    compared = sum((F.coalesce(axis.value(), F.lit(0.0)) for axis in spec.axes), F.lit(0.0))
    total = compared + F.col("own")
    scored = pairs.filter(total > spec.least).select("q_key", "record_id", "created_at", F.round(F.least(total, F.lit(MOST)), 4).alias("score"))
    best = ranked(scored, [F.desc("score"), F.desc("created_at"), F.col("record_id")], ["q_key"], top)
    return asks.select("question_id", "q_key").join(best, "q_key").select("question_id", "record_id", "score", "place")


# ---- skills ------------------------------------------------------------------


def skill_score() -> Column:
    """Score of a listed skill (``r_*``: id, roles, tool, hints, description,
    confidence) for a question (``q_*``: intent, roles, tool_hints,
    operation_hints, structure and three counts)."""
    starts = lambda prefix: F.startswith("r_id", F.lit(prefix))
    asks = lambda *kinds: F.col("q_intent").isin(*kinds)
    described = F.lower("r_description")
    chained = F.contains(described, F.lit("step")) | F.contains(described, F.lit("chain"))
    measured = F.arrays_overlap("r_roles", F.array(*[F.lit(r) for r in ("rating_metric", "numeric_metric", "currency_metric")]))
    value = (
        when(starts("filter.") & asks("filter", "analytics"), 0.18) + when(starts("clean.") & asks("cleaning", "operation"), 0.18)
        + when(starts("analytics.") & asks("analytics", "filter"), 0.14) + when(starts("transform.") & asks("cleaning", "operation"), 0.14)
        + when(starts("privacy.") & asks("operation"), 0.08) + Shared("roles", 0.28).value()
        + when(F.exists("q_tool_hints", lambda h: F.contains(F.lower("r_tool"), h)), 0.12)
        + when(F.arrays_overlap("r_hints", "q_operation_hints"), 0.12)
        + when(F.col("q_structure").isin("AND", "MIXED") & F.contains("r_id", F.lit("multi")), 0.08)
        + when((F.col("q_structure") == "SEQUENTIAL") & chained, 0.08) + when((F.col("q_predicates") > 1) & starts("filter."), 0.06)
        + when((F.col("q_booleans") > 0) & F.array_contains("r_roles", "boolean_capability"), 0.08)
        + when((F.col("q_comparisons") > 0) & measured, 0.06) + clamped(F.col("r_confidence") - 0.8, 0.1)
    )
    return F.when(value > 0.03, F.round(F.least(value, F.lit(MOST)), 4)).otherwise(0.0)


SKILL = ["id", "roles", "tool", "hints", "description", "confidence"]
SKILL_QUESTION = ["intent", "roles", "tool_hints", "operation_hints", "structure", "predicates", "booleans", "comparisons"]
#: Skills in a catalogue at most.
MOST_SKILLS = 10_000


def retrieve_skills(questions: DataFrame, skills: DataFrame, question_id: str = "question_id", top: int = 5) -> DataFrame:
    """The ``top`` best-scored skills of each question: (question_id, skill_id,
    score, place), ties by id.

    A skill is code, so a catalogue holds MOST_SKILLS at most (more are
    refused); it travels to every task as one list, and questions, each
    different one once, are scored where they lie.
    """
    listed = skills.limit(MOST_SKILLS + 1).count()
    if listed > MOST_SKILLS:
        raise ValueError(f"a catalogue holds at most {MOST_SKILLS} skills")
    in_order = lambda c: F.array_sort(F.array_distinct(c)) if c == "roles" else F.col(c)
    catalogue = skills.agg(F.collect_list(F.struct(*[in_order(c).alias(f"r_{c}") for c in SKILL])).alias("catalogue"))
    asks = questions.select(quoted(question_id).alias("question_id"), *[in_order(c).alias(f"q_{c}") for c in SKILL_QUESTION])
    key = F.sha2(F.to_json(F.struct(*[F.col(f"q_{c}") for c in SKILL_QUESTION]), {"ignoreNullFields": "false"}), 256)
    asks = asks.withColumn("q_key", key)
    distinct = asks.drop("question_id").dropDuplicates(["q_key"]).withColumn("catalogue", catalogue.scalar())
    pairs = distinct.withColumn("skill", F.explode("catalogue")).select("*", "skill.*").withColumn("score", skill_score()).filter("score > 0")
    best = ranked(pairs.select("q_key", F.col("r_id").alias("skill_id"), "score"), [F.desc("score"), F.col("skill_id")], ["q_key"], top)
    return asks.select("question_id", "q_key").join(best, "q_key").select("question_id", "skill_id", "score", "place")
