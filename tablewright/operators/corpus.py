"""Jobs which turn learning events into a gated, deduplicated, split corpus."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.text import SAFE_HEX, SAFE_TIME, hits, literal_patterns, safe_token, safe_tokens
from ..session import durable
from .graph import components
from .ordered import order_names, row_index, running_total, sort_keys
from .querylog import drop_invalidated

# Fixed values.
STRUCTURES = ["SINGLE", "AND", "OR", "MIXED"]
SPLITS = ["train", "validation", "test"]
PLAIN_WORDS = [*STRUCTURES, *SPLITS, "experience", "strategy", "validated", "trusted", "promoted", "bootstrap_skill",
               "deterministic_fallback", "experience_transfer", "validated_template", "teacher_execution", "gemini", "gemini_validated"]
GATES = {
    "success": "execution_failed", "critic_passed": "critic_failed", "result_validation_passed": "result_validation_failed",
    "plan_completeness_passed": "plan_completeness_failed", "privacy_validation_passed": "privacy_failed",
    "no_unresolved_ambiguity": "ambiguity_not_resolved", "no_critical_repair": "critical_repair_present",
}


@dataclass(frozen=True)
class CorpusPolicy:
    minimum_quality: float = 0.95
    readiness_quality: float = 0.96
    minimum_examples: int = 500
    minimum_families: int = 50
    minimum_intents: int = 10
    most_intent_share: float = 0.40
    most_tool_share: float = 0.40
    per_family: int = 1
    per_intent: int | None = None
    per_tools: int | None = None
    train: float = 0.8
    validation: float = 0.1
    allow_repairs: bool = False


# ---- gates -------------------------------------------------------------------


def _first(reasons: list[tuple[Column, str]]) -> Column:
    """First reason whose test holds; null when none does."""
    chain = None
    for test, reason in reasons:
        test = F.coalesce(test, F.lit(False))
        chain = F.when(test, F.lit(reason)) if chain is None else chain.when(test, F.lit(reason))
    return chain


def event_reason(policy: CorpusPolicy = CorpusPolicy()) -> Column:
    """Why a learning event is rejected, or null.  Order matters: the first
    failing gate names the reason; a missing gate value fails."""
    optional = lambda name, test: F.col(name).isNotNull() & ~test
    reasons = [
        (~F.coalesce("logical_structure", F.lit("SINGLE")).isin(STRUCTURES), "invalid_logical_structure"),
        (F.col("score").isNull(), "missing_quality"),
        (optional("event_id", safe_token(F.col("event_id"))) & (F.col("event_id") != ""), "unsafe_event_id"),
        (~safe_token(F.coalesce("intent", F.lit("unknown"))), "unsafe_intent"),
        (~safe_tokens(F.col("semantic_roles")), "unsafe_semantic_role"),
        (~safe_tokens(F.col("operators")), "unsafe_operator"),
        (~safe_tokens(F.col("tool_sequence")), "unsafe_tool_graph"),
        (optional("plan_source", safe_token(F.col("plan_source"))), "unsafe_plan_source"),
        (optional("plan_template_id", safe_token(F.col("plan_template_id"))), "unsafe_plan_template_id"),
        (optional("dataset_semantic_signature", F.col("dataset_semantic_signature").rlike(SAFE_HEX)), "unsafe_dataset_signature"),
    ]
    reasons += [(~F.coalesce(F.col(gate), F.lit(False)), reason) for gate, reason in GATES.items()]
    if not policy.allow_repairs:
        reasons.append((F.coalesce("repair_count", F.lit(0)) > 0, "repaired_example_rejected"))
    reasons.append((F.col("score") < policy.minimum_quality, "quality_below_threshold"))
    return _first(reasons)


def strategy_reason(policy: CorpusPolicy = CorpusPolicy(), lifecycles: Sequence[str] = ("validated", "trusted")) -> Column:
    trusted = F.coalesce("state", F.lit("candidate")).isin("validated", "trusted", "promoted") & F.coalesce(
        "lifecycle_state", F.lit("observed")).isin(list(lifecycles))
    return _first([
        (~trusted, "strategy_lifecycle_not_trusted"),
        (F.coalesce("average_quality", F.lit(0.0)) < policy.minimum_quality, "strategy_quality_below_threshold"),
        (F.coalesce("evidence_count", F.lit(0)) <= 0, "strategy_has_no_evidence"),
        (~safe_token(F.coalesce("intent", F.lit("unknown"))), "unsafe_intent"),
        (~safe_tokens(F.col("semantic_roles")), "unsafe_semantic_role"),
        (~safe_tokens(F.col("tool_sequence")), "unsafe_tool_graph"),
        (F.col("plan_template_id").isNotNull() & ~safe_token(F.col("plan_template_id")), "unsafe_plan_template_id"),
    ])


def unsafe_field(fields: dict[str, T.DataType]) -> Column:
    """Name of the first string field (or array) holding an unsafe text."""

    def safe(value: Column) -> Column:
        return value.isin(PLAIN_WORDS) | safe_token(value) | value.rlike(SAFE_HEX) | value.rlike(SAFE_TIME)

    tests = []
    for name, kind in fields.items():
        cell = quoted(name)
        if isinstance(kind, T.StringType):
            tests.append((cell.isNotNull() & ~safe(cell), f"unsafe_string:record.{name}"))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            tests.append((F.exists(cell, lambda v: v.isNotNull() & ~safe(v)), f"unsafe_string:record.{name}"))
    return _first(tests) if tests else F.lit(None).cast("string")


# ---- families and splits -----------------------------------------------------


def event_family() -> Column:
    """Fingerprint of what an event has in common with its variants: intent,
    roles, operators, structure, tools and the shape of its plan: how long its
    lists are (up to 20) and which kind its action has, not its values, counts
    or key names."""
    plan = F.col("plan_summary")
    length = lambda k: F.least(F.coalesce(F.json_array_length(F.get_json_object(plan, f"$.{k}")), F.lit(0)), F.lit(20))
    keys = F.least(F.size(F.coalesce(F.json_object_keys(plan), F.array().cast("array<string>"))), F.lit(20))
    action = F.when(F.get_json_object(plan, "$.action").isNull(), "null").otherwise("str")
    shape = F.struct(action.alias("action"), length("filters").alias("filters"), keys.alias("keys"), length("tool_sequence").alias("tools"))
    empty = F.array().cast("array<string>")
    record = F.struct(
        F.coalesce("intent", F.lit("unknown")).alias("intent"), F.coalesce("logical_structure", F.lit("SINGLE")).alias("logical_structure"),
        F.coalesce("operators", empty).alias("operators"), shape.alias("plan_shape"), F.coalesce("semantic_roles", empty).alias("semantic_roles"),
        F.lit("experience").alias("source_kind"), F.coalesce("tool_sequence", empty).alias("tool_graph"),
    )
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def strategy_family() -> Column:
    empty = F.array().cast("array<string>")
    record = F.struct(
        F.coalesce("intent", F.lit("unknown")).alias("intent"), F.coalesce("logical_structure", F.lit("SINGLE")).alias("logical_structure"),
        F.col("plan_template_id"), F.coalesce("semantic_roles", empty).alias("semantic_roles"), F.lit("strategy").alias("source_kind"),
        F.coalesce("tool_sequence", empty).alias("tool_graph"),
    )
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def stable_split(family: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    """train/validation/test by the first 12 hex digits of a SHA-256, so that
    a family never moves or divides."""
    share = F.conv(F.substring(F.sha2(family, 256), 1, 12), 16, 10).cast("double") / F.lit(float(0xFFFFFFFFFFFF))
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def best_of_family(records: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` best records per family, with the family's size.

    Sizes come from a counted group joined back and the best are cut in every
    task before the shuffle, so one huge family is never gathered.
    """
    order = [F.desc("quality_score"), F.desc("created_at"), F.desc("source_id")]
    window = Window.partitionBy("family_fingerprint").orderBy(*order)
    kept = records.withColumn("__row", F.row_number().over(window)).filter(F.col("__row") <= k).drop("__row")
    sizes = records.groupBy("family_fingerprint").agg(F.count(F.lit(1)).alias("family_size"))
    return kept.join(sizes, "family_fingerprint")


def _tools_key() -> Column:
    return F.when(F.size("tool_sequence") > 0, F.array_join("tool_sequence", "|")).otherwise("<empty>")


#: Candidates whose counts are taken by plain windows; more are scanned in chunks.
WINDOW_ROWS = 50_000
QUALITY = [("quality_score", True), ("created_at", True), ("source_id", True)]


def capped(records: DataFrame, per_intent: int | None, per_tools: int | None) -> DataFrame:
    """Add ``cap_reason``: null for the records taken, else the cap they meet,
    when records are taken one by one in quality order.

    The sequential rule is reproduced exactly, mostly without a sequence:

    * of one (intent, tools) pair only the first min(caps) records can be
      taken, so the rest is set aside by a limit in each task;
    * of the candidates, one is taken for sure if it fits both caps even
      when every open record before it is taken, and refused for sure if
      those taken before it fill a cap.  Counts of records before a record are
      scans in chunks, so an intent with most of the records is no task of its
      own.  Rounds go on while at least half of the open records are settled
      by each, so there are at most log2(candidates) of them;
    * what is then left hangs together in long chains (each record waits for
      the one before).  It is settled in order by connected group, a task
      holding one number per intent and tools of its group;
    * a refused record met the intent cap if it comes after the record
      which filled that intent, else the tools cap.
    """
    if per_intent is None and per_tools is None:
        return records.withColumn("cap_reason", F.lit(None).cast("string"))
    unlimited = (1 << 31) - 1
    per_intent, per_tools = per_intent or unlimited, per_tools or unlimited
    keyed = records.withColumn("__tools", _tools_key())
    slim = keyed.select("source_id", "intent", "__tools", "quality_score", "created_at")
    pair = Window.partitionBy("intent", "__tools").orderBy(*sort_keys(QUALITY))
    candidates = slim.withColumn("__row", F.row_number().over(pair)).filter(F.col("__row") <= min(per_intent, per_tools)).drop("__row")
    state = _settled(durable(candidates.withColumns({"taken": F.lit(0), "open": F.lit(True)})), per_intent, per_tools)
    # The record after which an intent is full, if it got full.
    place = F.struct("quality_score", "created_at", "source_id")
    filled = state.groupBy("intent").agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__last"))
    joined = keyed.join(state.select("source_id", F.lit(True).alias("__kept")), "source_id", "left").join(filled, "intent", "left")
    after = (F.col("__n") >= per_intent) & (place < F.col("__last"))
    reason = F.when(F.coalesce("__kept", F.lit(False)), F.lit(None).cast("string")).when(after, "intent_cap").otherwise("tool_graph_cap")
    return joined.withColumn("cap_reason", reason).select(*records.columns, "cap_reason")


def _settled(state: DataFrame, per_intent: int, per_tools: int) -> DataFrame:
    """The candidates which are taken."""
    left = state.count()
    small = left <= WINDOW_ROWS
    while left:
        for key, tag in (("intent", "i"), ("__tools", "t")):
            # Records up to here and those taken, two counts in one number.
            counted = running_total(state.withColumn("__both", F.lit(1 << 32) + F.col("taken")), "__both", QUALITY, [key], "__upto", small)
            taken = F.col("__upto").bitwiseAND(F.lit((1 << 32) - 1)) - F.col("taken")
            state = counted.withColumns({f"most_{tag}": F.shiftright("__upto", 32), f"least_{tag}": taken}).drop("__both", "__upto")
        fits = (F.col("most_i") <= per_intent) & (F.col("most_t") <= per_tools)
        full = (F.col("least_i") >= per_intent) | (F.col("least_t") >= per_tools)
        state = state.filter(~(F.col("open") & full)).withColumns({
            "taken": F.when(F.col("open") & fits, 1).otherwise(F.col("taken")), "open": F.col("open") & ~fits,
        }).drop("most_i", "least_i", "most_t", "least_t")
        state = durable(state)
        before, left = left, state.filter("open").count()
        if 2 * left > before:
            return _in_order(state, per_intent, per_tools)
    return state


def _in_order(state: DataFrame, per_intent: int, per_tools: int) -> DataFrame:
    """Settle the open records one after another in each connected group of
    intents and tools.  Records taken already stand in the sequence of their
    intent's and of their tools' group, as what comes after them sees them."""
    sides = {"a": F.concat(F.lit("i"), "intent"), "b": F.concat(F.lit("t"), "__tools")}
    waiting = durable(state.filter("open").withColumns(sides))
    taken = state.filter("taken = 1").withColumns(sides)
    groups = durable(components(waiting, "a", "b"))
    line = ["root", "a", "b", *order_names(QUALITY)]
    lines = waiting.join(groups.withColumnRenamed("node", "a"), "a").select(*line)
    for side, other in (("a", "b"), ("b", "a")):
        here = taken.join(groups.withColumnRenamed("node", side), side)
        lines = lines.unionByName(here.withColumn(other, F.lit(None).cast("string")).select(*line))
    stream = lines.repartition("root").sortWithinPartitions("root", *sort_keys(QUALITY))

    def settle(batches):
        root, counts = None, {}
        for pdf in batches:
            kept = []
            for at, (group, a, b) in enumerate(zip(pdf["root"], pdf["a"], pdf["b"])):
                if group != root:
                    root, counts = group, {}
                i, t = counts.get(a, 0), counts.get(b, 0)
                if isinstance(a, str) and isinstance(b, str):
                    if i >= per_intent or t >= per_tools:
                        continue
                    kept.append(at)
                counts[a], counts[b] = i + 1, t + 1
            yield pdf.iloc[kept][["source_id"]]

    chosen = durable(stream.mapInPandas(settle, T.StructType([state.schema["source_id"]])))
    columns = state.columns
    found = waiting.select(*columns).join(chosen, "source_id", "left_semi").withColumns({"taken": F.lit(1), "open": F.lit(False)})
    return taken.select(*columns).unionByName(found.select(*columns))


# ---- the whole corpus --------------------------------------------------------

RECORD = ["source_kind", "source_id", "intent", "semantic_roles", "operators", "logical_structure", "tool_sequence", "predicate_count",
          "plan_source", "plan_template_id", "quality_score", "family_fingerprint", "created_at", "rejected"]


def event_records(events: DataFrame, policy: CorpusPolicy = CorpusPolicy()) -> DataFrame:
    empty = F.array().cast("array<string>")
    family = event_family()
    filters = F.json_array_length(F.get_json_object("plan_summary", "$.filters"))
    return events.select(
        F.lit("experience").alias("source_kind"), F.coalesce("event_id", F.substring(family, 1, 16)).alias("source_id"),
        F.coalesce("intent", F.lit("unknown")).alias("intent"), F.coalesce("semantic_roles", empty).alias("semantic_roles"),
        F.coalesce("operators", empty).alias("operators"), F.coalesce("logical_structure", F.lit("SINGLE")).alias("logical_structure"),
        F.coalesce("tool_sequence", empty).alias("tool_sequence"), F.coalesce(filters, F.size("operators"), F.lit(0)).alias("predicate_count"),
        F.coalesce("plan_source", F.lit("teacher_execution")).alias("plan_source"), "plan_template_id", F.col("score").alias("quality_score"),
        family.alias("family_fingerprint"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at"),
        event_reason(policy).alias("rejected"),
    )


def strategy_records(strategies: DataFrame, policy: CorpusPolicy = CorpusPolicy()) -> DataFrame:
    empty = F.array().cast("array<string>")
    family = strategy_family()
    return strategies.select(
        F.lit("strategy").alias("source_kind"), F.coalesce("strategy_id", F.substring(family, 1, 16)).alias("source_id"),
        F.coalesce("intent", F.lit("unknown")).alias("intent"), F.coalesce("semantic_roles", empty).alias("semantic_roles"),
        empty.alias("operators"), F.coalesce("logical_structure", F.lit("SINGLE")).alias("logical_structure"),
        F.coalesce("tool_sequence", empty).alias("tool_sequence"), F.lit(0).alias("predicate_count"), F.col("state").alias("plan_source"),
        "plan_template_id", F.col("average_quality").alias("quality_score"), family.alias("family_fingerprint"),
        F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at"), strategy_reason(policy).alias("rejected"),
    )


def build_corpus(records: DataFrame, invalidations: DataFrame | None = None, policy: CorpusPolicy = CorpusPolicy()) -> tuple[DataFrame, DataFrame]:
    """(corpus, rejections) from gated records (``event_records``, together
    with ``strategy_records`` by ``unionByName``).

    Gate → invalidation → safe texts → best per family → split → caps.  The
    corpus is written once, as both the rows and the report read it.
    """
    gated = durable(records)
    passed = gated.filter("rejected is null").drop("rejected")
    rejections = gated.filter("rejected is not null").groupBy(F.col("rejected").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    valid = passed if invalidations is None else drop_invalidated(passed, invalidations)
    texts = {n: k for n, k in ((f.name, f.dataType) for f in valid.schema) if n not in ("created_at", "source_id")}
    checked = durable(valid.withColumn("unsafe", unsafe_field(texts)))
    safe = checked.filter("unsafe is null").drop("unsafe")
    best = best_of_family(safe, policy.per_family)
    best = best.withColumn("split", stable_split(F.col("family_fingerprint"), policy.train, policy.validation))
    marked = durable(capped(best, policy.per_intent, policy.per_tools))
    counts = lambda rows, reason: rows.agg(F.lit(reason).alias("reason"), F.count(F.lit(1)).alias("n"))
    minus = lambda a, b, reason: counts(a, reason).join(
        F.broadcast(counts(b, reason).withColumnRenamed("n", "m")), "reason").select("reason", (F.col("n") - F.col("m")).alias("n"))
    rejections = (
        rejections.unionByName(minus(passed, checked, "invalidated"))
        .unionByName(checked.filter("unsafe is not null").groupBy(F.col("unsafe").alias("reason")).agg(F.count(F.lit(1)).alias("n")))
        .unionByName(minus(safe, marked, "duplicate_family"))
        .unionByName(marked.filter("cap_reason is not null").groupBy(F.col("cap_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n")))
        .filter("n > 0")
    )
    return marked.filter("cap_reason is null").drop("cap_reason"), rejections


def export_order(corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """The corpus as it is handed over: by split, best first, then by source;
    the first ``limit`` records if one is given."""
    ordered = corpus.orderBy("split", F.desc("quality_score"), "source_id")
    return ordered if limit is None else ordered.limit(limit)


def learning_status(events: DataFrame, strategies: DataFrame | None = None, policy: CorpusPolicy = CorpusPolicy()) -> tuple[DataFrame, DataFrame]:
    """State of the learning log: one row (experience_count,
    eligible_experience_count, rejected_experience_count,
    candidate_strategy_count, trusted_strategy_count, last_plan_source,
    privacy_gate_passed), and the rejections by reason.

    Eligible are the records a corpus of all events and strategies would hold.
    """
    gated = event_records(events, policy)
    if strategies is not None:
        gated = gated.unionByName(strategy_records(strategies, policy))
    corpus, rejections = build_corpus(gated, policy=policy)
    rejections = durable(rejections)
    latest = F.max_by("plan_source", F.struct("created_at", "event_id"))
    seen = events.agg(F.count(F.lit(1)).alias("experience_count"), latest.alias("last_plan_source"))
    kept = corpus.agg(F.count(F.lit(1)).alias("eligible_experience_count"))
    private = F.count_if(F.startswith("reason", F.lit("unsafe")) | F.contains("reason", F.lit("privacy")))
    lost = rejections.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rejected_experience_count"), (private == 0).alias("__private"))
    if strategies is None:
        listed = events.sparkSession.range(1).select(F.lit(0).cast("long").alias("candidate_strategy_count"), F.lit(0).cast("long").alias("trusted_strategy_count"))
    else:
        listed = strategies.agg(F.count(F.lit(1)).alias("candidate_strategy_count"), F.count_if(F.col("state") == "trusted").alias("trusted_strategy_count"))
    row = seen.withColumn("k", F.lit(1))
    for part in (kept, lost, listed):  # one row each
        row = row.join(F.broadcast(part.withColumn("k", F.lit(1))), "k")
    passed = F.col("__private") & (F.col("eligible_experience_count") > 0)
    return row.select("experience_count", "eligible_experience_count", "rejected_experience_count", "candidate_strategy_count", "trusted_strategy_count",
                      "last_plan_source", passed.alias("privacy_gate_passed")), rejections


def corpus_distributions(corpus: DataFrame) -> DataFrame:
    """(dimension, key, n) for intent, tools, steps, predicates, source and
    split.  One pass: each row gives one cell per dimension, counted with
    map-side combine."""
    cells = {
        "intent": F.col("intent"), "tool_graph": _tools_key(), "steps": F.size("tool_sequence").cast("string"),
        "predicates": F.col("predicate_count").cast("string"), "plan_source": F.coalesce("plan_source", "source_kind"), "split": F.col("split"),
    }
    listed = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("key")) for d, c in cells.items()])
    return corpus.select(F.inline(listed)).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """One row: sizes, largest shares, steps, mean quality, split counts."""
    shares = durable(corpus_distributions(corpus))
    total = lambda d: F.when(F.col("dimension") == d, F.col("n"))
    steps = F.col("key").try_cast("long")
    spread = shares.agg(
        F.coalesce(F.sum(total("split")), F.lit(0)).alias("eligible_examples"), F.count(total("intent")).alias("intent_count"),
        F.count(total("tool_graph")).alias("tool_graph_count"), F.max(total("intent")).alias("__mi"), F.max(total("tool_graph")).alias("__mt"),
        F.sum(total("steps") * steps).alias("__steps"), F.sum(F.when(F.col("key") == "1", total("steps"))).alias("__single"),
        *[F.coalesce(F.sum(F.when(F.col("key") == s, total("split"))), F.lit(0)).alias(f"{s}_count") for s in SPLITS],
    )
    families = corpus.groupBy("family_fingerprint").agg(F.sum("quality_score").alias("q"), F.count(F.lit(1)).alias("c"))
    quality = families.agg(F.count(F.lit(1)).alias("family_count"), F.try_divide(F.sum("q"), F.sum("c")).alias("__q"))
    n = F.col("eligible_examples")
    share = lambda c, digits: F.coalesce(F.round(F.try_divide(F.col(c), n), digits), F.lit(0.0))
    single = F.coalesce(F.round(F.try_divide(F.coalesce("__single", F.lit(0)) * 100.0, n), 2), F.lit(0.0))
    joined = spread.withColumn("k", F.lit(1)).join(F.broadcast(quality.withColumn("k", F.lit(1))), "k")
    return joined.select(
        "eligible_examples", "family_count", "intent_count", "tool_graph_count", share("__mi", 4).alias("largest_intent_share"),
        share("__mt", 4).alias("largest_tool_graph_share"), share("__steps", 4).alias("average_tool_steps"), single.alias("single_step_pct"),
        F.when(n > 0, F.round(100.0 - single, 2)).otherwise(0.0).alias("multi_step_pct"),
        F.round(F.coalesce("__q", F.lit(0.0)), 4).alias("average_quality"), *[f"{s}_count" for s in SPLITS],
    )


def readiness(summary: DataFrame, policy: CorpusPolicy = CorpusPolicy()) -> DataFrame:
    """Verdict, weighted score and reasons over the summary row."""
    n, families, intents = F.col("eligible_examples"), F.col("family_count"), F.col("intent_count")
    quality, top_intent, top_tools = F.col("average_quality"), F.col("largest_intent_share"), F.col("largest_tool_graph_share")
    whole = F.col("train_count") + F.col("validation_count") + F.col("test_count") == n
    reached = lambda value, goal: F.least(F.lit(1.0), value / F.lit(float(goal)))
    spread = lambda share, most: F.greatest(F.lit(0.0), 1.0 - share / F.lit(most))
    score = (
        0.30 * reached(n, policy.minimum_examples) + 0.20 * reached(families, policy.minimum_families)
        + 0.15 * reached(intents, policy.minimum_intents) + 0.20 * reached(quality, policy.readiness_quality)
        + 0.075 * spread(top_intent, policy.most_intent_share) + 0.075 * spread(top_tools, policy.most_tool_share)
    )
    reasons = F.array_compact(F.array(
        F.when(n < policy.minimum_examples, "eligible_examples_below_threshold"),
        F.when(families < policy.minimum_families, "family_count_below_threshold"),
        F.when(intents < policy.minimum_intents, "intent_count_below_threshold"),
        F.when(quality < policy.readiness_quality, "quality_below_readiness_threshold"),
        F.when(top_intent > policy.most_intent_share, F.format_string("largest_intent_share=%.3f", top_intent)),
        F.when(top_tools > policy.most_tool_share, F.format_string("largest_tool_graph_share=%.3f", top_tools)),
        F.when(n <= 0, "no_eligible_examples"), F.when(~whole, "split_integrity_failed"),
    ))
    ready = (F.size(reasons) == 0) & (quality >= policy.minimum_quality)
    return summary.select(
        "*", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("readiness_score"), ready.alias("ready"),
        F.array_join(reasons, ",").alias("reasons"),
    )


def semantic_readiness(targets: DataFrame) -> DataFrame:
    """Diversity, role coverage, ambiguity and quality of semantic targets
    (intent, logical_structure, semantic_roles, ambiguous, quality)."""
    roles = targets.select(F.explode("semantic_roles").alias("r")).agg(F.countDistinct("r")).first()[0]
    counts = targets.groupBy("intent", "logical_structure").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ambiguous").alias("a"), F.sum("quality").alias("q")
    )
    one = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.size(F.collect_set("intent")).alias("intent_diversity"),
        F.size(F.collect_set("logical_structure")).alias("predicate_diversity"),
        F.when(F.sum("n") > 0, F.lit(min(1.0, roles / 8.0))).otherwise(0.0).alias("role_coverage"),
        F.coalesce(F.try_divide(F.sum("a"), F.sum("n")), F.lit(0.0)).alias("ambiguity_rate"),
        F.coalesce(F.try_divide(F.sum("q"), F.sum("n")), F.lit(0.0)).alias("average_quality"),
    )
    ready = (
        (F.col("row_count") > 0) & (F.col("role_coverage") >= 0.5) & (F.col("ambiguity_rate") <= 0.1) & (F.col("average_quality") >= 0.95)
    )
    notes = F.array_compact(F.array(
        F.when(F.col("row_count") <= 0, "no_rows"), F.when(F.col("intent_diversity") < 3, "low_intent_diversity"),
        F.when(F.col("predicate_diversity") < 2, "low_predicate_diversity"), F.when(F.col("ambiguity_rate") > 0.1, "ambiguity_rate_high"),
    ))
    rounded = [F.round(c, 4).alias(c) for c in ("role_coverage", "ambiguity_rate", "average_quality")]
    return one.select("row_count", "intent_diversity", "predicate_diversity", *rounded, ready.alias("ready"), F.array_join(notes, ",").alias("notes"))


# ---- strategies and skills ---------------------------------------------------


def discover_strategies(events: DataFrame, support: int = 2) -> DataFrame:
    """Successful events grouped by intent, structure and tools, ranked by
    support.  Roles are united from distinct (group, role) pairs, whose number
    the role vocabulary bounds."""
    keys = ["intent", "logical_structure", "tool_sequence"]
    good = events.filter("success")
    groups = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evidence_count"), F.round(F.avg("score"), 4).alias("average_quality"), F.max("created_at").alias("last_seen_at")
    ).filter(F.col("evidence_count") >= support)
    roles = good.select(*keys, F.explode("semantic_roles").alias("role")).distinct()
    united = roles.groupBy(*keys).agg(F.array_sort(F.collect_set("role")).alias("semantic_roles"))
    named = F.sha2(F.to_json(F.struct("intent", "logical_structure", "tool_sequence")), 256)
    life = F.when(F.col("evidence_count") < 2, "observed").when(F.col("evidence_count") < 7, "validated").otherwise("trusted")
    return groups.join(united, keys, "left").select(
        F.concat(F.lit("strategy."), F.substring(named, 1, 12)).alias("strategy_id"), *keys,
        F.coalesce("semantic_roles", F.array().cast("array<string>")).alias("semantic_roles"), "evidence_count", "average_quality",
        life.alias("lifecycle_state"), "last_seen_at",
    ).orderBy(F.desc("evidence_count"), *keys)


RANKS = {"demoted": -1, "bootstrap": 0, "observed": 0, "candidate": 1, "validated": 2, "promoted": 2, "trusted": 3}


def lifecycle_rank(label: Column) -> Column:
    pairs = [F.lit(p) for item in RANKS.items() for p in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(label, F.lit("bootstrap"))), F.lit(0))


def lifecycle(successes: Column, failures: Column, quality: Column) -> Column:
    return (
        F.when((failures >= 3) & (failures > successes), "demoted").when((successes >= 7) & (quality >= 0.90), "trusted")
        .when((successes >= 4) & (quality >= 0.85), "validated").when(successes >= 2, "candidate").otherwise("bootstrap")
    )


def strategy_status(strategies: DataFrame, states: DataFrame) -> DataFrame:
    """Strategies with the state of their learned skill, what the next stage
    needs and what blocks it."""
    skills = states.select(F.col("skill_id").alias("learned_skill_id"), "success_count", "failure_count", "average_quality_score",
                           F.col("state").alias("registry_lifecycle"))
    learned = F.regexp_replace("strategy_id", r"^strategy\.", "learned.")
    joined = strategies.withColumn("learned_skill_id", learned).join(skills, "learned_skill_id", "left")
    own = F.coalesce("lifecycle_state", "state", F.lit("observed"))
    known = F.col("registry_lifecycle").isNotNull()
    label = F.when(known & (lifecycle_rank(F.col("registry_lifecycle")) > lifecycle_rank(own)), F.col("registry_lifecycle")).otherwise(own)
    evidence = F.greatest(F.coalesce("evidence_count", F.lit(0)), F.coalesce(F.col("success_count") + F.col("failure_count"), F.lit(0)))
    success = F.coalesce("success_count", "evidence_count", F.lit(0))
    failure = F.coalesce("failure_count", F.lit(0))
    quality = F.coalesce(F.nullif("average_quality_score", F.lit(0.0)), "average_quality", F.lit(0.0))
    joined = joined.select(
        "strategy_id", "learned_skill_id", "intent", label.alias("lifecycle"), "registry_lifecycle", evidence.alias("evidence_count"),
        success.alias("success_count"), failure.alias("failure_count"), F.round(quality, 4).alias("average_quality"),
    )
    stage = F.when(F.col("lifecycle").isin("bootstrap", "observed"), "candidate").when(
        F.col("lifecycle").isin("candidate", "promoted"), "validated").when(F.col("lifecycle") == "validated", "trusted").when(
        ~F.col("lifecycle").isin("demoted", "trusted"), "candidate")
    joined = joined.withColumn("next_stage", stage)
    need = F.when(F.col("next_stage") == "candidate", 2).when(F.col("next_stage") == "validated", 4).when(F.col("next_stage") == "trusted", 7)
    goal = F.when(F.col("next_stage") == "validated", 0.85).when(F.col("next_stage") == "trusted", 0.90)
    joined = joined.withColumns({"required_evidence": need, "required_quality": goal})
    short = F.col("required_evidence") - F.col("evidence_count")
    blockers = F.array_compact(F.array(
        F.when(F.col("lifecycle") == "demoted", "demoted"),
        F.when((F.col("failure_count") >= 3) & (F.col("failure_count") > F.col("success_count")), "failure_tolerance_exceeded"),
        F.when(short > 0, F.concat(F.lit("need_"), short.cast("string"), F.lit("_more_evidence"))),
        F.when(F.col("average_quality") < F.col("required_quality"), F.format_string("quality_below_%.2f", F.col("required_quality"))),
    ))
    return joined.withColumn("promotion_blockers", blockers)


def status_rollup(status: DataFrame) -> DataFrame:
    return status.groupBy("lifecycle").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("evidence_count"), 4).alias("average_evidence"), F.round(F.avg("average_quality"), 4).alias("average_quality")
    )


STEP = 10_000  # confidence and quality are kept in ten-thousandths
LOW, HIGH = 500, 9_900
#: Steps folded by one row; more are folded level by level.
FOLD_ROWS = 4_096
#: Runs after which the rounded mean cannot move: |score - mean| / runs < 1/2.
MEAN_RUNS = 2 * STEP


def folded_confidence(steps: DataFrame, start: float) -> DataFrame:
    """(skill_id, confidence) after the steps (skill_id, place from 0, step).

    A step adds and clamps to [LOW, HIGH].  A chain of such steps is again
    "add, clamp to [low, high]", so FOLD_ROWS consecutive ones become one, and
    those again, until a skill has one left.
    """
    clamp = lambda x, c: F.least(c["high"], F.greatest(c["low"], x + c["add"]))
    first = F.struct(F.lit(0).cast("long").alias("add"), F.lit(-(1 << 40)).alias("low"), F.lit(1 << 40).alias("high"))

    def then(state, c):
        return F.struct((state["add"] + c["add"]).alias("add"), clamp(state["low"], c).alias("low"), clamp(state["high"], c).alias("high"))

    chain = steps.select("skill_id", "place", F.col("step").alias("add"), F.lit(LOW).cast("long").alias("low"), F.lit(HIGH).cast("long").alias("high"))
    longest = steps.agg(F.max("place")).first()[0] or 0
    while True:
        listed = chain.groupBy("skill_id", F.floor(F.col("place") / FOLD_ROWS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "add", "low", "high"))).alias("c"))
        chain = listed.select("skill_id", F.col("block").alias("place"), F.aggregate("c", first, then).alias("s")).select("skill_id", "place", "s.*")
        longest //= FOLD_ROWS
        if not longest:
            break
    begin = F.lit(int(round(start * STEP))).cast("long")
    return chain.select("skill_id", (clamp(begin, {n: F.col(n) for n in ("add", "low", "high")}) / F.lit(float(STEP))).alias("confidence"))


def running_quality(scores: DataFrame) -> DataFrame:
    """(skill_id, average_quality_score): the mean, rounded to four decimals
    after each run but the first, of (skill_id, place from 0, observed).

    The n-th run moves the mean by (score - mean) / n, which is less than half
    of the last decimal once n exceeds MEAN_RUNS: the first MEAN_RUNS + 1 runs
    of a skill give the result of all its runs.
    """
    first = scores.filter(F.col("place") <= MEAN_RUNS).groupBy("skill_id").agg(F.sort_array(F.collect_list(F.struct("place", "observed"))).alias("c"))

    def then(mean, c):
        n = c["place"] + 1
        moved = F.floor((mean * c["place"] + c["observed"] * STEP) / n + 0.5)
        return F.when(c["place"] == 0, c["observed"] * STEP).otherwise(moved.cast("double"))

    return first.select("skill_id", (F.aggregate("c", F.lit(0.0), then) / STEP).alias("average_quality_score"))


def skill_states(runs: DataFrame, start: float = 0.5) -> DataFrame:
    """Confidence, counts and mean quality per skill after all its runs
    (skill_id, at, run_id, success, score), in time order.

    Confidence moves by +.04/−.06 and (score−.5)·.08 per run, clamped to
    .05–.99 and kept to four decimals; the mean quality is rounded after each
    run.  Runs are numbered by ranges, so a skill with most of the runs is
    shared by many tasks.
    """
    delta = F.when(F.col("success"), 0.04).otherwise(-0.06) + F.coalesce((F.col("score") - 0.5) * 0.08, F.lit(0.0))
    seen = F.when(F.col("score") > 0, F.col("score")).when(F.col("success"), 1.0).otherwise(0.0)
    slim = runs.select("skill_id", "at", "run_id", F.rint(delta * STEP).cast("long").alias("step"), seen.cast("double").alias("observed"))
    placed = durable(row_index(slim, ["at", "run_id"], ["skill_id"], "place").select("skill_id", (F.col("place") - 1).alias("place"), "step", "observed"))
    counts = runs.groupBy("skill_id").agg(
        F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"), F.max("at").alias("last_seen_at"))
    joined = counts.join(running_quality(placed), "skill_id").join(folded_confidence(placed, start), "skill_id")
    joined = joined.select("skill_id", "success_count", "failure_count", "average_quality_score", "last_seen_at", "confidence")
    return joined.withColumn("state", lifecycle(F.col("success_count"), F.col("failure_count"), F.col("average_quality_score")))


def plan_templates(events: DataFrame) -> DataFrame:
    """Structural template of each event's plan, with its support.

    Events carry intent, logical_structure, semantic_roles, tool_sequence,
    score, plan (JSON text) and column_roles (map of column to role).
    """
    plan = F.from_json("plan", "filters array<struct<column string, operator string, value string>>, derived_columns array<string>, "
                       "group_by array<string>, metrics array<string>, `window` string, keep_top_n_per_partition string, order_by array<string>")  # fmt: skip
    rows = events.filter("plan is not null and plan <> '{}'").withColumn("p", plan)
    some = lambda c: F.coalesce(F.size(F.col(f"p.{c}")) > 0, F.lit(False))
    top = F.col("p.window").isNotNull() | F.col("p.keep_top_n_per_partition").isNotNull()
    flow = some("derived_columns") | some("group_by") | some("metrics") | top
    empty = F.array().cast("array<string>")
    used = F.concat(F.coalesce(F.transform("p.filters", lambda f: f["column"]), empty), F.coalesce("p.group_by", empty))
    roles = F.filter(F.transform(used, lambda c: F.coalesce(F.try_element_at("column_roles", c), F.lit("unknown"))), lambda r: r != "unknown")
    roles = F.when(F.size(roles) > 0, roles).otherwise(F.coalesce("semantic_roles", empty))
    kinds = F.transform("p.filters", lambda f: F.concat_ws(
        ":", F.coalesce(f["operator"], F.lit("equals")), F.when(f["value"].try_cast("double").isNotNull(), "number").otherwise("text")))
    structure = F.concat(F.coalesce(kinds, empty), F.coalesce(F.transform("p.derived_columns", lambda d: F.lit("derived:derived_label")), empty))
    workflow = F.array_compact(F.array(
        F.lit("resolve_semantic_targets"), F.when(some("filters"), "filter_rows"), F.when(some("derived_columns"), "derive_columns"),
        F.when(some("group_by") | some("metrics"), "group_and_aggregate"), F.when(top, "rank_and_top_n"), F.when(some("order_by"), "sort_results"),
        F.lit("validate_result"),
    ))
    simple = F.array(F.lit("resolve_semantic_targets"), F.lit("filter_rows"), F.lit("validate_filter_result"))
    tools = F.when(F.size("tool_sequence") > 0, F.col("tool_sequence")).when(flow, workflow).otherwise(simple)
    shaped = rows.select(
        "intent", F.when(flow, "workflow").otherwise("filter").alias("plan_kind"), roles.alias("required_roles"),
        structure.alias("predicate_structure"), "logical_structure", tools.alias("tool_sequence"), "score",
    )
    parts = ["intent", "plan_kind", "required_roles", "predicate_structure", "logical_structure", "tool_sequence"]
    grouped = shaped.groupBy(*parts).agg(F.count(F.lit(1)).alias("support_count"), F.round(F.avg("score"), 4).alias("average_quality"))
    signature = F.substring(F.sha2(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}), 256), 1, 16)
    return grouped.select(F.concat(F.lit("template."), signature, F.lit(".v1")).alias("template_id"), *parts, "support_count", "average_quality")


# ---- checks of a written corpus ----------------------------------------------

# Fixed values.
FORBIDDEN_LITERALS = ["John Smith", "john@example.com", "ACC-9988", "SecretCompanyXYZ", "9876543210", "query_text", "normalized_query",
                      "workbook", "sheet_name", "filename", "customer name"]
UNSAFE_MARKERS = ["query_text", "normalized_query", "workbook", "sheet_name", "filename", "customer name", "email", "phone", "address",
                  "account", "sql"]
TARGET_INTENTS = ["filter", "sort", "aggregate", "rank", "pivot", "normalize", "categorize", "clean", "cleaning", "summarize", "summary",
                  "detect_missing", "detect_duplicates", "detect_outliers", "compare", "trend", "correlate", "segment", "analyze", "analytics",
                  "operation", "sentiment", "benchmark", "churn_watch", "distribution", "escalation", "hospitality", "quality_audit",
                  "retention", "risk_review", "staffing"]
TARGET_KEYS = ["intent", "semantic_bindings", "predicate_graph", "aggregation", "ranking", "limit", "requires_fallback", "confidence"]
TARGET_STRUCTURES = [*STRUCTURES, "NOT"]
TARGET_OPERATORS = ["AND", "OR", "NOT", "SINGLE", "MIXED"]


def leak_counts(rows: DataFrame, text: str, by: str, forbidden: Sequence[str] = tuple(FORBIDDEN_LITERALS)) -> DataFrame:
    """Rows per split whose text holds a forbidden literal, ignoring case."""
    hit = quoted(text).rlike(literal_patterns(forbidden))
    return rows.groupBy(quoted(by)).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("leaks"))


def check_corpus(rows: DataFrame, expected: dict[str, int], text: str = "line", by: str = "split") -> DataFrame:
    """Blockers of a written corpus: (split, expected, found, leaks, blocker)
    for each split whose count or content is wrong."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(s, int(expected.get(s, 0))) for s in SPLITS], "split string, expected long")
    found = leak_counts(rows, text, by).withColumnRenamed(by, "split") if by != "split" else leak_counts(rows, text, by)
    joined = wanted.join(found, "split", "left").na.fill(0, ["n", "leaks"])
    blocker = F.when(F.col("leaks") > 0, F.concat(F.lit("privacy_violation:"), F.col("split"))).when(F.col("n") != F.col("expected"), "split_count_mismatch")
    return joined.select("split", "expected", F.col("n").alias("found"), "leaks", blocker.alias("blocker"))


def corpus_blockers(
    rows: DataFrame, manifest: dict, report: dict, problems: DataFrame | None = None, text: str = "line", by: str = "split",
    forbidden: Sequence[str] = tuple(FORBIDDEN_LITERALS),
) -> DataFrame:
    """Why a written corpus must not be used: one row (blocker) per reason.

    ``rows`` are its lines with their split; ``manifest`` and ``report`` what
    was written beside it; ``problems`` what ``verify_manifest`` found of its
    checksums.  Without either of the two nothing else is looked at.
    """
    spark = rows.sparkSession
    missing = [name for name, written in (("manifest", manifest), ("report", report)) if not written]
    if missing:
        return spark.createDataFrame([(f"missing_files:{','.join(missing)}",)], "blocker string")
    readiness = manifest.get("readiness") or report.get("readiness") or {}
    told = [
        (not readiness.get("ready_for_prototype"), str(readiness.get("reason") or "not_ready")),
        (manifest.get("eligible_examples") != report.get("eligible_examples"), "manifest_report_mismatch"),
        (report.get("split_integrity_passed") is False, "split_integrity_failed"),
    ]
    known = spark.createDataFrame([(name,) for test, name in told if test], "blocker string")
    wanted = spark.createDataFrame([(s, manifest.get(f"{s}_count")) for s in SPLITS], "split string, expected long")
    found = leak_counts(rows, text, by, forbidden).withColumnRenamed(by, "split")
    joined = durable(wanted.join(found, "split", "left").na.fill(0, ["n", "leaks"]))
    leaking = joined.filter("leaks > 0").select(F.concat(F.lit("privacy_violation:"), "split").alias("blocker"))
    other = joined.agg(F.count_if(~F.col("n").eqNullSafe(F.col("expected"))).alias("k")).filter("k > 0").select(F.lit("split_count_mismatch").alias("blocker"))
    result = known.unionByName(leaking).unionByName(other)
    if problems is not None:
        changed = problems.filter("problem <> 'unexpected'").agg(F.count(F.lit(1)).alias("k")).filter("k > 0")
        result = result.unionByName(changed.select(F.lit("sha_manifest_mismatch").alias("blocker")))
    return result


def target_reason(output: Column) -> Column:
    """Why the JSON text of a semantic target is not of the agreed shape, or
    null.  Types are read from the parsed variant, not guessed from text."""
    doc = F.try_parse_json(output)
    at = lambda path: F.try_variant_get(doc, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(at(path)), F.lit("ABSENT"))
    is_kind = lambda path, *kinds: reduce(lambda a, b: a | b, [F.startswith(kind(path), F.lit(k)) for k in kinds])
    text = lambda path: F.try_variant_get(doc, path, "string")
    numbers = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    keys = F.array_sort(F.coalesce(F.json_object_keys(output), F.array().cast("array<string>")))
    confidence = F.try_variant_get(doc, "$.confidence", "double")
    limit = F.try_variant_get(doc, "$.limit", "long")
    ops = F.try_variant_get(doc, "$.predicate_graph.operators", "array<string>")
    bad_flag = lambda path: ~is_kind(path, "BOOLEAN", "ABSENT")
    return _first([
        (doc.isNull() | ~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), "target_not_object"),
        (keys != F.array(*[F.lit(k) for k in sorted(TARGET_KEYS)]), "invalid_output_schema"),
        (~is_kind("$.intent", "STRING"), "invalid_intent_type"), (~text("$.intent").isin(TARGET_INTENTS), "unsupported_intent"),
        (~is_kind("$.semantic_bindings", "OBJECT"), "invalid_semantic_bindings"), (~is_kind("$.predicate_graph", "OBJECT"), "invalid_predicate_ast"),
        (~F.coalesce(F.nullif(text("$.predicate_graph.logical_structure"), F.lit("")), F.lit("SINGLE")).isin(TARGET_STRUCTURES), "invalid_logical_structure"),
        (~is_kind("$.predicate_graph.operators", "ARRAY", "ABSENT"), "invalid_predicate_operator"),
        (F.exists(ops, lambda o: ~F.upper(o).isin(TARGET_OPERATORS)), "invalid_predicate_operator"),
        (~(is_kind("$.aggregation", "OBJECT") & is_kind("$.ranking", "OBJECT")), "invalid_aggregation_ranking"),
        (~is_kind("$.limit", "BIGINT", "VOID") | (limit < 0), "invalid_limit"),
        (~is_kind("$.requires_fallback", "BOOLEAN"), "invalid_requires_fallback"),
        (~is_kind("$.confidence", *numbers) | ~confidence.between(0, 1), "invalid_confidence"),
        (bad_flag("$.aggregation.required"), "invalid_aggregation_structure"), (bad_flag("$.ranking.required"), "invalid_ranking_structure"),
        (~is_kind("$.ranking.direction", "ABSENT") & ~F.coalesce(text("$.ranking.direction"), F.lit("")).isin("asc", "desc"), "invalid_ranking_structure"),
    ])


def audit_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Each corpus line with the stages it passes: readable → eligible →
    privacy-valid → converted → valid, and the first reason it stops."""
    part = lambda k: F.get_json_object(quoted(line), f"$.{k}")
    is_object = lambda c: F.coalesce(F.startswith(F.ltrim(c), F.lit("{")), F.lit(False))
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    rows = lines.withColumns({"input": part("input"), "output": part("output"), "metadata": part("metadata")})
    readable = is_object(F.col("input")) & is_object(F.col("output")) & is_object(F.col("metadata"))
    gates = ["execution_success", *[g for g in GATES if g != "success"]]
    passed = reduce(lambda a, b: a & b, [F.coalesce(meta(g) == "true", F.lit(False)) for g in gates])
    repaired = F.lower(F.coalesce(meta("correction_state"), F.lit("none"))).isin("corrected", "critical_repair", "repaired")
    eligible = (
        readable & (F.coalesce(meta("quality").try_cast("double"), F.lit(0.0)) >= 0.95) & passed
        & (F.coalesce(meta("repair_count").try_cast("long"), F.lit(0)) == 0) & ~repaired
    )
    clean = hits(F.lower(F.concat_ws(" ", "input", "output", "metadata")), UNSAFE_MARKERS) == 0
    known = F.coalesce(F.get_json_object("input", "$.intent"), F.lit("")).isin(TARGET_INTENTS)
    rows = rows.withColumns({"readable": readable, "eligible": eligible})
    rows = rows.withColumn("privacy_valid", F.col("eligible") & clean)
    rows = rows.withColumn("converted", F.col("privacy_valid") & known)
    rows = rows.withColumn("valid", F.col("converted") & target_reason(F.col("output")).isNull())
    reason = (
        F.when(F.col("valid"), F.lit(None).cast("string")).when(~F.col("readable"), "OTHER_SAFE_REASON").when(~F.col("eligible"), "INELIGIBLE_EVENT")
        .when(~F.col("privacy_valid"), "PRIVACY_GATE_FAILED").when(~F.col("converted"), "UNSUPPORTED_INTENT").otherwise("INVALID_TARGET_SCHEMA")
    )
    return rows.withColumn("reason", reason).drop("input", "output", "metadata")


def audit_funnel(audited: DataFrame, by: str = "split") -> DataFrame:
    stages = ["readable", "eligible", "privacy_valid", "converted", "valid"]
    return audited.groupBy(quoted(by)).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s).alias(s) for s in stages])


# ---- evaluation --------------------------------------------------------------

FIELDS = ["intent", "semantic_bindings", "predicate_graph", "logical_structure", "aggregation", "ranking", "requires_fallback"]


def field_accuracy(predicted: DataFrame, expected: DataFrame, key: str = "item_id", fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """Share of expected items whose field is equal in the prediction; an
    absent or invalid prediction counts against every field."""
    right = predicted.select(quoted(key), *[quoted(f).alias(f"p_{f}") for f in fields], F.col("valid"))
    joined = expected.join(right, key, "left")
    good = F.coalesce("valid", F.lit(False))
    hit = lambda f: F.avg((good & quoted(f).eqNullSafe(F.col(f"p_{f}"))).cast("double")).alias(f"{f}_accuracy")
    return joined.agg(F.count(F.lit(1)).alias("items"), F.avg(good.cast("double")).alias("valid_rate"), *[hit(f) for f in fields])


def plan_metrics(predicted: DataFrame, expected: DataFrame, key: str = "item_id") -> DataFrame:
    """Exact matches, coverage of predicates and roles, tool F1 and the rate of
    invalid tools, over items with both sides.  Columns: predicate_keys,
    semantic_roles, tool_graph, logical_structure, plan_valid."""
    sides = [c for c in expected.columns if c != key]
    joined = expected.join(predicted.withColumnsRenamed({c: f"p_{c}" for c in predicted.columns if c != key}), key)
    same = reduce(lambda a, b: a & b, [quoted(c).eqNullSafe(F.col(f"p_{c}")) for c in sides if f"p_{c}" in joined.columns])
    covered = lambda c: F.coalesce(F.try_divide(F.size(F.array_intersect(c, f"p_{c}")), F.size(F.array_distinct(c))), F.lit(0.0))
    tools = lambda test: F.sum(F.size(F.filter("p_tool_graph", test)))
    sums = joined.agg(
        F.count(F.lit(1)).alias("items"), F.avg(same.cast("double")).alias("exact_match"), F.avg(F.col("p_plan_valid").cast("double")).alias("plan_validity"),
        F.avg(covered("predicate_keys")).alias("predicate_coverage"), F.avg(covered("semantic_roles")).alias("role_coverage"),
        F.avg((F.col("logical_structure").eqNullSafe(F.col("p_logical_structure"))).cast("double")).alias("structure_accuracy"),
        F.sum(F.size("p_tool_graph")).alias("__p"), F.sum(F.size("tool_graph")).alias("__e"),
        tools(lambda t: F.array_contains(F.col("tool_graph"), t)).alias("__h"), tools(lambda t: F.startswith(t, F.lit("invalid."))).alias("__bad"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.least(a, b), b), F.lit(0.0))
    precision, recall = ratio(F.col("__h"), F.col("__p")), ratio(F.col("__h"), F.col("__e"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("items", "exact_match", "plan_validity", "predicate_coverage", "role_coverage", "structure_accuracy",
                       f1.alias("tool_f1"), ratio(F.col("__bad"), F.col("__p")).alias("invalid_tool_rate"))
