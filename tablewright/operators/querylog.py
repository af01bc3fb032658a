"""Batch jobs over the log of past queries: scopes, reuse, export, figures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import durable
from .matching import ranked, similar_questions
from .retrieval import retrieve, retrieve_skills, skill_score  # noqa: F401


def scoped_log(
    log: DataFrame, datasets: DataFrame, organization: str | None = None, dataset: str | None = None, schema_hash: str | None = None,
    success: bool | None = None, limit: int | None = None,
) -> DataFrame:
    """Log rows of a scope, newest first.  An organisation matches by the
    row's own or by its dataset's."""
    rows = log
    if dataset is not None:
        rows = rows.filter(F.col("dataset_id") == dataset)
    if schema_hash is not None:
        rows = rows.filter(F.col("schema_hash") == schema_hash)
    if success is not None:
        rows = rows.filter(F.col("success") == success)
    if organization is not None:
        owners = datasets.filter(F.col("organization_id") == organization).select(F.col("dataset_id").alias("__d")).distinct()
        rows = rows.join(owners, F.col("dataset_id") == F.col("__d"), "left")
        rows = rows.filter((F.col("organization_id") == organization) | F.col("__d").isNotNull()).drop("__d")
    rows = rows.orderBy(F.desc("created_at"), F.desc("id"))
    return rows.limit(limit) if limit else rows


def training_table(log: DataFrame, datasets: DataFrame) -> DataFrame:
    """The seven export columns; failures are included."""
    kinds = datasets.select(F.col("dataset_id").alias("__d"), "source_type").dropDuplicates(["__d"])
    joined = log.join(kinds, F.col("dataset_id") == F.col("__d"), "left")
    return joined.select(
        "intent", F.col("user_query").alias("question"), F.col("generated_sql").alias("sql"),
        F.col("python_pipeline").cast("string").alias("pipeline"), "execution_time_ms", F.col("feedback_score").alias("feedback"),
        F.col("source_type").alias("dataset_type"),
    )


def exact_reuse(probes: DataFrame, log: DataFrame, probe_id: str) -> DataFrame:
    """Newest successful run of the same text (and dataset) per probe."""
    newest = F.max_by(F.struct("id", "generated_sql", "created_at"), F.struct("created_at", "id"))
    past = log.filter("success").groupBy("user_query", "dataset_id").agg(newest.alias("hit"))
    return probes.join(past, ["user_query", "dataset_id"]).select(probe_id, F.col("hit.id").alias("matched_id"), "hit.generated_sql")


def best_with(
    probes: DataFrame, log: DataFrame, probe_id: str, column: str, minimum: float = 0.95, native: bool = False, scope: Sequence[str] = ()
) -> DataFrame:
    """Best similar past question which has a value in ``column`` (its SQL or
    its pipeline), with that value; only of the same ``scope``, if given."""
    usable = log.filter(F.col("success") & quoted(column).isNotNull())
    matched = similar_questions(probes, usable, probe_id, minimum, native, scope)
    return matched.join(usable.select(F.col("id").alias("matched_id"), quoted(column)), "matched_id").select(
        "probe_id", "matched_id", "score", quoted(column)
    )


# ---- invalidation ----------------------------------------------------------

SCOPE = ["schema_hash", "intent", "planner_version"]


def invalidated(entries: DataFrame, invalidations: DataFrame, flag: str = "invalidated") -> DataFrame:
    """Flag log entries which are invalidated by id, or by a scope rule set at
    or after their time.

    A rule's empty scope columns match anything.  Instead of comparing every
    entry with every rule, rules are grouped by which columns they name; only
    the latest time per scope matters, so each group is one equi join with
    one row per key.
    """
    ids = invalidations.filter("query_history_id is not null").select(F.col("query_history_id").alias("__id")).distinct()
    marked = entries.join(ids, F.col("id") == F.col("__id"), "left").withColumn(flag, F.col("__id").isNotNull()).drop("__id")
    rules = invalidations.filter("query_history_id is null")
    masks = {tuple(r) for r in rules.select(*[F.col(c).isNotNull() for c in SCOPE]).distinct().collect()}
    for mask in sorted(product([False, True], repeat=len(SCOPE))):
        if mask not in masks:
            continue
        named = [c for c, used in zip(SCOPE, mask) if used]
        same = rules
        for c, used in zip(SCOPE, mask):
            same = same.filter(F.col(c).isNotNull() if used else F.col(c).isNull())
        latest = F.max("invalidated_at").alias("__at")
        if named:
            keyed = same.groupBy(*[F.col(c).alias(f"__{c}") for c in named]).agg(latest)
            on = F.lit(True)
            for c in named:
                on = on & (F.col(c) == F.col(f"__{c}"))
            marked = marked.join(keyed, on, "left")
            hit = F.col("created_at") <= F.col("__at")
        else:
            hit = F.col("created_at") <= F.lit(same.agg(latest).first()[0])
        marked = marked.withColumn(flag, F.col(flag) | F.coalesce(hit, F.lit(False))).drop("__at", *[f"__{c}" for c in named])
    return marked


def drop_invalidated(records: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Records without those named by source id or by family."""
    by_id = invalidations.filter("source_id is not null and source_id <> ''").select("source_id").distinct()
    by_family = invalidations.filter("family_fingerprint is not null and family_fingerprint <> ''").select("family_fingerprint").distinct()
    return records.join(by_id, "source_id", "left_anti").join(by_family, "family_fingerprint", "left_anti")


# ---- plan reuse --------------------------------------------------------------

def reuse_confidence(tier: str, feedback: Column, created: Column, now: Column, ttl_days: int = 30) -> Column:
    base = F.lit(0.9 if tier == "exact_query" else 0.6)
    base = base + F.when(feedback > 0, 0.1).when(feedback < 0, -0.45).otherwise(0.0)
    days = F.greatest((F.unix_micros(now) - F.unix_micros(created)) / F.lit(86400e6), F.lit(0.0))
    value = base * (1.0 - 0.15 * F.least(days / max(ttl_days, 1), F.lit(1.0)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)


def _tier(entries: DataFrame, keys: Sequence[str], tier: str, now: Column, ttl_days: int, newest: int | None) -> DataFrame:
    """State of a tier per key: its newest fresh entry, and whether all its
    entries (or its ``newest`` ones) are invalidated."""
    if newest is not None:
        entries = ranked(entries, [F.desc("created_at"), F.desc("id")], keys, newest)
    fresh = ~F.col("invalidated") & (F.col("created_at") >= now - F.make_dt_interval(F.lit(ttl_days)))
    entry = F.struct("id", "dataset_id", "generated_sql", "feedback_score", "created_at")
    state = entries.groupBy(*[quoted(k) for k in keys]).agg(
        F.max_by(entry, F.when(fresh, F.struct("created_at", "id"))).alias("entry"), F.every("invalidated").alias("all_invalid"),
    )
    status = F.when(F.col("entry").isNotNull(), "ok").when(F.col("all_invalid"), "invalidated").otherwise("expired")
    trust = reuse_confidence(tier, F.col("entry.feedback_score"), F.col("entry.created_at"), now, ttl_days)
    return state.select(*[quoted(k) for k in keys], status.alias("status"), "entry", trust.alias("confidence"))


def plan_reuse(
    probes: DataFrame, log: DataFrame, datasets: DataFrame, invalidations: DataFrame, now: datetime, probe_id: str = "probe_id",
    ttl_days: int = 30, minimum: float = 0.5, newest: int | None = None,
) -> DataFrame:
    """HIT, MISS, EXPIRED or INVALIDATED for a batch of questions.

    ``probes``: probe_id, dataset_id, user_query, intent, planner_version (the
    last two may be null).  Tier one is the same text on the same table
    shape; tier two the same intent (and version, when given).  The log is cut
    to one row per key before it meets the questions, so no question is joined
    with a whole intent.  All entries of a key count, however many are
    invalidated, unless ``newest`` bounds them.
    """
    at = F.lit(now).cast("timestamp")
    shapes = datasets.select(F.col("dataset_id").alias("__d"), F.col("schema_hash").alias("shape")).dropDuplicates(["__d"])
    # An entry belongs to the shape its dataset has now.
    own = log.filter("success").join(shapes, F.col("dataset_id") == F.col("__d")).drop("__d")
    columns = ["id", "dataset_id", "schema_hash", "user_query", "intent", "planner_version", "generated_sql", "feedback_score", "created_at", "invalidated"]
    # Three tiers read the flagged log, so it is written once, slim.
    entries = durable(invalidated(own.drop("schema_hash").withColumnRenamed("shape", "schema_hash"), invalidations).select(*columns))
    asked = probes.join(shapes, F.col("dataset_id") == F.col("__d"), "left").drop("__d").withColumnRenamed("shape", "schema_hash")

    def attach(left: DataFrame, keys: list[str], tier: str, tag: str) -> DataFrame:
        state = _tier(entries, keys, tier, at, ttl_days, newest).select(
            *[quoted(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"{tag}_{c}") for c in ("status", "entry", "confidence")]
        )
        on = F.lit(True)
        for k in keys:
            on = on & (quoted(k) == F.col(f"__{k}"))
        return left.join(state, on, "left").drop(*[f"__{k}" for k in keys])

    both = attach(asked, ["schema_hash", "user_query"], "exact_query", "t1")
    both = attach(both, ["schema_hash", "intent"], "same_intent", "any")
    both = attach(both, ["schema_hash", "intent", "planner_version"], "same_intent", "ver")
    versioned = F.col("planner_version").isNotNull()
    for c in ("status", "entry", "confidence"):
        both = both.withColumn(f"t2_{c}", F.when(versioned, F.col(f"ver_{c}")).otherwise(F.col(f"any_{c}")))
    first = (F.col("t1_status") == "ok") & (F.col("t1_confidence") >= minimum)
    second = (F.col("t2_status") == "ok") & (F.col("t2_confidence") >= minimum)
    first, second = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    either = lambda status: F.coalesce((F.col("t1_status") == status), F.lit(False)) | F.coalesce((F.col("t2_status") == status), F.lit(False))
    outcome = (
        F.when(first | second, "hit").when(either("invalidated"), "invalidated").when(either("expired"), "expired").otherwise("miss")
    )
    entry = F.when(first, F.col("t1_entry")).when(second, F.col("t2_entry"))
    same = F.when(F.col("t1_entry.dataset_id") == F.col("dataset_id"), "same_dataset").otherwise("same_schema_shape")
    matched = F.when(first, same).when(second, "same_intent")
    return both.withColumn("entry", entry).select(
        quoted(probe_id), outcome.alias("outcome"), matched.alias("matched_on"),
        F.when(first, F.col("t1_confidence")).when(second, F.col("t2_confidence")).alias("confidence"),
        F.col("entry.id").alias("matched_id"), F.col("entry.dataset_id").alias("source_dataset_id"), F.col("entry.generated_sql").alias("generated_sql"),
    )


# ---- quality of a run --------------------------------------------------------

WEIGHTS = {  # fixed values: parts of a run's quality
    "plan_completeness": 0.25, "result_validation": 0.25, "semantic_binding": 0.15, "critic": 0.15, "execution": 0.10,
    "output_contract": 0.05, "feedback": 0.05,
}


def run_quality() -> Column:
    """Quality 0–1 of a run from nullable columns plan_completeness,
    result_validation, semantic_binding, critic_score, execution_score,
    output_contract, feedback_score, row_count, column_count, three penalties
    and success; 0 for a failed run."""
    has_summary = F.col("row_count").isNotNull() | F.col("column_count").isNotNull()
    default = F.when(has_summary, 1.0).otherwise(0.5)
    liked = F.when(F.col("feedback_score") > 0, 0.8).when(F.col("feedback_score") < 0, 0.2).otherwise(0.5)
    parts = {
        "plan_completeness": F.coalesce("plan_completeness", default), "result_validation": F.coalesce("result_validation", default),
        "semantic_binding": F.coalesce("semantic_binding", F.lit(0.8)), "critic": F.coalesce("critic_score", F.lit(0.9)),
        "execution": F.coalesce("execution_score", F.lit(1.0)), "output_contract": F.coalesce("output_contract", F.lit(0.8)),
        "feedback": liked,
    }
    value = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        value = value + parts[name] * weight
    value = value + F.when(F.col("row_count") > 0, 0.03).when(F.col("row_count") == 0, -0.05).otherwise(0.0)
    value = value + F.when(F.col("column_count") > 0, 0.02).otherwise(0.0)
    for penalty in ("repair_penalty", "fallback_penalty", "ambiguity_penalty"):
        value = value - F.abs(F.coalesce(penalty, F.lit(0.0)))
    return F.when(~F.col("success"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4))


# ---- figures -----------------------------------------------------------------


def command_stats(log: DataFrame) -> DataFrame:
    """(intent, n, successful, success_rate) with a total row, most frequent
    first.  One grouping; the total is summed from its few rows."""
    per = log.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successful"))
    total = per.agg(F.lit("(all)").alias("intent"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("successful"), F.lit(0)).alias("successful"))
    rate = F.coalesce(F.round(F.try_divide(F.col("successful") * 100.0, F.col("n")), 1), F.lit(0.0))
    return total.unionByName(per).withColumn("success_rate", rate).orderBy(F.desc("n"), "intent")


def latency_summary(log: DataFrame, column: str = "execution_time_ms", by: Sequence[str] = ()) -> DataFrame:
    """Count, median and nearest-rank 95th percentile, exact.

    Values are counted first; the ranks are then found among distinct values
    by a chunked running count, not by sorting a whole group in one task.
    """
    from .ordered import join_on, running_total

    counts = log.filter(quoted(column).isNotNull()).groupBy(*[quoted(b) for b in by], quoted(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    seen = running_total(counts, "c", ["v"], list(by), "upto")
    sizes = counts.groupBy(*[quoted(b) for b in by]).agg(F.sum("c").alias("n"))
    if by:
        with_n = join_on(seen, sizes, list(by))
    else:
        with_n = seen.withColumn("n", F.lit(sizes.first()["n"]))
    n = F.col("n")
    # 0-based ranks: the middle two, and ceil(.95 n) - 1.
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    tail = F.greatest(F.lit(0), F.ceil(n * 0.95) - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = with_n.groupBy(*[quoted(b) for b in by], "n").agg(at(low).alias("a"), at(high).alias("b"), at(tail).alias("p95"))
    return found.select(*[quoted(b) for b in by], "n", ((F.col("a") + F.col("b")) / 2).alias("median"), "p95")


def failure_modes(pairs: DataFrame) -> DataFrame:
    """Counts of planning faults from predicted and expected tools and flags."""
    p, e = F.col("predicted_tools"), F.col("expected_tools")
    empty = F.size(p) == 0
    modes = {
        "missing_tool": empty, "wrong_tool_order": ~empty & (p != e),
        "wrong_tool": F.array_sort(F.array_distinct(p)) != F.array_sort(F.array_distinct(e)),
        "missing_predicate": F.col("predicate_coverage") < 1.0, "wrong_semantic_role_binding": F.col("role_coverage") < 1.0,
        "wrong_aggregation": (F.get(e, F.lit(0)) == "sql.group_by") & ~F.col("has_group_by"),
        "incomplete_multi_step_plan": (F.size(e) > 1) & (F.size(p) < F.size(e)),
        "correct_intent_wrong_executable_plan": F.col("intent_correct") & ~F.col("tool_valid"),
        "unsupported_or_fallback": F.col("plan_source").isin("fallback", "deterministic_fallback"),
    }
    return pairs.agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(test).alias(name) for name, test in modes.items()])


def log_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per log table."""
    result = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("log_table"), F.count(F.lit(1)).alias("n"))
        result = part if result is None else result.unionByName(part)
    return result


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = ()) -> DataFrame:
    """Newest version of each key: the log after compaction."""
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(F.desc(time), *[F.desc(t) for t in tie])
    return df.withColumn("__row", F.row_number().over(window)).filter("__row = 1").drop("__row")
