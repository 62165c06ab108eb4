"""Tables, value domains, constants, and validity rules as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import norm_id, strip

PROVENANCE = "struct<record_id:string,memory_id:string,source_type:string,source_id:string,ingested_by:string,raw_content:string,chunk_index:int,derived_from:array<string>,ingested_at:timestamp>"
MEMORIES = (
    "agent_id string, memory_id string, memory_type string, text string, embedding array<double>, metadata string, status string, created_at timestamp, updated_at timestamp, "
    "expires_at timestamp, importance double, access_count bigint, last_accessed timestamp, superseded_by string, supersedes array<string>, "
    f"provenance {PROVENANCE}, first_seq bigint, version_seq bigint, op string"
)
CONFLICTS = (
    "agent_id string, conflict_id string, memory_a_id string, memory_b_id string, conflict_type string, confidence double, description string, resolution_status string, "
    "detected_at timestamp, resolved_at timestamp, resolution_notes string, first_seq bigint, version_seq bigint, op string"
)
ACTIONS = (
    "agent_id string, plan_id string, action_id string, action_seq bigint, action_type string, tier string, confidence double, source_memory_ids array<string>, "
    "result_memory_id string, reasoning string, created_at timestamp, executed_at timestamp"
)
CASE_RESULTS = "case_name string, category string, score double, pass_threshold double, passed boolean, error string"

# Value domains.
MEMORY_TYPES = ("conversation", "skill", "custom")
STATUSES = ("active", "superseded", "flagged", "archived", "pending_review")
SEARCHABLE = ("active", "flagged", "pending_review")
CONFLICT_TYPES = ("direct_contradiction", "temporal_supersession", "partial_conflict")
RESOLUTIONS = ("pending", "auto_resolved", "human_reviewed")

# Thresholds and defaults.
CLUSTER_SIMILARITY = 0.82
CONFLICT_CONFIDENCE = 0.80
AUTO_MERGE, AUTO_FLAG = 0.92, 0.78
DEFAULT_IMPORTANCE = 0.5
CANDIDATE_LIMIT = 21
HALF_LIFE_DAYS, STALE_BELOW = 30.0, 0.5
PROBES, PROBE_K = 50, 5
WEIGHTS = {"freshness": 0.25, "provenance": 0.25, "contradiction": 0.25, "confidence_gap": 0.25}
HEALTH_RISK, EVAL_RISK, SCENARIO_RISK = (0.80, 0.60, 0.40), (0.85, 0.70, 0.50), (0.85, 0.65, 0.40)
PASS_THRESHOLD = 0.7


def fields(ddl: str, without: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([f for f in T.StructType.fromDDL(ddl).fields if f.name not in without])


def _blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)) == "", F.lit(True))


def _in(c: str, lo: float, hi: float) -> Column:
    return F.coalesce(F.col(c).between(lo, hi), F.lit(False))


def memory_rules() -> dict[str, Column]:
    """Rule name to a Boolean column that holds for a valid memory."""
    no_self = ~F.col("superseded_by").eqNullSafe(F.col("memory_id")) & ~F.coalesce(F.array_contains("supersedes", F.col("memory_id")), F.lit(False))
    return {
        "agent_not_blank": ~_blank("agent_id"),
        "text_not_blank": ~_blank("text"),
        "embedding_not_empty": F.coalesce(F.size("embedding") > 0, F.lit(True)),
        "metadata_is_json": F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull(),
        "known_type": F.coalesce(F.col("memory_type").isin(*MEMORY_TYPES), F.lit(False)),
        "known_status": F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "importance_in_range": _in("importance", 0.0, 1.0),
        "access_count_not_negative": F.coalesce(F.col("access_count") >= 0, F.lit(False)),
        "no_self_link": no_self,
        "provenance_matches": F.col("provenance").isNull() | F.col("provenance.memory_id").eqNullSafe(F.col("memory_id")),
        "chunk_not_negative": F.coalesce(F.col("provenance.chunk_index") >= 0, F.lit(True)),
    }


def provenance_rules() -> dict[str, Column]:
    """Rules of a memory's provenance; a memory without one breaks none."""
    p = lambda c: F.col(f"provenance.{c}")
    none = F.col("provenance").isNull()
    given = lambda c: p(c).isNull() | (strip(p(c)) != "")
    return {
        "memory_id_not_blank": none | F.coalesce(strip(p("memory_id")) != "", F.lit(False)),
        "source_id_not_blank": none | given("source_id"),
        "ingested_by_not_blank": none | given("ingested_by"),
        "chunk_not_negative": none | F.coalesce(p("chunk_index") >= 0, F.lit(True)),
        "derived_from_not_blank": none | F.coalesce(F.forall(p("derived_from"), lambda x: F.coalesce(strip(x) != "", F.lit(False))), F.lit(True)),
    }


def health_rules() -> dict[str, Column]:
    """Rules of a health report."""
    unit = ("avg_importance", "contradiction_score", "freshness_score", "confidence_accuracy_gap", "provenance_completeness", "score")
    return {f"{c}_in_range": _in(c, 0.0, 1.0) for c in unit} | {
        "counts_not_negative": F.coalesce(F.least("total_memories", "stale_count", "conflict_count") >= 0, F.lit(False)),
        "stale_within_total": F.coalesce(F.col("stale_count") <= F.col("total_memories"), F.lit(False)),
        "age_not_negative": F.coalesce(F.col("oldest_age_days") >= 0, F.lit(True)),
        "known_risk": F.coalesce(F.col("risk_level").isin("low", "medium", "high", "critical"), F.lit(False)),
    }


def plans(actions: DataFrame) -> DataFrame:
    """(plan_id, n_actions, n_agents, n_executed, created_at, executed_at) of each plan, for ``plan_rules``."""
    return actions.groupBy("plan_id").agg(F.count("*").alias("n_actions"), F.count_distinct("agent_id").alias("n_agents"), F.count("executed_at").alias("n_executed"), F.min("created_at").alias("created_at"), F.min("executed_at").alias("executed_at"))


def plan_rules() -> dict[str, Column]:
    return {
        "has_actions": F.coalesce(F.col("n_actions") > 0, F.lit(False)),
        "one_agent": F.coalesce(F.col("n_agents") == 1, F.lit(False)),
        "executed_whole_or_not": F.col("n_executed").isin(0) | (F.col("n_executed") == F.col("n_actions")),
        "executed_after_created": F.coalesce(F.col("executed_at") >= F.col("created_at"), F.lit(True)),
    }


def check_instants(df: DataFrame) -> None:
    """Times must be instants; a column of local times is an error."""
    local = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    if local:
        raise ValueError(f"times without a zone: {', '.join(local)}")


def conflict_rules() -> dict[str, Column]:
    pending = F.col("resolution_status").eqNullSafe("pending")
    return {
        "ids_not_blank": ~_blank("memory_a_id") & ~_blank("memory_b_id"),
        "ids_differ": ~norm_id(F.col("memory_a_id")).eqNullSafe(norm_id(F.col("memory_b_id"))),
        "known_type": F.coalesce(F.col("conflict_type").isin(*CONFLICT_TYPES), F.lit(False)),
        "confidence_in_range": _in("confidence", 0.0, 1.0),
        "description_not_blank": ~_blank("description"),
        "resolved_after_detected": F.coalesce(F.col("resolved_at") >= F.col("detected_at"), F.lit(True)),
        "resolved_has_time": pending | F.col("resolved_at").isNotNull(),
    }


def action_rules() -> dict[str, Column]:
    return {
        "has_sources": F.coalesce(F.size("source_memory_ids") > 0, F.lit(False)),
        "sources_not_blank": F.coalesce(F.forall("source_memory_ids", lambda x: F.coalesce(strip(x) != "", F.lit(False))), F.lit(False)),
        "confidence_in_range": _in("confidence", 0.0, 1.0),
        "executed_after_created": F.coalesce(F.col("executed_at") >= F.col("created_at"), F.lit(True)),
        "executed_has_result": F.col("executed_at").isNull() | F.col("result_memory_id").isNotNull(),
    }


def case_rules() -> dict[str, Column]:
    failed = F.col("error").isNotNull()
    return {
        "error_means_failed": ~failed | ((F.col("score") == 0) & ~F.col("passed")),
        "passed_by_threshold": failed | F.col("passed").eqNullSafe(F.col("score") >= F.col("pass_threshold")),
    }


def hit_rules() -> dict[str, Column]:
    return {
        "score_in_range": _in("score", 0.0, 1.0),
        "rank_from_one": F.coalesce(F.col("rank") >= 1, F.lit(False)),
        "flag_iff_conflicts": F.col("conflict_flag").eqNullSafe(F.size("conflicts_with") > 0),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_rows) of each rule, counted in one pass."""
    counts = df.agg(*[F.count_if(~v).alias(k) for k, v in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_rows")) for k in rules])).alias("r")).select("r.*")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with the names of the rules they break)."""
    broken = F.filter(F.array(*[F.when(~v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    ok = reduce(lambda a, b: a & b, rules.values())
    return df.filter(ok), df.filter(~ok).withColumn("broken_rules", broken)
