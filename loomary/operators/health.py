"""Health of each tenant's memories: freshness, provenance, contradictions, confidence gap, composite."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import vector
from ..functions.scalars import age_days, decay, health_risk, is_usable
from ..session import hold
from .records import embedded, pending, usable
from .search import search_many
from .similarity import pairs_above


@dataclass(frozen=True)
class HealthConfig:
    half_life: float = schema.HALF_LIFE_DAYS
    stale_below: float = schema.STALE_BELOW
    similarity: float = schema.CLUSTER_SIMILARITY
    probes: int | None = schema.PROBES
    k: int = schema.PROBE_K
    weights: dict[str, float] = field(default_factory=lambda: dict(schema.WEIGHTS))

    def __post_init__(self) -> None:
        if self.half_life <= 0 or not 0 <= self.stale_below <= 1 or not -1 <= self.similarity <= 1:
            raise ValueError("half-life must be positive, thresholds within range")
        if (self.probes is not None and self.probes < 1) or self.k < 1:
            raise ValueError("probes and k must be at least 1")
        if any(w < 0 for w in self.weights.values()) or sum(self.weights.values()) <= 0:
            raise ValueError("weights must not be negative, and not all zero")


def freshness(mem: DataFrame, as_of: Column, c: HealthConfig = HealthConfig()) -> DataFrame:
    """(agent_id, total_memories, freshness_score, stale_count, provenance_completeness, avg_importance, oldest_age_days) in one pass."""
    age = age_days(F.col("updated_at"), as_of)
    f = decay(age, c.half_life)
    imp = F.col("importance")
    weighted = F.when(F.sum(imp) > 0, F.sum(f * imp) / F.sum(imp)).otherwise(F.avg(f))
    known = F.col("has_provenance") if "has_provenance" in mem.columns else F.col("provenance").isNotNull()
    return usable(mem, as_of).groupBy("agent_id").agg(
        F.count("*").alias("total_memories"), F.coalesce(vector.clamp(weighted), F.lit(1.0)).alias("freshness_score"), F.count_if(f < c.stale_below).alias("stale_count"),
        F.avg(known.cast("double")).alias("provenance_completeness"), F.avg(imp).alias("avg_importance"), F.max(age).alias("oldest_age_days"),
    )


def stale(mem: DataFrame, as_of: Column, c: HealthConfig = HealthConfig()) -> DataFrame:
    """(agent_id, memory_id) of usable memories below the stale cut."""
    return usable(mem, as_of).filter(decay(age_days(F.col("updated_at"), as_of), c.half_life) < c.stale_below).select("agent_id", "memory_id")


def close_pairs(mem: DataFrame, as_of: Column, similarity: float = schema.CLUSTER_SIMILARITY) -> DataFrame:
    """(agent_id, seq_a, seq_b, similarity): usable memories whose raw cosine is above the cut (strictly)."""
    rows = embedded(usable(mem, as_of)).select(F.col("agent_id").alias("scope"), F.col("first_seq").alias("id"), F.col("embedding").alias("vec"))
    return pairs_above(rows, similarity).select(F.col("scope").alias("agent_id"), F.col("id_a").alias("seq_a"), F.col("id_b").alias("seq_b"), F.col("score").alias("similarity"))


def contradictions(mem: DataFrame, as_of: Column, pairs: DataFrame) -> DataFrame:
    """(agent_id, n_valid, n_involved, n_pairs, contradiction_score, embedding_coverage)."""
    u = usable(mem, as_of)
    ok = vector.usable(F.col("embedding"))
    sizes = u.groupBy("agent_id").agg(F.count("*").alias("n_usable"), F.count_if(ok).alias("n_valid"), F.count_if(F.col("embedding").isNotNull()).alias("n_vectors"))
    involved = pairs.select("agent_id", F.explode(F.array("seq_a", "seq_b")).alias("s")).groupBy("agent_id").agg(F.count_distinct("s").alias("n_involved"))
    n_pairs = pairs.groupBy("agent_id").agg(F.count("*").alias("n_pairs"))
    j = sizes.join(involved, "agent_id", "left").join(n_pairs, "agent_id", "left").fillna(0, ["n_involved", "n_pairs"])
    few = F.col("n_valid") < 2
    return j.select(
        "agent_id", "n_valid", "n_involved", "n_pairs", F.when(few, 0.0).otherwise(F.col("n_involved") / F.col("n_valid")).alias("contradiction_score"),
        (F.when(few, F.col("n_vectors")).otherwise(F.col("n_valid")) / F.col("n_usable")).alias("embedding_coverage"),
    )


def check_dimensions(mem: DataFrame) -> DataFrame:
    """Tenants whose vectors differ in length (should be none)."""
    return mem.filter(F.size("embedding") > 0).groupBy("agent_id").agg(F.count_distinct(F.size("embedding")).alias("n_dimensions")).filter("n_dimensions > 1")


def confidence_gap(mem: DataFrame, as_of: Column, c: HealthConfig = HealthConfig()) -> DataFrame:
    """(agent_id, confidence_accuracy_gap, n_probed): mean distance of retrieval score and share of usable hits.

    At most ``probes`` probes a tenant, drawn by hash and thus the same in every run; all if None.
    """
    cand = embedded(usable(mem, as_of)).select("agent_id", F.col("first_seq").alias("probe"), "embedding", "memory_id")
    if c.probes is None:
        several = cand.groupBy("agent_id").agg(F.count("*").alias("n")).filter("n >= 2")
        probes = cand.join(several, "agent_id", "left_semi")
    else:
        draw = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.md5("memory_id"), "memory_id"))
        many = Window.partitionBy("agent_id")
        probes = cand.withColumn("_n", draw).filter(F.col("_n") <= c.probes).withColumn("_all", F.count("*").over(many)).filter("_all >= 2")
    hits = search_many(mem, probes.select("agent_id", "probe", "embedding"), c.k + 1)
    facts = mem.select("agent_id", "memory_id", F.col("first_seq").alias("seq"), is_usable(as_of).alias("ok"))
    others = hits.join(facts, ["agent_id", "memory_id"]).filter("seq <> probe")
    first = others.withColumn("r", F.row_number().over(Window.partitionBy("agent_id", "probe").orderBy("rank"))).filter(F.col("r") <= c.k)
    per_probe = first.groupBy("agent_id", "probe").agg(F.abs(F.avg("score") - F.avg(F.col("ok").cast("double"))).alias("gap"))
    return per_probe.groupBy("agent_id").agg(vector.clamp(F.avg("gap")).alias("confidence_accuracy_gap"), F.count("*").alias("n_probed"))


def health(mem: DataFrame, conf: DataFrame, as_of: Column, c: HealthConfig = HealthConfig()) -> DataFrame:
    """One row per tenant: the parts, their weighted score, and its risk label."""
    agents = mem.select("agent_id").distinct()
    pairs = hold(close_pairs(mem, as_of, c.similarity), "pairs")
    n_pending = pending(conf).groupBy("agent_id").agg(F.count("*").alias("n_pending"))
    j = agents.join(freshness(mem, as_of, c), "agent_id", "left").join(contradictions(mem, as_of, pairs), "agent_id", "left").join(confidence_gap(mem, as_of, c), "agent_id", "left").join(n_pending, "agent_id", "left")
    j = j.fillna(0, ["total_memories", "stale_count", "n_pairs", "n_pending"]).fillna(0.0, ["avg_importance", "contradiction_score", "confidence_accuracy_gap"]).fillna(1.0, ["freshness_score", "provenance_completeness"])
    w = c.weights
    score = vector.clamp(w["freshness"] * F.col("freshness_score") + w["provenance"] * F.col("provenance_completeness") + w["contradiction"] * (1 - F.col("contradiction_score")) + w["confidence_gap"] * (1 - F.col("confidence_accuracy_gap")))
    return j.withColumn("score", score).select(
        "agent_id", "total_memories", "stale_count", F.when(F.col("n_pending") > 0, F.col("n_pending")).otherwise(F.col("n_pairs")).alias("conflict_count"), "avg_importance",
        "oldest_age_days", "freshness_score", "provenance_completeness", "contradiction_score", "confidence_accuracy_gap", "score", health_risk(F.col("score")).alias("risk_level"),
    )
