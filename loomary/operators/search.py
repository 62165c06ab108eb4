"""Exact vector search per tenant, and its enrichment with open conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import vector
from ..functions.scalars import contains, matches
from .records import embedded, pending
from .similarity import METRICS, nearest


def search_one(mem: DataFrame, agent_id: str, query: list[float], top_k: int = 10, score_threshold: float | None = None, filters: dict | None = None, metric: str = "cosine") -> DataFrame:
    """The best hits of one tenant for one vector, with contiguous ranks from 1.

    ``metric`` is cosine, dot, euclid or manhattan; hits are ranked and cut by it, then the score is
    clamped to [0, 1].  Filters on metadata come before the cut to ``top_k``; the threshold is inclusive; ties go to the
    earliest record.  ``top_k`` 0 gives nothing, a negative one is an error.
    """
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    rows = mem.filter((F.col("agent_id") == agent_id) & F.col("embedding").isNotNull())
    if filters:
        rows = rows.filter(matches(F.col("metadata"), filters))
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    score, far = {"cosine": (vector.cosine, False), "dot": (vector.dot, False), "euclid": (vector.euclidean, True), "manhattan": (vector.manhattan, True)}[metric]
    scored = rows.withColumn("score", score(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    if score_threshold is not None:
        scored = scored.filter(F.col("score") <= score_threshold if far else F.col("score") >= score_threshold)
    order = [F.asc("score") if far else F.desc("score"), F.asc("first_seq")]
    top = scored.orderBy(*order).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("score", vector.clamp(F.col("score")))


def search_many(mem: DataFrame, probes: DataFrame, top_k: int = 10, score_threshold: float | None = None, earlier: bool = False, metric: str = "cosine") -> DataFrame:
    """(agent_id, probe, memory_id, score, rank) of many probes (agent_id, probe, embedding) at once.

    ``probe`` and ``first_seq`` are the numbers by which ties break; with ``earlier`` a probe finds
    only memories whose number is not above its own.
    """
    rows = embedded(mem).select(F.col("agent_id").alias("scope"), F.col("first_seq").alias("id"), F.col("embedding").alias("vec"))
    asked = embedded(probes).select(F.col("agent_id").alias("scope"), F.col("probe").alias("id"), F.col("embedding").alias("vec"))
    found = nearest(asked, rows, top_k, score_threshold, earlier=earlier, metric=metric)
    names = mem.select(F.col("agent_id").alias("scope"), F.col("first_seq").alias("id"), "memory_id")
    return found.join(names, ["scope", "id"]).select(F.col("scope").alias("agent_id"), "probe", "memory_id", vector.clamp(F.col("score")).alias("score"), "rank")


def loser(a: str = "", b: str = "o_") -> Column:
    """Of two conflicting hits, the id that is not recommended: retired, superseded, older, or ranked worse."""
    active = lambda p: F.coalesce(F.col(f"{p}status") == "active", F.lit(False))
    ida, idb = F.col(f"{a}memory_id"), F.col(f"{b}memory_id")
    return (
        F.when(active(a) != active(b), F.when(active(a), idb).otherwise(ida))
        .when(F.col(f"{a}superseded_by").eqNullSafe(idb), ida)
        .when(F.col(f"{b}superseded_by").eqNullSafe(ida), idb)
        .when(F.col(f"{a}created_at") < F.col(f"{b}created_at"), ida)
        .when(F.col(f"{a}created_at") > F.col(f"{b}created_at"), idb)
        .otherwise(F.when(F.col(f"{a}rank") > F.col(f"{b}rank"), ida).otherwise(idb))
    )


def enrich(hits: DataFrame, mem: DataFrame, conf: DataFrame, strict_status: bool = False) -> DataFrame:
    """Hits with conflict_flag, conflicts_with, conflict_summary and recommended.

    A tenant without any open conflict gets its hits unchanged; else retired memories leave the
    result, ranks keep their gaps.  ``strict_status`` drops retired memories in any case.
    ``conflicts_with`` lists the partner of each record, in order of detection, repeats included.
    """
    open_ = pending(conf)
    ends = open_.select("agent_id", "confidence", "description", "detected_at", "first_seq", F.explode(F.array(F.struct(F.col("memory_a_id").alias("me"), F.col("memory_b_id").alias("other")), F.struct(F.col("memory_b_id").alias("me"), F.col("memory_a_id").alias("other")))).alias("e"))
    ends = ends.select("agent_id", F.col("e.me").alias("memory_id"), F.col("e.other").alias("other"), "confidence", "description", "detected_at", "first_seq")
    order = F.array_sort(F.collect_list(F.struct("detected_at", "first_seq", "other")))
    per_memory = ends.groupBy("agent_id", "memory_id").agg(F.transform(order, lambda x: x["other"]).alias("conflicts_with"), F.min_by("description", F.struct(-F.coalesce("confidence", F.lit(-1.0)), "detected_at", "first_seq")).alias("conflict_summary"))
    facts = mem.select("agent_id", "memory_id", "status", "superseded_by", "created_at")
    h = hits.join(facts, ["agent_id", "memory_id"]).join(per_memory, ["agent_id", "memory_id"], "left")
    any_open = open_.select("agent_id").distinct().withColumn("_open", F.lit(True))
    # two hits of one response with a record between them
    o = hits.join(facts, ["agent_id", "memory_id"]).select("agent_id", "probe", *[F.col(c).alias(f"o_{c}") for c in ("memory_id", "rank", "status", "superseded_by", "created_at")])
    pairs = hits.join(facts, ["agent_id", "memory_id"]).join(ends.select("agent_id", "memory_id", F.col("other").alias("o_memory_id")).distinct(), ["agent_id", "memory_id"]).join(o, ["agent_id", "probe", "o_memory_id"])
    lost = pairs.select("agent_id", "probe", loser().alias("memory_id")).distinct().withColumn("_lost", F.lit(True))
    out = h.join(lost, ["agent_id", "probe", "memory_id"], "left").join(any_open, "agent_id", "left")
    retired = ~F.col("status").isin(*schema.SEARCHABLE)
    out = out.filter(~retired if strict_status else ~(retired & F.coalesce("_open", F.lit(False))))
    return out.select(
        "agent_id", "probe", "memory_id", "score", "rank", F.col("conflicts_with").isNotNull().alias("conflict_flag"),
        F.coalesce("conflicts_with", F.array().cast("array<string>")).alias("conflicts_with"), "conflict_summary", F.col("_lost").isNull().alias("recommended"),
    )


def first_with(hits: DataFrame, mem: DataFrame, snippet: str) -> DataFrame:
    """(agent_id, probe, memory_id, rank): of each search the best hit whose text holds ``snippet``, without case."""
    holds = mem.filter(contains(F.col("text"), F.lit(snippet))).select("agent_id", "memory_id")
    return hits.join(holds, ["agent_id", "memory_id"], "left_semi").groupBy("agent_id", "probe").agg(F.min_by("memory_id", "rank").alias("memory_id"), F.min("rank").alias("rank"))


def by_importance(hits: DataFrame, mem: DataFrame, as_of: Column, weight: float = 0.2) -> DataFrame:
    """Hits ranked again by cosine and, at ``weight``, importance, use and recency; not the default order."""
    facts = mem.select("agent_id", "memory_id", "importance", "access_count", "last_accessed", "first_seq")
    j = hits.join(facts, ["agent_id", "memory_id"])
    recent = F.coalesce(F.exp((F.unix_micros("last_accessed") - F.unix_micros(as_of)) / F.lit(30 * 86400e6)), F.lit(0.0))
    used = F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.coalesce("access_count", F.lit(0)))
    merit = (F.coalesce("importance", F.lit(schema.DEFAULT_IMPORTANCE)) + used + vector.clamp(recent)) / 3
    j = j.withColumn("merit", (1 - weight) * F.col("score") + weight * merit)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("agent_id", "probe").orderBy(F.desc("merit"), "first_seq"))).select("agent_id", "probe", "memory_id", "score", "merit", "rank")
