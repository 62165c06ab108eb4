"""Contradiction candidates, their classification, and new conflict records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import parse_verdict, row_key
from .health import close_pairs
from .records import pending
from .search import search_many

Classifier = Callable[[DataFrame], DataFrame]


def rule_classifier(pairs: DataFrame) -> DataFrame:
    """A deterministic stand-in for a language model, by the records' write numbers."""
    a, b = F.floor(F.col("seq_a") / 100), F.floor(F.col("seq_b") / 100)
    verdict = F.element_at(F.array(F.lit("direct_contradiction"), F.lit("temporal_supersession"), F.lit("partial_conflict"), F.lit("unrelated")), (F.pmod(a + b, F.lit(4)) + 1).cast("int"))
    return pairs.withColumns({"verdict": verdict, "confidence": F.lit(0.7) + F.pmod(a * 7 + b * 13, F.lit(31)) / 100.0, "summary": F.lit("rule")})


def model_classifier(ask: Callable, prompt: Callable[[], Column]) -> Classifier:
    """A classifier around a text model: ``ask`` is a pandas UDF from prompt to reply.

    Replies are read strictly; anything but a JSON object is an unrelated pair.
    """

    def run(pairs: DataFrame) -> DataFrame:
        r = pairs.withColumn("_r", parse_verdict(ask(prompt())))
        return r.withColumns({c: F.col(f"_r.{c}") for c in ("verdict", "confidence", "summary")}).drop("_r")

    return run


def confirmed(verdicts: DataFrame, least: float = schema.CONFLICT_CONFIDENCE) -> DataFrame:
    """Verdicts that make a conflict: a known type with enough confidence (inclusive)."""
    return verdicts.filter(F.col("verdict").isin(*schema.CONFLICT_TYPES) & (F.col("confidence") >= least))


def scan(mem: DataFrame, conf: DataFrame, as_of: Column, classify: Classifier = rule_classifier, similarity: float = schema.CLUSTER_SIMILARITY) -> DataFrame:
    """New conflict records of all tenants: close pairs without an open record, classified and confirmed.

    Known pairs leave before the classifier, so a second scan over the stored result adds nothing.
    """
    ids = mem.select("agent_id", "memory_id", "first_seq")
    pairs = close_pairs(mem, as_of, similarity)
    named = pairs.join(ids.select("agent_id", F.col("first_seq").alias("seq_a"), F.col("memory_id").alias("memory_a_id")), ["agent_id", "seq_a"]).join(ids.select("agent_id", F.col("first_seq").alias("seq_b"), F.col("memory_id").alias("memory_b_id")), ["agent_id", "seq_b"])
    named = named.withColumns({"lo": F.least("memory_a_id", "memory_b_id"), "hi": F.greatest("memory_a_id", "memory_b_id")})
    fresh = named.join(pending(conf).select("agent_id", "lo", "hi").distinct(), ["agent_id", "lo", "hi"], "left_anti")
    return records(confirmed(classify(fresh)))


def records(verdicts: DataFrame) -> DataFrame:
    key = row_key(F.col("agent_id"), F.col("memory_a_id"), F.col("memory_b_id"), F.col("verdict"))
    return verdicts.select("agent_id", key.alias("conflict_id"), "memory_a_id", "memory_b_id", F.col("verdict").alias("conflict_type"), "confidence", F.col("summary").alias("description"), F.lit("pending").alias("resolution_status"))


def on_store(new: DataFrame, mem: DataFrame, classify: Classifier = rule_classifier, similarity: float = schema.CLUSTER_SIMILARITY, limit: int = schema.CANDIDATE_LIMIT) -> DataFrame:
    """Conflicts of newly written memories with earlier ones of their tenant.

    Each searches what its tenant held when it was written (all statuses, inclusive threshold, at most
    ``limit`` hits with itself among them); later records take no places.  The record's first side is
    the new memory.
    """
    hits = search_many(mem, new.select("agent_id", F.col("first_seq").alias("probe"), "embedding"), limit, similarity, earlier=True)
    seqs = mem.select("agent_id", "memory_id", F.col("first_seq").alias("seq_b"))
    pairs = hits.join(seqs, ["agent_id", "memory_id"]).filter("seq_b < probe").select("agent_id", F.col("probe").alias("seq_a"), "seq_b", F.col("memory_id").alias("memory_b_id"), F.col("score").alias("similarity"))
    own = mem.select("agent_id", F.col("memory_id").alias("memory_a_id"), F.col("first_seq").alias("seq_a"))
    return records(confirmed(classify(pairs.join(own, ["agent_id", "seq_a"]))))
