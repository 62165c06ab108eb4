"""Micro-batch ingest: versions, store-time detection, access counts, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import norm_id
from ..operators import detect
from ..sources.store import MemoryStore


def once(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each version of a record once, within the time that repeats may lag."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, store: MemoryStore, checkpoint: str, classify: detect.Classifier = detect.rule_classifier, once_only: bool = True) -> StreamingQuery:
    """Append each micro-batch, then detect conflicts of its memories with all earlier ones.

    A batch that is replayed after a failure stores only what is missing: rows whose (agent_id,
    memory_id, updated_at, text) is already the stored state aren't written again.  Conflicts are
    detected of all memories of the batch, written before or not, and go in by their key unless they
    are known, whatever became of them; so a break between the two writes loses none.  Only the
    buckets of the batch's tenants are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        same = ["agent_id", "memory_id", "updated_at", "text"]
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            at = store.memories.touched(batch)
            fresh = batch.join(store.memories.state(buckets=at).select(*same), same, "left_anti")
            if not fresh.isEmpty():
                store.store_batch(fresh)
            mem = store.memories.state(buckets=at)
            named = batch.select("agent_id", norm_id(F.col("memory_id")).alias("memory_id")).distinct()
            found = detect.on_store(mem.join(named, ["agent_id", "memory_id"], "left_semi"), mem, classify, store.similarity)
            known = store.conflicts.state(buckets=at, deleted=True).select("agent_id", "conflict_id")
            store._keep_conflicts(found.join(known, ["agent_id", "conflict_id"], "left_anti"))
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once_only else w).start()


def access_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, n, last_ts) for update mode."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and time window; a window closes when the watermark has passed it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def expired(stream: DataFrame, as_of) -> DataFrame:
    """Rows whose time to live is over."""
    return stream.filter(F.coalesce(as_of > F.col("expires_at"), F.lit(False)))
