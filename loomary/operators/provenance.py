"""Where memories come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema


#: Times in documents, to the microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def manifest(mem: DataFrame) -> DataFrame:
    """One flat row per memory with provenance."""
    p = "provenance"
    return mem.filter(F.col(p).isNotNull()).select(
        "agent_id", "memory_id", "memory_type", "status", "text", "created_at", "updated_at", "importance",
        *[F.col(f"{p}.{c}").alias(c) for c in ("record_id", "source_type", "source_id", "ingested_by", "raw_content", "chunk_index", "derived_from", "ingested_at")],
    )


def export_json(mem: DataFrame) -> DataFrame:
    """(agent_id, memory_id, document): the manifest rows as JSON, nulls written out."""
    m = manifest(mem)
    return m.select("agent_id", "memory_id", F.to_json(F.struct(*m.columns), {"ignoreNullFields": "false"} | _JSON).alias("document"))


def document_view(mem: DataFrame) -> DataFrame:
    """(page_content, metadata, memory_id) as document stores expect it."""
    return mem.select(F.col("text").alias("page_content"), "metadata", F.col("memory_id").alias("_memory_id"), "agent_id")


def to_payload(mem: DataFrame) -> DataFrame:
    """(agent_id, memory_id, payload, embedding): all fields but the vector as JSON, as vector stores keep them."""
    rest = [c for c in mem.columns if c != "embedding"]
    return mem.select("agent_id", "memory_id", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"} | _JSON).alias("payload"), "embedding")


def from_payload(rows: DataFrame, payload: str = "payload", embedding: Column | None = None) -> DataFrame:
    """Memories of payloads; keys that are no field are ignored, a payload that is no JSON gives nulls."""
    fields = schema.fields(schema.MEMORIES, without=("embedding",))
    vec = F.col("embedding") if embedding is None else embedding
    return rows.select(F.from_json(payload, fields, _JSON).alias("m"), vec.cast("array<double>").alias("embedding")).select("m.*", "embedding")
