"""Chat histories and document collections on top of a memory store."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import provenance
from .operators.sequence import numbered
from .sources.store import MemoryStore

ROLES = {"human": "human", "user": "human", "ai": "ai", "assistant": "ai", "system": "system", "tool": "tool"}


def encode_message(role: str, content, extra: dict | None = None) -> dict:
    """A message as memory text and metadata; content that is no string becomes JSON with a mark.

    Extra values that can't be written as JSON are dropped one by one; empty content is an error.
    """
    plain = isinstance(content, str)
    text = content if plain else json.dumps(content)
    if not text.strip():
        raise ValueError("a message needs content")
    kept = {}
    for k, v in (extra or {}).items():
        try:
            json.dumps(v)
        except (TypeError, ValueError):
            continue
        kept[k] = v
    return {"text": text.strip(), "metadata": json.dumps({"role": ROLES.get(role, role), "encoded": not plain, "extra": kept}), "memory_type": "conversation"}


def decode_message(text: str, metadata: str) -> tuple[str, object, dict]:
    m = json.loads(metadata)
    return m["role"], json.loads(text) if m.get("encoded") else text, m.get("extra", {})


class ChatHistory:
    """One session's messages, each a memory without a vector, in order of creation."""

    def __init__(self, store: MemoryStore, session: str):
        self.store, self.session = store, session

    def add_messages(self, messages: list[tuple]) -> None:
        rows = [encode_message(*m) | {"agent_id": self.session} for m in messages]
        if rows:
            self.store.store_batch(self.store.frame(rows))

    @property
    def messages(self) -> list[tuple]:
        rows = self.store.list_all(self.session).filter("memory_type = 'conversation'").select("text", "metadata").collect()
        return [decode_message(r["text"], r["metadata"]) for r in rows]

    def clear(self) -> int:
        return self.store.delete_batch(self.session, [r["memory_id"] for r in self.store.mem(self.session).select("memory_id").collect()])


def history(mem: DataFrame) -> DataFrame:
    """(agent_id, memory_id, turn, role, text) of all sessions at once."""
    rows = mem.filter("memory_type = 'conversation'")
    role = F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$.role", "string"), F.lit("human"))
    return numbered(rows.select("agent_id", "memory_id", role.alias("role"), "text", "created_at", "first_seq"), ["agent_id"], ["created_at", "first_seq"], "turn").drop("created_at", "first_seq")


class Documents:
    """Texts of one tenant, embedded by a function over a text column."""

    def __init__(self, store: MemoryStore, agent_id: str, embed: Callable):
        self.store, self.agent_id, self.embed = store, agent_id, embed

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> None:
        for other in (metadatas, ids):
            if other is not None and len(other) != len(texts):
                raise ValueError("one entry per text is needed")
        rows = [{"agent_id": self.agent_id, "text": t, "metadata": json.dumps((metadatas or [{}] * len(texts))[i]), "memory_id": ids[i] if ids else None} for i, t in enumerate(texts)]
        if rows:
            self.store.store_batch(self.store.frame(rows).withColumn("embedding", self.embed(F.col("text"))))

    def delete(self, ids: list[str]) -> bool:
        return self.store.delete_batch(self.agent_id, ids) > 0

    def similarity_search(self, query: str, k: int = 4, filter: dict | None = None, score_threshold: float | None = None) -> DataFrame:
        """(page_content, metadata, memory_id, score) of the nearest texts."""
        v = self.store.spark.createDataFrame([(query,)], "text string").select(self.embed(F.col("text"))).first()[0]
        hits = self.store.search(self.agent_id, list(v), k, score_threshold, filter)
        docs = provenance.document_view(self.store.mem(self.agent_id)).withColumnRenamed("_memory_id", "memory_id")
        return hits.join(docs, ["agent_id", "memory_id"]).orderBy("rank").select("page_content", "metadata", "memory_id", "score", "conflict_flag", "recommended")
