"""What a memory store must offer; ``MemoryStore`` does, and so may another back end."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Storage(Protocol):
    """Memories and conflicts of tenants. Frames go in and out; ids are compared without case and outer blanks."""

    backend_name: str

    def store_batch(self, df: DataFrame) -> None: ...

    def update(self, df: DataFrame) -> None: ...

    def delete_batch(self, agent_id: str, ids: list[str]) -> int: ...

    def fetch_batch(self, agent_id: str, ids: list[str]) -> DataFrame: ...

    def list_all(self, agent_id: str, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame: ...

    def count(self, agent_id: str, status: str | None = None) -> int: ...

    def search(self, agent_id: str, query: list[float], top_k: int = 10, score_threshold: float | None = None, filters: dict | None = None) -> DataFrame: ...

    def store_conflict(self, row: dict) -> None: ...

    def list_conflicts(self, agent_id: str, status: str | None = None) -> DataFrame: ...

    def update_conflict(self, df: DataFrame) -> None: ...

    def delete_conflict(self, agent_id: str, conflict_id: str) -> bool: ...

    def close(self) -> None: ...
