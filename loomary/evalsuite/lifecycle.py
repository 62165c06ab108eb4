"""Cases that drive a store through its own methods: set up, run, score, and always clean up."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators.consolidate import rule_planner
from ..sources.protocol import Storage
from ..sources.store import MemoryStore
from . import cases

log = logging.getLogger(__name__)


class StoreCase(ABC):
    """One case; a subclass must name itself, its category and what it shows."""

    name: str
    category: str
    description: str
    pass_threshold: float = schema.PASS_THRESHOLD

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        missing = [a for a in ("name", "category", "description") if not isinstance(getattr(cls, a, None), str) or not getattr(cls, a).strip()]
        if missing:
            raise TypeError(f"{cls.__name__} lacks {', '.join(missing)}")

    @property
    def agent_id(self) -> str:
        return f"eval_{self.category}_{self.name}".lower().replace(".", "_")

    @abstractmethod
    def setup(self, store: Storage) -> None: ...

    @abstractmethod
    def run(self, store: Storage) -> Any: ...

    @abstractmethod
    def score(self, result: Any) -> float: ...

    def teardown(self, store: Storage) -> None:
        """Delete what the case's tenant holds."""
        ids = [r["memory_id"] for r in store.list_all(self.agent_id).select("memory_id").collect()]
        if ids:
            store.delete_batch(self.agent_id, ids)


def run_case(case: StoreCase, store: Storage, timeout: float = 300.0) -> tuple:
    """A row of case results.

    A setup that fails or is late gives an error and no cleaning up; after it, ``teardown`` always
    runs, and its failures are only logged.
    """

    def row(score: float, error: str | None) -> tuple:
        return case.name, case.category, float(score), case.pass_threshold, error is None and score >= case.pass_threshold, error

    pool = ThreadPoolExecutor(1)  # a late phase is left behind, not waited for
    try:
        try:
            pool.submit(case.setup, store).result(timeout)
        except Late:
            return row(0.0, f"setup: timed out after {timeout}s")
        except Exception as e:  # noqa: BLE001 - a broken case is a failed one
            return row(0.0, f"setup: {e}")
        try:
            return row(case.score(pool.submit(case.run, store).result(timeout)), None)
        except Late:
            return row(0.0, f"run: timed out after {timeout}s")
        except Exception as e:  # noqa: BLE001
            return row(0.0, str(e) or repr(e))
        finally:
            clean = ThreadPoolExecutor(1)
            try:
                clean.submit(case.teardown, store).result(timeout)
            except Exception as e:  # noqa: BLE001
                log.warning("cleaning up after %s failed: %r", case.name, e)
            clean.shutdown(wait=False)
    finally:
        pool.shutdown(wait=False)


def run_all(spark: SparkSession, chosen: list[StoreCase], store: Storage, timeout: float = 300.0) -> DataFrame:
    """Case results; two cases of one name are an error."""
    names = [c.name for c in chosen]
    if len(set(names)) < len(names):
        raise ValueError("case names must differ")
    return spark.createDataFrame([run_case(c, store, timeout) for c in chosen], schema.CASE_RESULTS)


def _store(store: MemoryStore, agent: str, mid: str, words: str, **kw: Any) -> None:
    store.store_batch(store.frame([{"agent_id": agent, "memory_id": mid, "text": f"note {mid} on {words}", "embedding": cases.vector(*words.split())} | kw]))


class Touched(StoreCase):
    name, category, description = "touch_counts_one_access", "temporal", "an access changes the count and nothing else"

    def setup(self, store: MemoryStore) -> None:
        _store(store, self.agent_id, "x", "api rate", importance=0.4)

    def run(self, store: MemoryStore) -> Any:
        store.touch(self.agent_id, "x")
        return store.fetch(self.agent_id, "x").first()

    def score(self, r: Any) -> float:
        return ((r["access_count"] == 1) + (r["importance"] == 0.4) + (r["status"] == "active")) / 3


class Replaced(StoreCase):
    name, category, description = "update_retires_the_former_version", "contradiction", "one version stays active once the other is superseded"

    def setup(self, store: MemoryStore) -> None:
        _store(store, self.agent_id, "old", "price plan")
        _store(store, self.agent_id, "new", "price plan", supersedes=["old"])
        store.update_fields(self.agent_id, "old", status="superseded", superseded_by="new")

    def run(self, store: MemoryStore) -> Any:
        return [r["memory_id"] for r in store.list_all(self.agent_id, "active").collect()]

    def score(self, ids: Any) -> float:
        return float(ids == ["new"])


class Found(StoreCase):
    name, category, description = "search_ranks_the_nearest_first", "multihop", "the nearer note has the first rank"

    def setup(self, store: MemoryStore) -> None:
        _store(store, self.agent_id, "near", "api rate limit")
        _store(store, self.agent_id, "far", "api price plan")

    def run(self, store: MemoryStore) -> Any:
        return [r["memory_id"] for r in store.search(self.agent_id, cases.vector("api", "rate", "limit"), 2).collect()]

    def score(self, ids: Any) -> float:
        return float(ids == ["near", "far"])


STORE_CASES: list[type[StoreCase]] = [Touched, Replaced, Found]


@runtime_checkable
class System(Protocol):
    """A system under test, as the behavioural scenarios see it."""

    def reset(self, namespace: str) -> None: ...

    def add_fact(self, namespace: str, mid: str, text: str, embedding: list[float], created_at: Any = None) -> None: ...

    def search(self, namespace: str, embedding: list[float], top_k: int = 5) -> list[dict]: ...

    def retained_count(self, namespace: str) -> int: ...

    def consolidate(self, namespace: str) -> None: ...

    def close(self) -> None: ...


class StoreSystem:
    """This engine; facts raise conflicts when they are added, and ``consolidate`` may settle them."""

    def __init__(self, store: MemoryStore, settle: bool = False):
        self.store, self.settle = store, settle

    def reset(self, namespace: str) -> None:
        ids = [r["memory_id"] for r in self.store.mem(namespace).select("memory_id").collect()]
        if ids:
            self.store.delete_batch(namespace, ids)

    def add_fact(self, namespace: str, mid: str, text: str, embedding: list[float], created_at: Any = None) -> None:
        self.store.store({"agent_id": namespace, "memory_id": mid, "text": text, "embedding": embedding, "created_at": created_at})

    def search(self, namespace: str, embedding: list[float], top_k: int = 5) -> list[dict]:
        return [r.asDict() for r in self.store.search(namespace, embedding, top_k, strict_status=self.settle).collect()]

    def retained_count(self, namespace: str) -> int:
        return self.store.count(namespace, "active")

    def consolidate(self, namespace: str) -> None:
        if self.settle:
            self.store.planner = self.store.planner or rule_planner
            self.store.consolidate(namespace)

    def close(self) -> None:
        self.store.close()


class NaiveSystem:
    """A bare vector store: what is nearest, and nothing else; it has nothing to consolidate."""

    def __init__(self, store: MemoryStore):
        self.store = store

    reset = StoreSystem.reset

    def add_fact(self, namespace: str, mid: str, text: str, embedding: list[float], created_at: Any = None) -> None:
        self.store.store_batch(self.store.frame([{"agent_id": namespace, "memory_id": mid, "text": text, "embedding": embedding}]))

    def search(self, namespace: str, embedding: list[float], top_k: int = 5) -> list[dict]:
        return [r.asDict() | {"conflict_flag": False, "recommended": True} for r in self.store.search(namespace, embedding, top_k).select("memory_id", "score", "rank").collect()]

    def retained_count(self, namespace: str) -> int:
        return self.store.count(namespace)

    def consolidate(self, namespace: str) -> None:
        """Nothing to do."""

    def close(self) -> None:
        self.store.close()
