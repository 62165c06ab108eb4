"""Fifty small cases of what a memory store must keep, count and find again.

Each case is one tenant: versions to write, and what must then hold.  A check returns the share of
its expectations that hold.  Vectors are keyword vectors, so similarity is known in advance.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

# The words of the keyword vectors, and below the names of the cases.
VOCABULARY = ["refund", "policy", "return", "window", "api", "rate", "limit", "request", "password", "security", "requirement", "expire", "price", "plan", "subscription", "days"]
T0 = dt.datetime(2026, 1, 1)
AS_OF = dt.datetime(2026, 6, 1)


def vector(*words: str) -> list[float]:
    v = [1.0 if w in words else 0.0 for w in VOCABULARY]
    n = math.sqrt(sum(v))
    return [x / n for x in v] if n else v


@dataclass
class Case:
    name: str
    category: str
    rows: list[dict]
    checks: list[tuple]
    pass_threshold: float = 0.7

    @property
    def agent_id(self) -> str:
        return f"eval_{self.category}_{self.name}"


def m(mid: str, words: str = "", **kw) -> dict:
    """One written version of memory ``mid``."""
    return {"memory_id": mid, "text": kw.pop("text", f"note {mid} on {words or 'nothing'}"), "embedding": vector(*words.split()) if words else None} | kw


def _gone(mid: str, words: str, by: str, **kw) -> list[dict]:
    """A memory and its later version, superseded."""
    return [m(mid, words, **kw), m(mid, words, status="superseded", superseded_by=by, **kw)]


P = {"source_type": "api", "source_id": "feed-1", "ingested_at": T0}
OLD, SOON = T0 - dt.timedelta(days=30), AS_OF + dt.timedelta(days=30)

TEMPORAL = [
    Case("newer_version_active", "temporal", [*_gone("v1", "refund policy", "v2"), m("v2", "refund policy", supersedes=["v1"])], [("active", {"v2"})]),
    Case("superseded_excluded_from_active", "temporal", [*_gone("v1", "price plan", "v2"), m("v2", "price plan")], [("active", {"v2"})]),
    Case("three_versions_only_latest_active", "temporal", [*_gone("v1", "rate limit", "v2"), *_gone("v2", "rate limit", "v3"), m("v3", "rate limit")], [("active", {"v3"})]),
    Case("supersedes_link_recorded", "temporal", [*_gone("v1", "api", "v2"), m("v2", "api", supersedes=["v1"])], [("field", "v2", "supersedes", ["v1"])]),
    Case("superseded_by_link_recorded", "temporal", _gone("v1", "api", "v2") + [m("v2", "api")], [("field", "v1", "superseded_by", "v2")]),
    Case("importance_field_roundtrips", "temporal", [m("x", "api", importance=0.83)], [("field", "x", "importance", 0.83)]),
    Case("expiration_detectable", "temporal", [m("old", "days", expires_at=OLD), m("new", "days", expires_at=SOON)], [("expired", "old", True), ("expired", "new", False)]),
    Case("access_tracking_persists", "temporal", [m("x", "api"), m("x", "api", access_count=1, last_accessed=T0)], [("field", "x", "access_count", 1)]),
    Case("provenance_roundtrips", "temporal", [m("x", "api", provenance=P)], [("source", "x", "api"), ("ingested", "x", T0)]),
    Case("updated_at_preserved_on_roundtrip", "temporal", [m("x", "api", updated_at=OLD)], [("field", "x", "updated_at", OLD)]),
]
CONTRADICTION = [
    Case("both_claims_active_is_contradiction", "contradiction", [m("a", "api rate limit"), m("b", "api rate limit")], [("n_active", 1)], 0.5),
    Case("resolved_contradiction_has_one_active", "contradiction", [*_gone("a", "api rate limit", "b"), m("b", "api rate limit", supersedes=["a"])], [("active", {"b"})]),
    Case("embedding_fidelity_high_precision", "contradiction", [m("a", "api rate limit")], [("same_vector", "a", vector("api", "rate", "limit"))]),
    Case("three_claims_one_active", "contradiction", [*_gone("a", "price", "c"), *_gone("b", "price", "c"), m("c", "price")], [("n_active", 1)]),
    Case("flagged_status_persistable", "contradiction", [m("a", "price", status="flagged")], [("listed", "flagged", {"a"})]),
    Case("contradiction_detectable_via_search", "contradiction", [m("a", "price plan"), m("b", "price plan")], [("finds", "price plan", 10, 0.0, {"a", "b"})]),
    Case("supersession_links_intact", "contradiction", [*_gone("a", "price", "b"), m("b", "price", supersedes=["a"])], [("field", "a", "superseded_by", "b"), ("field", "b", "supersedes", ["a"])]),
    Case("embedding_fidelity_distinct", "contradiction", [m("a", "api"), m("b", "price")], [("apart", "a", "b", 0.05)]),
    Case("resolution_reduces_active_count", "contradiction", [*_gone("a", "days", "c"), *_gone("b", "days", "c"), m("c", "days")], [("n_active", 1), ("count", "superseded", 2)]),
    Case("all_conflicting_claims_searchable", "contradiction", [m(x, "password security") for x in "abc"], [("finds", "password security", 10, 0.0, set("abc"))]),
]
MULTIHOP = [
    Case("related_facts_all_retrievable", "multihop", [m("a", "refund policy"), m("b", "refund window"), m("c", "refund return")], [("finds", "refund", 10, 0.1, set("abc"))]),
    Case("partial_query_surfaces_related", "multihop", [m("a", "api rate limit request")], [("finds", "api rate", 10, 0.1, {"a"})]),
    Case("relevance_ranking_correct", "multihop", [m("much", "api rate limit"), m("less", "api price plan")], [("first", "api rate limit", "much")]),
    Case("topic_isolation_by_threshold", "multihop", [m("on", "password security"), m("off", "price plan")], [("exactly", "password security", 10, 0.5, {"on"})]),
    Case("two_hop_bridge_reachable", "multihop", [m("s", "refund policy"), m("b", "policy price"), m("e", "price plan")], [("hops", ["refund policy", "price plan"], {"s", "b", "e"})]),
    Case("all_versions_surfaced_by_search", "multihop", [*_gone("a", "days", "b"), m("b", "days")], [("finds", "days", 10, 0.0, {"a", "b"})]),
    Case("chained_facts_three_hop_surface", "multihop", [m("a", "api rate"), m("b", "rate limit"), m("c", "limit request"), m("d", "request days")], [("hops", ["api rate", "limit request"], set("abcd"))]),
    Case("high_threshold_captures_exact_matches", "multihop", [m("a", "price plan subscription")], [("finds", "price plan subscription", 10, 0.99, {"a"})]),
    Case("orthogonal_query_returns_empty", "multihop", [m("a", "api rate")], [("exactly", "password security", 10, 0.99, set())]),
    Case("cross_cluster_bridged_retrieval", "multihop", [m("x", "api"), m("bridge", "api password"), m("y", "password")], [("hops", ["api", "password"], {"x", "bridge", "y"})]),
]
IMPORTANCE = [
    Case("importance_roundtrip", "importance", [m("x", "api", importance=0.91)], [("field", "x", "importance", 0.91)]),
    Case("importance_default_in_range", "importance", [m("x", "api")], [("between", "x", "importance", 0.0, 1.0)]),
    Case("importance_update_persists", "importance", [m("x", "api", importance=0.2), m("x", "api", importance=0.7)], [("field", "x", "importance", 0.7)]),
    Case("importance_not_used_in_search_filter", "importance", [m("hi", "api", importance=0.9), m("lo", "api", importance=0.1)], [("finds", "api", 10, 0.0, {"hi", "lo"})]),
    Case("multiple_importance_levels_all_preserved", "importance", [m(f"x{i}", "api", importance=i / 10) for i in range(1, 10, 2)], [("field", f"x{i}", "importance", i / 10) for i in range(1, 10, 2)]),
    Case("high_importance_ranks_above_low", "importance", [m("lo", "api rate", importance=0.1), m("hi", "api rate limit", importance=1.0)], [("first", "api rate", "hi")]),
    Case("top_k_sorted_by_importance", "importance", [m("lo", "api rate", importance=0.1), m("h1", "api rate limit", importance=1.0), m("h2", "api rate price", importance=0.9)], [("exactly", "api rate", 2, 0.0, {"h1", "h2"})]),
    Case("access_count_boosted_retrieval", "importance", [m("cold", "api rate"), m("used", "api rate limit", access_count=5, last_accessed=AS_OF)], [("first", "api rate", "used")]),
    Case("recently_accessed_surfaces", "importance", [m("cold", "price", last_accessed=OLD), m("used", "price plan", last_accessed=AS_OF)], [("first", "price", "used")]),
    Case("recency_breaks_importance_tie", "importance", [m("cold", "days", importance=0.7, last_accessed=OLD), m("used", "days window", importance=0.7, last_accessed=AS_OF)], [("first", "days", "used")]),
]
CROSSTYPE = [
    Case("active_and_superseded_count_correct", "cross_type", [*_gone("a", "api", "b"), m("b", "api")], [("count", "active", 1), ("count", "superseded", 1)]),
    Case("all_four_statuses_storable", "cross_type", [m(s, "api", status=s) for s in ("active", "superseded", "flagged", "archived")], [("count", s, 1) for s in ("active", "superseded", "flagged", "archived")]),
    Case("provenance_and_supersession_combined", "cross_type", [m("b", "api", provenance=P, supersedes=["a"])], [("source", "b", "api"), ("field", "b", "supersedes", ["a"])]),
    Case("expiry_and_importance_both_preserved", "cross_type", [m("x", "api", expires_at=SOON, importance=0.66)], [("field", "x", "expires_at", SOON), ("field", "x", "importance", 0.66)]),
    Case("supersession_chain_with_provenance", "cross_type", [*_gone("a", "api", "b", provenance=P), m("b", "api", provenance=P, supersedes=["a"])], [("source", "a", "api"), ("source", "b", "api"), ("field", "a", "superseded_by", "b"), ("field", "b", "supersedes", ["a"])]),
    Case("search_returns_all_statuses_by_default", "cross_type", [m("a", "api"), m("b", "api", status="archived"), m("c", "api", status="flagged")], [("finds", "api", 10, 0.0, set("abc"))]),
    Case("expired_memory_still_searchable", "cross_type", [m("x", "api", expires_at=OLD)], [("finds", "api", 10, 0.0, {"x"})]),
    Case("touch_only_changes_access_fields", "cross_type", [m("x", "api", importance=0.4), m("x", "api", importance=0.4, access_count=1, last_accessed=T0)], [("field", "x", "access_count", 1), ("field", "x", "importance", 0.4), ("field", "x", "status", "active")]),
    Case("memory_type_coexist_all_searchable", "cross_type", [m(t, "api", memory_type=t) for t in ("conversation", "skill", "custom")], [("finds", "api", 10, 0.0, {"conversation", "skill", "custom"})]),
    Case("all_optional_fields_roundtrip", "cross_type", [m("x", "api", importance=0.3, expires_at=SOON, provenance=P, supersedes=["w"])], [("field", "x", "importance", 0.3), ("field", "x", "expires_at", SOON), ("source", "x", "api"), ("field", "x", "supersedes", ["w"])]),
]
ALL = [*TEMPORAL, *CONTRADICTION, *MULTIHOP, *IMPORTANCE, *CROSSTYPE]
CATEGORIES = ("temporal", "contradiction", "multihop", "importance", "cross_type")


@dataclass
class Seen:
    """What a store gives back for one case."""

    memories: dict[str, dict]
    hits: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    #: Whether a listing by status gives only those; a bare vector store gives all.
    by_status: bool = True


def queries(case: Case) -> list[str]:
    out = []
    for c in case.checks:
        if c[0] in ("finds", "exactly", "first"):
            out.append(c[1])
        elif c[0] == "hops":
            out += c[1]
    return out


def _cos(a, b) -> float:
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def holds(check: tuple, seen: Seen) -> bool:
    kind, mem = check[0], seen.memories
    active = {k for k, r in mem.items() if r["status"] == "active"}
    found = lambda q, k, t: [i for i, s in seen.hits[q] if s >= t][:k]
    if kind == "active":
        return active == check[1]
    if kind == "n_active":
        return len(active) == check[1]
    if kind == "listed":
        return check[2] <= {k for k, r in mem.items() if r["status"] == check[1] or not seen.by_status}
    if kind == "count":
        return sum(r["status"] == check[1] for r in mem.values()) == check[2]
    if kind == "finds":
        return check[4] <= set(found(*check[1:4]))
    if kind == "exactly":
        return check[4] == set(found(*check[1:4]))
    if kind == "first":
        return found(check[1], 1, 0.0) == [check[2]]
    if kind == "hops":
        return check[2] <= {i for q in check[1] for i in found(q, 10, 0.1)}
    if kind == "apart":
        return check[1] in mem and check[2] in mem and _cos(mem[check[1]]["embedding"], mem[check[2]]["embedding"]) < check[3]
    r = mem.get(check[1])
    if r is None:
        return False
    if kind == "field":
        return r[check[2]] == check[3]
    if kind == "between":
        return r[check[2]] is not None and check[3] <= r[check[2]] <= check[4]
    if kind == "expired":
        return (r["expires_at"] is not None and AS_OF > r["expires_at"]) == check[2]
    if kind == "source":
        return bool(r["provenance"]) and r["provenance"]["source_type"] == check[2]
    if kind == "ingested":
        return bool(r["provenance"]) and r["provenance"]["ingested_at"] == check[2]
    if kind == "same_vector":
        return r["embedding"] is not None and _cos(r["embedding"], check[2]) > 0.9999
    raise ValueError(kind)


def score(case: Case, seen: Seen) -> float:
    return sum(holds(c, seen) for c in case.checks) / len(case.checks)
