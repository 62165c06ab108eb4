import random

from conftest import frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomary.operators import hierarchy

LINKS = "agent_id string, child string, parent string"


def brute(links):
    out = {}
    for c in links:
        seen, n = [], c
        while n in links and n not in seen:
            seen.append(n)
            n = links[n]
        out[c] = (min(seen[seen.index(n) :]), -1) if n in seen else (n, len(seen))
    for root, d in list(out.values()):
        if d >= 0:
            out[root] = (root, 0)
    return out


def solve(spark, links, **kw):
    df = frame(spark, LINKS, [("a", c, p) for c, p in links.items()])
    return {r["node"]: (r["root_id"], r["depth"]) for r in hierarchy.resolve(spark, df, **kw).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 40).map(lambda i: f"n{i:02}"), st.integers(0, 40).map(lambda i: f"n{i:02}"), max_size=40))
def test_any_links_in_small_chunks(spark, links):
    assert solve(spark, links, chunk_links=5) == brute(links)


def test_long_chain_and_cycle_over_chunks(spark):
    links = {f"c{i:03}": f"c{i + 1:03}" for i in range(120)}
    links |= {f"r{i:02}": f"r{(i + 1) % 30:02}" for i in range(30)} | {"t": "r07", "self": "self"}
    assert solve(spark, links, chunk_links=9) == brute(links)
    assert solve(spark, links) == brute(links)


def test_paths_and_descendants(spark):
    df = frame(spark, LINKS, [("a", "x", "y"), ("a", "y", "z"), ("a", "w", "y"), ("b", "x", "q")])
    nodes = hierarchy.resolve(spark, df, paths=True, chunk_links=1)
    assert {(r["agent_id"], r["node"]): r["path"] for r in nodes.collect()}[("a", "x")] == ["z", "y", "x"]
    below = {(r["agent_id"], r["memory_id"], r["descendant_id"], r["distance"]) for r in hierarchy.descendants(nodes).collect()}
    assert below == {("a", "z", "y", 1), ("a", "z", "x", 2), ("a", "z", "w", 2), ("a", "y", "x", 1), ("a", "y", "w", 1), ("b", "q", "x", 1)}


def test_no_links_and_nulls(spark):
    assert solve(spark, {}) == {}
    df = frame(spark, LINKS, [("a", None, "b"), (None, "c", "d"), ("a", "c", None)])
    assert hierarchy.resolve(spark, df).count() == 0


def test_parents_of_memories(spark):
    ddl = "agent_id string, memory_id string, superseded_by string, supersedes array<string>, version_seq bigint, op string, node string"
    rows = [
        ("a", " M1", "m2 ", None, 1, "insert", "x"), ("a", "m2", None, None, 2, "insert", "x"), ("a", "m2", None, None, 2, "insert", "x"),
        ("a", "m3", None, ["M1", "m4", None], 3, "insert", "x"), ("a", "m4", "gone", [], 4, "insert", "x"), ("a", "gone", None, None, 5, "delete", "x"),
        ("b", "m1", "m2", None, 6, "insert", "x"), ("a", None, "m2", None, 7, "insert", "x"),
    ]
    ddl, rows = ddl + ", first_seq bigint", [(*r, r[4]) for r in rows]
    links = {(r["agent_id"], r["child"], r["parent"]) for r in hierarchy.memory_links(frame(spark, ddl, rows)).collect()}
    assert links == {("a", "m1", "m2"), ("a", "m4", "m3")}


def test_forests_merge_hierarchically_along_a_locality(spark):
    r = random.Random(4)
    n, parent = 6_000, {}
    for i in range(n):
        up = i + r.randrange(1, 8)
        if up < n and r.random() < 0.97:
            parent[f"n{i:05}"] = f"n{up:05}"
    parent |= {f"n{i:05}": f"n{i + 1500:05}" for i in (10, 1510, 3010)} | {"n04510": "n00010"}  # a circle over many chunks
    rows = [("a", c, p, int(c[1:])) for c, p in parent.items()] + [("b", "x", "y", None)]
    seen = []
    got = hierarchy.resolve(spark, frame(spark, LINKS + ", at bigint", rows), chunk_links=200, seen=seen).collect()
    assert {(x["agent_id"], x["node"]): (x["root_id"], x["depth"]) for x in got} == {("a", k): v for k, v in brute(parent).items()} | {("b", "x"): ("y", 1), ("b", "y"): ("y", 0)}
    inner = len(set(parent.values()) & set(parent))
    assert seen and seen[0] <= inner / 10


def test_paths_over_levels(spark):
    links = {f"c{i:03}": f"c{i + 1:03}" for i in range(100)} | {"side": "c050", "p": "q", "q": "p", "t": "p"}
    rows = [("a", c, p, int(c[1:]) if c[1:].isdigit() else 50) for c, p in links.items()]
    got = {x["node"]: x["path"] for x in hierarchy.resolve(spark, frame(spark, LINKS + ", at bigint", rows), paths=True, chunk_links=8).collect()}
    assert got["c000"] == [f"c{i:03}" for i in range(100, -1, -1)] and got["side"] == [f"c{i:03}" for i in range(100, 49, -1)] + ["side"]
    assert got["t"] is None and got["p"] is None
