import random

from loomary.llm import components

LINKS = "agent_id string, a string, b string, extra int"


def brute(rows):
    boss = {}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for g, a, b, _ in rows:
        if g and a and b and a != b:
            for x in ((g, a), (g, b)):
                boss.setdefault(x, x)
            p, q = find((g, a)), find((g, b))
            boss[max(p, q)] = min(p, q)
    return {x: find(x)[1] for x in boss}


def solve(spark, rows, **kw):
    got = components.connected_groups(spark, spark.createDataFrame(rows, LINKS), **kw).collect()
    out = {(r["agent_id"], r["memory_id"]): r["group_id"] for r in got}
    assert len(out) == len(got)
    return out


def test_random_graphs(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(r.choice("xy"), f"n{r.randrange(40):02}", f"n{r.randrange(40):02}", 1) for _ in range(25 + 10 * seed)]
        assert solve(spark, rows + rows[:5]) == brute(rows)


def test_deep_giant_is_contracted(spark):
    chain = [("x", f"c{i:03}", f"c{i + 1:03}", 1) for i in range(60)] + [("x", "c030", f"s{i}", 1) for i in range(9)] + [("x", "p", "q", 1), ("y", "c001", "c002", 1)]
    assert solve(spark, chain, peel_rounds=2) == brute(chain)
    assert solve(spark, chain, peel_rounds=100) == brute(chain)


def test_nulls_loops_empty(spark):
    rows = [("x", None, "b", 1), (None, "a", "b", 1), ("x", "a", "a", 1)]
    assert solve(spark, rows) == {}
    assert solve(spark, []) == {}


def test_hubs_and_complete_giants(spark, monkeypatch):
    from loomary.operators import graph

    monkeypatch.setattr(graph, "PLAIN", 0)  # minima are written before they are joined
    star = [("x", "hub", f"s{i:03}", 1) for i in range(80)] + [("x", f"p{i}", f"p{i + 1}", 1) for i in range(9)] + [("y", "hub", "s001", 1), ("x", "q", "r", 1)]
    assert solve(spark, star) == brute(star)
    assert solve(spark, star, peel_rounds=0) == brute(star)
