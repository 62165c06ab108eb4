import random
import re

import numpy as np

from loomary.llm import neardup

TEXTS = "scope string, id string, text string, class string"


def brute(rows, t, size):
    sets = {}
    for s, i, x, _ in rows:
        if s and i and x:
            w = re.findall(r"[^\W_]+", x.lower())
            sets[s, i] = set(zip(*[w[k:] for k in range(size)], strict=False))
    out = set()
    for (s, i), a in sets.items():
        for (u, j), b in sets.items():
            if s == u and i < j and a and b and len(a & b) >= t * len(a | b) - 1e-12:
                out.add((s, i, j))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    base = [[r.choice(vocab) for _ in range(r.randrange(1, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((r.choice("pq"), f"{i:03}", " ".join(w), "x"))
    return rows


def solve(spark, rows, t, size):
    got = neardup.similar_pairs(spark, spark.createDataFrame(rows, TEXTS), t, size).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


def test_equals_brute_force(spark):
    for seed, t, size in ((1, 0.5, 3), (2, 0.8, 5), (3, 0.3, 2)):
        rows = corpus(seed)
        assert solve(spark, rows, t, size) == brute(rows, t, size)


def test_light_and_heavy_agree(spark, monkeypatch):
    rows = corpus(4)
    want = brute(rows, 0.5, 3)
    for light_to in (0, 8, 1000):
        monkeypatch.setattr(neardup, "boundary", lambda sizes, t, to=light_to: to)
        assert solve(spark, rows, 0.5, 3) == want


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 3)
    monkeypatch.setattr(neardup, "MEETINGS", 1)
    r = random.Random(6)
    base = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(60):  # one cluster: all shingles are frequent
        w = list(base)
        w[r.randrange(12)] = f"x{i % 9}"
        rows.append(("p", f"{i:03}", " ".join(w), "x"))
    assert solve(spark, rows, 0.5, 3) == brute(rows, 0.5, 3)
    key, entry, side = neardup._blocks(np.arange(5, dtype=np.uint64), np.arange(5), np.full(5, 7.0))
    assert len(key) == 15 and sorted(entry.tolist()) == sorted(list(range(5)) * 3) and set(side.tolist()) == {0, 1, 2}


def test_odd_rows(spark):
    rows = [("p", "a", None, "x"), ("p", "b", "", "x"), ("p", "c", "one two", "x"), ("p", "d", "one two three", "x"), ("p", "e", "ONE  two, three!", "x"), ("q", "f", "one two three", "x"), (None, "g", "one two three", "x"), ("p", "h", "word " * 20000, "x")]
    assert solve(spark, rows, 0.5, 3) == {("p", "d", "e")}
    assert solve(spark, [], 0.5, 3) == set()


def test_groups(spark):
    rows = [("p", "a", "one two three four", "x"), ("p", "b", "one two three four", "x"), ("p", "c", "one two three four five", "x"), ("p", "d", "nothing at all here", "x")]
    got = {r["id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in neardup.similar_groups(spark, spark.createDataFrame(rows, TEXTS), 0.5, 3).collect()}
    assert got == {"a": ("a", 1, "a"), "b": ("a", 1, "a"), "c": ("c", 1, "a"), "d": ("d", 0, "d")}


def test_boundary_follows_cost():
    assert neardup.boundary([(4, 10, 1e6), (40, 10, 1.0)], 0.5) == 4
    assert neardup.boundary([(4, 10, 1.0)], 0.5) == 0
    assert neardup.boundary([], 0.5) == 0


def test_costs_are_summed_over_all_classes(spark):
    long = "concat_ws(' ', " + ", ".join(f"concat('x{k}y', id)" for k in range(12)) + ")"
    texts = spark.range(200_000).selectExpr("'p' AS scope", "cast(id AS string) AS id", f"if(id % 2000 = 0, {long}, concat('a', id, ' b c')) AS text")
    c = neardup.Classes(spark, texts, 3)
    freq = spark.sparkContext.broadcast(neardup._frequencies(c))
    got = {n: (sets, scanned) for n, sets, scanned in neardup._costs(c, freq, 0.5)}
    assert {n: sets for n, (sets, _) in got.items()} == {1: 199_900, 10: 100}
    assert got[1][1] >= 199_900 and got[10][1] >= 800  # a scan reads an entry of each first shingle at least


def test_mix_is_a_bijection_on_samples():
    x = np.arange(10_000, dtype=np.uint64)
    assert len(np.unique(neardup.mix(x))) == len(x)
