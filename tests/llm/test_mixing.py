import random

import pytest

from loomary.llm import mixing
from loomary.llm.mixing import Node, budgets, mix, shares

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TARGETS = "source string, target_share double, max_repeats bigint"


def tree(leaves):
    root = Node()
    for path, (w, c) in leaves.items():
        root.add(path, w, c)
    return root


def spent(root, total):
    root.spend(total)
    return {"/".join(p): n.budget for p, n in root.leaves()}


def test_shortage_goes_to_siblings_before_ancestors():
    got = spent(tree({("a", "x"): (0.25, 10), ("a", "y"): (0.25, 1000), ("b", "z"): (0.5, 1000)}), 400)
    assert got == {"a/x": 10, "a/y": 190, "b/z": 200}
    got = spent(tree({("a", "x"): (0.25, 10), ("a", "y"): (0.25, 20), ("b",): (0.3, 1000), ("c",): (0.2, 1000)}), 130)
    assert got == pytest.approx({"a/x": 10, "a/y": 20, "b": 60, "c": 40})
    # four levels: what a language can't supply goes to its domain's other language, then to the other domain
    deep = {("d", "en", "s", "u"): (0.2, 5), ("d", "en", "t", "u"): (0.2, 5), ("d", "de", "s", "u"): (0.1, 60), ("e", "en", "s", "u"): (0.5, 900)}
    assert spent(tree(deep), 100) == pytest.approx({"d/en/s/u": 5, "d/en/t/u": 5, "d/de/s/u": 40, "e/en/s/u": 50})
    assert spent(tree(deep), 200) == pytest.approx({"d/en/s/u": 5, "d/en/t/u": 5, "d/de/s/u": 60, "e/en/s/u": 130})


def test_largest_total_meets_all_shares():
    got = budgets({("d", "en", "a"): 30, ("d", "de", "a"): 30, ("d", "en", "b"): 1000}, 2, {"a": (0.6, 1), "b": (0.2, 1), "none": (0.2, 9)})
    assert got == {("d", "en", "a"): pytest.approx((30, 30)), ("d", "de", "a"): pytest.approx((30, 30)), ("d", "en", "b"): pytest.approx((20, 1000))}
    assert budgets({}, 0, {"a": (0.5, 1)}) == {} and budgets({("a",): 5}, 0, {"a": (0.5, None)}) == {}


def corpus(n=600):
    r = random.Random(7)
    return [(i, "lorem ipsum " * r.randrange(1, 40), r.choice(["en", "DE", "de-AT", None]), r.choice(["chat", "CHAT ", "kb-page", "kb_page", "rare", None]), 1) for i in range(n)]


def test_shares_are_met(spark):
    docs = spark.createDataFrame([*corpus(), (9001, None, "en", "chat", 1), (9002, "", "en", "chat", 1), (0, corpus()[0][1], "en", corpus()[0][3], 1)], DOCS)
    targets = spark.createDataFrame([("chat", 0.3, 1), ("kb_page", 0.3, 2), ("rare", 0.3, 3), ("missing", 0.1, 2)], TARGETS)
    rows = mix(spark, docs, targets, seed=3).collect()
    by = {r["source"]: r for r in shares(spark.createDataFrame(rows), targets).collect()}
    for s in ("chat", "kb_page", "rare"):
        assert abs(by[s]["actual_share"] - 1 / 3) < 0.01
    assert by["chat"]["most_used"] == 1 and by["kb_page"]["most_used"] <= 2 and by["rare"]["most_used"] <= 3 and by["missing"]["n_tokens"] == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(spark, docs, targets, seed=3).collect()))
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_prefix_is_the_longest_that_fits(spark):
    docs = spark.createDataFrame([(i, "word " * 5, "en", "a", 1) for i in range(2000)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 5)], TARGETS)
    one = mixing.sized_documents(spark, docs, targets).first()["n_tokens"]
    for want in (0.4, 1.0, 2.35):
        total = want * one * 2000
        got = mix(spark, docs, targets, total=total).collect()
        assert sum(r["repeats"] for r in got) == int(total // one)


def test_a_given_total_runs_short_and_rests_are_pooled(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("chat", 0.3, 1), ("kb_page", 0.2, 2), ("rare", 0.5, 2)], TARGETS)
    domains = {"chat": "talk", "rare": "talk"}
    sized = [r.asDict() for r in mixing.sized_documents(spark, docs, targets, domains=domains).collect()]
    leaves, n = {}, {}
    for r in sized:
        k = (r["domain"], r["lang"], r["source"])
        leaves[k] = leaves.get(k, 0) + r["n_tokens"]
        n[r["doc_id"]] = r["n_tokens"]
    all_ = sum(leaves.values())
    want = budgets(leaves, 2, {"chat": (0.3, 1), "kb_page": (0.2, 2), "rare": (0.5, 2)}, 1.2 * all_)
    got = mix(spark, docs, targets, corpora=1.2, domains=domains, seed=5).collect()
    took, source = {}, {}
    for r in got:
        took[r["domain"], r["lang"], r["source"]] = took.get((r["domain"], r["lang"], r["source"]), 0) + r["repeats"] * r["n_tokens"]
        source[r["source"]] = source.get(r["source"], 0) + r["repeats"] * r["n_tokens"]
    assert took.keys() == {k for k, (b, _) in want.items() if b}
    largest = max(n.values())
    for k, t in took.items():
        assert t <= want[k][1] and t <= want[k][0] + 5 * largest
    for s in source:  # less than a document of each source is left, whatever its languages
        budget = sum(b for k, (b, _) in want.items() if k[2] == s)
        assert budget - largest < source[s] <= budget + 1e-6
    assert source["rare"] < 0.5 * 1.2 * all_ - largest  # it is short
    other = mix(spark, docs, targets, corpora=1.2, levels=("source", "lang")).count()
    assert other > 0


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 5)], TARGETS)
    assert mix(spark, none, targets).count() == 0
    assert mix(spark, spark.createDataFrame(corpus(20), DOCS), spark.createDataFrame([], TARGETS)).count() == 0
