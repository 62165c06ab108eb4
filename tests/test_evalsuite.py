import time

import pytest
from pyspark.sql import functions as F

from loomary import cli
from loomary.evalsuite import cases, lifecycle, runner, scenarios
from loomary.operators import evaluate, search
from loomary.sources.store import MemoryStore


def test_fifty_cases(spark):
    r = runner.run(spark).cache()
    # The published scores.
    o = evaluate.overall(r).first()
    assert (o["overall"], o["risk"], o["n_passed"], o["n_cases"]) == (0.88, "low", 44, 50)
    got = {x["category"]: x["score"] for x in evaluate.category_scores(r).collect()}
    assert got == {"temporal": 1.0, "contradiction": 0.9, "multihop": 1.0, "importance": 0.5, "cross_type": 1.0}
    assert "passed 44 of 50" in runner.report(r)


def test_naive_store_fails_most(spark):
    r = runner.run(spark, view=runner.naive).cache()
    o = evaluate.overall(r).first()
    # The published scores of a bare vector store.
    assert (o["overall"], o["risk"], o["n_passed"]) == (0.4207, "critical", 20)
    assert {x["category"]: x["score"] for x in evaluate.category_scores(r).collect()} == {"temporal": 0.05, "contradiction": 0.5, "multihop": 1.0, "importance": 0.22, "cross_type": 0.3333}
    d = runner.document(r, "naive", "2026-01-01")
    assert d["overall_score"] == 0.4207 and [c["category"] for c in d["categories"]] == list(cases.CATEGORIES) and sum(len(c["results"]) for c in d["categories"]) == 50


def test_importance_aware_order(spark):
    r = runner.run(spark, {"importance"}, rerank=lambda h, m: search.by_importance(h, m, F.lit(cases.AS_OF), 0.5))
    assert evaluate.category_scores(r).first()["score"] == 1.0


def test_scenarios(spark):
    mean = lambda mode: evaluate.dimensions(scenarios.run(spark, mode)).first()["score"]
    assert mean("naive") < mean("detect") == mean("consolidate") == 1.0


class Broken(lifecycle.StoreCase):
    name, category, description = "broken", "temporal", "fails where it is told to"

    def __init__(self, where="run", wait=0.0):
        self.where, self.wait, self.cleaned = where, wait, False

    def setup(self, store):
        self._phase("setup")

    def run(self, store):
        self._phase("run")
        return 1.0

    def score(self, result):
        return result

    def teardown(self, store):
        self.cleaned = True
        self._phase("teardown")

    def _phase(self, name):
        if name == self.where:
            time.sleep(self.wait)
            if not self.wait:
                raise RuntimeError("no")


def test_phases_of_a_case():
    for where, wait, error, cleaned in (("setup", 0, "setup: no", False), ("run", 0, "no", True), ("teardown", 0, None, True), ("setup", 1.0, "setup: timed out after 0.2s", False), ("run", 1.0, "run: timed out after 0.2s", True)):
        c = Broken(where, wait)
        row = lifecycle.run_case(c, None, 0.2)
        assert row[5] == error and c.cleaned == cleaned and row[4] == (error is None)
    with pytest.raises(TypeError):
        type("NoName", (lifecycle.StoreCase,), {})


def test_cases_and_systems_on_a_store(spark, tmp_path):
    store = MemoryStore(spark, f"{tmp_path}/s", classifier=scenarios.newer_wins)
    r = lifecycle.run_all(spark, [c() for c in lifecycle.STORE_CASES], store).collect()
    assert [x["score"] for x in r] == [1.0, 1.0, 1.0] and store.mem().count() == 0
    with pytest.raises(ValueError):
        lifecycle.run_all(spark, [lifecycle.Touched(), lifecycle.Touched()], store)
    one, bare = lifecycle.StoreSystem(store, settle=True), lifecycle.NaiveSystem(MemoryStore(spark, f"{tmp_path}/n"))
    v = cases.vector("api", "rate")
    for s in (one, bare):
        assert isinstance(s, lifecycle.System)
        for day, mid in enumerate(("old", "new")):
            s.add_fact("n", mid, f"limit {day}", v, cases.T0 + cases.dt.timedelta(days=day))
        s.consolidate("n")
    assert one.retained_count("n") == 1 and bare.retained_count("n") == 2
    assert [h["memory_id"] for h in one.search("n", v) if h["recommended"]][:1] != ["old"] and all(h["recommended"] for h in bare.search("n", v))
    one.reset("n")
    assert one.retained_count("n") == 0


def test_comparison_and_weights(spark, tmp_path):
    both = runner.run(spark).withColumn("system", F.lit("spark")).unionByName(runner.run(spark, view=runner.naive).withColumn("system", F.lit("naive"))).cache()
    s = evaluate.by_system(both).cache()
    h = evaluate.headline(s, "naive").first()
    assert (h["n_systems"], round(h["gap"], 4), h["spread"], round(h["category_gap"], 4)) == (1, round(0.88 - 0.42067, 4), 0.0, 0.95)
    text = evaluate.table_of(s).splitlines()
    assert text[1].startswith("spark") and "44/50" in text[1] and "20/50" in text[2]
    assert evaluate.score_map(both.filter("system = 'spark'")).first()["scores"]["importance"] == 0.5
    none = both.limit(0)
    assert tuple(evaluate.overall(none).first()) == (0.0, "critical", 0, 0)
    with pytest.raises(Exception, match="add up to more than zero"):
        evaluate.overall(both, {c: 0.0 for c in cases.CATEGORIES}).collect()
    (tmp_path / "a_track.json").write_text("[1]")
    (tmp_path / "b_track.json").write_text("[2]")
    assert cli.newest_result(str(tmp_path), "_track.json") == [2]
