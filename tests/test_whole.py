"""Whole jobs: results that a cut, a cap or a sample would make smaller."""

import random

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F
from test_reference import mem

from loomary.operators import detect, health, similarity
from loomary.plans import reference


def test_threshold_search_has_no_cap(spark, tmp_path):
    rows = [(i, [1.0, i / 10_000]) for i in range(1_500)] + [(9_999, [-1.0, 0.0])]
    frame(spark, "vec_id bigint, embedding array<float>", rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["probe"], r["id"]) for r in reference.knn_threshold(spark, str(tmp_path)).collect()}
    assert got == {(p, i) for p in range(0, 1_500, 20) for i in range(1_500)}
    df = frame(spark, "scope string, id bigint, vec array<double>", [("s", 1, [1.0])])
    with pytest.raises(ValueError):
        similarity.nearest(df, df, None)


def sure(pairs):
    return pairs.withColumns({"verdict": F.lit("direct_contradiction"), "confidence": F.lit(0.9), "summary": F.lit("s")})


def test_later_memories_take_no_places_of_earlier_ones(spark, monkeypatch):
    rows = [{"memory_id": f"m{i:02}", "embedding": [1.0, 0.3 if i < 3 else 0.01 if i > 3 else 0.0]} for i in range(40)]
    m = mem(spark, rows)
    new = m.filter("memory_id = 'm03'")
    found = {r["memory_b_id"] for r in detect.on_store(new, m, sure, 0.9).collect()}
    assert found == {"m00", "m01", "m02"}
    monkeypatch.setattr(similarity, "BLOCK", 7)
    r = random.Random(3)
    vecs = [[1.0, r.random(), r.random()] for _ in range(60)]
    m = mem(spark, [{"memory_id": f"m{i:02}", "embedding": v} for i, v in enumerate(vecs)])
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = set()
    for i, v in enumerate(vecs):  # the search at the time of each store: itself and 20 others
        best = sorted((-cos(v, w), j) for j, w in enumerate(vecs[: i + 1]) if cos(v, w) >= 0.9)[:21]
        want |= {(f"m{i:02}", f"m{j:02}") for _, j in best if j != i}
    got = [(x["memory_a_id"], x["memory_b_id"]) for x in detect.on_store(m, m, sure, 0.9).collect()]
    assert set(got) == want and len(got) == len(want)


def test_registered_queries_do_the_whole_job(spark, data):
    m = reference._mem(spark, data, "embedding", "first_seq")
    want = {(r["agent_id"], r["memory_a_id"], r["memory_b_id"]) for r in detect.on_store(m, m, similarity=0.82).collect()}
    assert {(r["agent_id"], r["memory_a_id"], r["memory_b_id"]) for r in reference.store_conflicts(spark, data).collect()} == want
    assert min(r["similarity"] for r in reference.candidate_pairs(spark, data).collect()) < 0.95
    n = reference._mem(spark, data, "embedding", "status", "expires_at").filter("status = 'active'").count()
    assert 0 < sum(r["n_probed"] for r in reference.confidence_gap(spark, data).collect()) <= n


def test_gap_of_all_probes(spark):
    r = random.Random(8)
    m = mem(spark, [{"memory_id": f"m{i:03}", "embedding": [r.random(), r.random()]} for i in range(120)])
    gap = lambda n: health.confidence_gap(m, F.lit("2026-06-01").cast("timestamp"), health.HealthConfig(probes=n)).first()
    assert gap(None)["n_probed"] == 120 and gap(50)["n_probed"] == 50
    assert gap(None)["confidence_accuracy_gap"] == pytest.approx(gap(1000)["confidence_accuracy_gap"])
