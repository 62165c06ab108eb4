"""Closed-form and brute-force checks of the reference operators."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from loomary import schema
from loomary.operators import consolidate, health, lineage, records, search

NOW = dt.datetime(2026, 6, 1)


def mem(spark, rows):
    base = {"agent_id": "a", "memory_type": "custom", "text": "t", "status": "active", "importance": 0.5, "access_count": 0, "supersedes": [], "created_at": NOW, "updated_at": NOW, "op": "insert", "embedding": [1.0, 0.0]}
    s = spark.createDataFrame([], schema.MEMORIES).schema
    full = [base | r | {"first_seq": r.get("first_seq", i + 1), "version_seq": i + 1} for i, r in enumerate(rows)]
    return records.memories(spark.createDataFrame([{f.name: r.get(f.name) for f in s.fields} for r in full], s))


def conf(spark, rows):
    base = {"agent_id": "a", "conflict_type": "direct_contradiction", "confidence": 0.95, "description": "d", "resolution_status": "pending", "detected_at": NOW, "op": "insert"}
    s = spark.createDataFrame([], schema.CONFLICTS).schema
    full = [base | r | {"conflict_id": f"c{i}", "first_seq": i + 1, "version_seq": i + 1} for i, r in enumerate(rows)]
    return records.conflicts(spark.createDataFrame([{f.name: r.get(f.name) for f in s.fields} for r in full], s))


def days(n):
    return NOW - dt.timedelta(days=n)


def test_freshness(spark):
    m = mem(spark, [{"memory_id": f"m{i}", "updated_at": days(30 * i), "importance": w} for i, w in enumerate((1.0, 0.5, 0.0))] + [{"memory_id": "x", "status": "archived"}, {"memory_id": "y", "expires_at": days(1)}])
    r = health.freshness(m, F.lit(NOW)).first()
    assert math.isclose(r["freshness_score"], (1 * 1 + 0.5 * 0.5) / 1.5) and r["total_memories"] == 3 and r["stale_count"] == 1 and r["oldest_age_days"] == 60
    zero = health.freshness(mem(spark, [{"memory_id": "m", "updated_at": days(30), "importance": 0.0}]), F.lit(NOW)).first()
    assert math.isclose(zero["freshness_score"], 0.5)


def test_contradiction_and_health(spark):
    m = mem(spark, [{"memory_id": "a", "embedding": [1.0, 0.0]}, {"memory_id": "b", "embedding": [1.0, 0.1]}, {"memory_id": "c", "embedding": [0.0, 1.0]}, {"memory_id": "z", "embedding": [0.0, 0.0]}, {"memory_id": "n", "embedding": None}])
    pairs = health.close_pairs(m, F.lit(NOW))
    c = health.contradictions(m, F.lit(NOW), pairs).first()
    assert c["n_valid"] == 3 and math.isclose(c["contradiction_score"], 2 / 3) and math.isclose(c["embedding_coverage"], 3 / 5)
    h = health.health(m, conf(spark, []), F.lit(NOW)).first()
    assert h["conflict_count"] == 1 and math.isclose(h["score"], 0.25 * (1 + 0 + 1 / 3 + 1 - h["confidence_accuracy_gap"]))
    assert health.health(m, conf(spark, [{"memory_a_id": "a", "memory_b_id": "b"}] * 2), F.lit(NOW)).first()["conflict_count"] == 2


def test_strict_and_inclusive_thresholds(spark):
    m = mem(spark, [{"memory_id": "a", "embedding": [1.0, 0.0]}, {"memory_id": "b", "embedding": [0.0, 1.0]}])
    assert health.close_pairs(m, F.lit(NOW), 0.0).count() == 0  # exactly at the cut: not close
    probe = m.filter("memory_id = 'a'").select("agent_id", F.col("first_seq").alias("probe"), "embedding")
    assert search.search_many(m, probe, 5, 0.0).count() == 2  # a search keeps it


def test_loser_rules(spark):
    def lost(a, b):
        m = mem(spark, [{"memory_id": "a", "embedding": [1.0, 0.01]} | a, {"memory_id": "b", "embedding": [0.9, 0.05]} | b])
        p = m.limit(1).select("agent_id", F.lit(0).cast("bigint").alias("probe"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
        out = search.enrich(search.search_many(m, p, 5), m, conf(spark, [{"memory_a_id": "a", "memory_b_id": "b"}])).collect()
        return {r["memory_id"] for r in out if not r["recommended"]}

    assert lost({"status": "flagged"}, {}) == {"a"}
    assert lost({"superseded_by": "b"}, {"created_at": days(1)}) == {"a"}
    assert lost({"created_at": days(1)}, {}) == {"a"}
    assert lost({}, {}) == {"b"}


def test_status_filter_needs_an_open_conflict(spark):
    m = mem(spark, [{"memory_id": "a"}, {"memory_id": "b", "status": "superseded"}])
    p = m.limit(1).select("agent_id", F.lit(0).cast("bigint").alias("probe"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    hits = search.search_many(m, p, 5)
    assert search.enrich(hits, m, conf(spark, [])).count() == 2
    assert search.enrich(hits, m, conf(spark, []), strict_status=True).count() == 1
    assert search.enrich(hits, m, conf(spark, [{"memory_a_id": "x", "memory_b_id": "y"}])).count() == 1


def test_plan_routes(spark):
    m = mem(spark, [{"memory_id": f"m{i}", "created_at": days(20 - i), "importance": i / 10} for i in range(8)] + [{"memory_id": "t1"}, {"memory_id": "t2"}])
    t = "temporal_supersession"
    c = conf(spark, [
        {"memory_a_id": "m1", "memory_b_id": "m0", "conflict_type": t}, {"memory_a_id": "m1", "memory_b_id": "m2", "conflict_type": t}, {"memory_a_id": "m0", "memory_b_id": "m2"},
        {"memory_a_id": "m4", "memory_b_id": "m3", "conflict_type": t, "confidence": 0.8}, {"memory_a_id": "m3", "memory_b_id": "m4", "conflict_type": t, "confidence": 0.85},
        {"memory_a_id": "t1", "memory_b_id": "t2", "conflict_type": t}, {"memory_a_id": "m5", "memory_b_id": "m6", "confidence": 0.5}, {"memory_a_id": "m5", "memory_b_id": "gone"},
    ])
    acts = consolidate.plan(spark, m, c).orderBy("action_seq").collect()
    assert [(a["action_type"], a["tier"], a["source_memory_ids"]) for a in acts] == [
        ("chain_supersede", "auto_merge", ["m0", "m1", "m2"]), ("supersede", "auto_flag", ["m3", "m4"]), ("flag", "human_review", ["t1", "t2"]), ("merge", "auto_merge", ["m0", "m2"]), ("flag", "human_review", ["m5", "m6"]),
    ]
    a = spark.createDataFrame(acts)
    assert consolidate.preflight(a, m, c).count() == 0 and [r["conflict_id"] for r in consolidate.skipped(m, c).collect()] == ["c7"]
    changed, merged = consolidate.effects(a, m)
    e = {r["memory_id"]: r for r in changed.collect()}
    assert e["m1"]["superseded_by"] == "m2" and e["m0"]["status"] == "archived" and e["m0"]["superseded_by"] == e["m2"]["superseded_by"] == merged.first()["memory_id"]
    assert e["m2"]["supersedes"] == ["m0", "m1"] and "t1" not in e and merged.first()["importance"] == 0.2 and merged.first()["text"] == "d"
    res = {r["conflict_id"]: r["resolution_status"] for r in consolidate.resolved(a, c).collect()}
    assert res == {"c0": "auto_resolved", "c1": "auto_resolved", "c2": "auto_resolved", "c4": "auto_resolved", "c5": "pending", "c6": "pending"}
    assert {r["memory_id"] for r in consolidate.effects(a, m, respect_tier=True)[0].collect()} == {"m0", "m1", "m2", "m3", "m4"}


def test_lineage_against_walk(spark):
    r = random.Random(11)
    for _ in range(3):
        ids = [f"m{i:02}" for i in range(14)]
        rows = [{"memory_id": i, "created_at": days(r.randrange(9)), "superseded_by": r.choice([*ids, None, "gone"]), "supersedes": [r.choice(ids)] if r.random() < 0.5 else []} for i in ids]
        by = {x["memory_id"]: x for x in rows}

        def walk(start, by=by):
            back, seen, n = [], {start}, start
            while True:
                nxt = [p for p in by[n]["supersedes"] if p in by and p not in seen]
                if not nxt:
                    break
                n = nxt[0]
                seen.add(n)
                back.append(n)
            ahead, n = [], start
            while by[n]["superseded_by"] in by and by[n]["superseded_by"] not in seen:
                n = by[n]["superseded_by"]
                seen.add(n)
                ahead.append(n)
            return back[::-1] + [start] + ahead

        got = {x["memory_id"]: x["chain"] for x in lineage.lineage(spark, mem(spark, rows)).collect()}
        assert got == {i: walk(i) for i in ids}


def test_quarantine(spark):
    rows = spark.createDataFrame([("a", "m1", " m1 ", "direct_contradiction", 0.5, "x"), ("a", "m1", "m2", "direct_contradiction", float("nan"), None), ("a", "m1", "m2", "partial_conflict", 1.0, "x")], "agent_id string, memory_a_id string, memory_b_id string, conflict_type string, confidence double, description string")
    rules = {k: v for k, v in schema.conflict_rules().items() if not k.startswith("resolved")}
    good, bad = schema.quarantine(rows, rules)
    assert good.count() == 1 and sorted(r["broken_rules"] for r in bad.collect()) == [["confidence_in_range", "description_not_blank"], ["ids_differ"]]
