import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomary import bridge, cli, schema
from loomary.operators import detect
from loomary.sources.protocol import Storage
from loomary.sources.store import InvalidRecords, MemoryStore, NotFound

T = dt.datetime(2026, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    with MemoryStore(spark, f"file://{tmp_path}/s", as_of=F.lit(dt.datetime(2026, 2, 1)), similarity=0.82) as s:
        yield s


def row(mid, agent="a1", n=0, **kw):
    return {"agent_id": agent, "memory_id": mid, "text": "the kettle is blue", "embedding": [1.0, 0.0], "created_at": T + dt.timedelta(seconds=n)} | kw


def ids(df):
    return [r["memory_id"] for r in df.collect()]


def test_contract(store):
    assert not store.exists("a1", "x") and store.count("a1") == 0 and ids(store.list_all("a1")) == []
    store.store_batch(store.frame([row("m2", n=2), row("m1", n=1), row("m3", n=3, status="archived"), row("m1", agent="a2", metadata='{"k":"v"}')]))
    assert ids(store.list_all("a1")) == ["m1", "m2", "m3"] and ids(store.list_all("a1", status="archived")) == ["m3"]
    assert ids(store.list_all("a1", limit=1, offset=1)) == ["m2"]
    assert store.count("a1") == 3 and store.count("a1", "active") == 2 and store.count("a2") == 1
    assert sorted(ids(store.fetch_batch("a1", ["m1", "zz"]))) == ["m1"] and ids(store.fetch_batch("a1", [])) == []
    assert ids(store.where("a2", {"k": "v"})) == ["m1"] and ids(store.where("a1", {"k": "v"})) == []
    first = store.fetch("a1", "m1").first()
    store.store_batch(store.frame([row("m1", n=1, text="changed", importance=0.87)]))
    again = store.fetch("a1", "m1").first()
    assert again["text"] == "changed" and again["importance"] == 0.87 and again["first_seq"] == first["first_seq"] and store.count("a1") == 3
    assert store.fetch("a2", "m1").first()["text"] == "the kettle is blue"
    assert store.delete("a1", "m2") and not store.delete("a1", "m2") and not store.delete("a2", "m3")
    assert store.delete_batch("a1", ["m1", "m3", "zz"]) == 2 and store.count("a1") == 0 and store.count("a2") == 1


def test_update_touch_provenance(store):
    store.store_batch(store.frame([row("m1")]))
    with pytest.raises(NotFound):
        store.update(store.frame([row("zz")]))
    store.touch("a1", "m1")
    r = store.fetch("a1", "m1").first()
    assert r["access_count"] == 1 and r["last_accessed"] is not None and r["updated_at"] == T
    store.update_fields("a1", "m1", importance=0.9)
    r = store.fetch("a1", "m1").first()
    assert r["importance"] == 0.9 and r["updated_at"] > T and r["access_count"] == 1
    p = F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in (("record_id", "r", "string"), ("memory_id", "m1", "string"), ("source_type", "api", "string"), ("source_id", None, "string"), ("ingested_by", None, "string"), ("raw_content", None, "string"), ("chunk_index", 0, "int"), ("derived_from", None, "array<string>"), ("ingested_at", None, "timestamp"))])
    store.attach_provenance("a1", "m1", p)
    assert store.provenance_for("a1", "m1").first()["source_type"] == "api" and '"source_id":null' in store.export_provenance_json("a1", "m1")
    with pytest.raises(ValueError):
        store.attach_provenance("a1", "m1", p)


def test_invalid_batches_are_not_written(store, spark):
    for bad in (row("m", text=" "), row("m", embedding=[]), row("m", importance=1.5), row("m", metadata="{"), row("m", superseded_by="m"), row("m", status="odd")):
        with pytest.raises(InvalidRecords):
            store.store_batch(store.frame([bad]))
    assert store.count("a1") == 0
    with pytest.raises(ValueError):
        MemoryStore(spark, "x", vector_size=0)


def test_search(store):
    store.store_batch(store.frame([row("a", embedding=[1.0, 0.01]), row("b", embedding=[0.9, 0.05]), row("c", embedding=[0.0, 1.0]), row("d", embedding=None), row("e", embedding=[-1.0, 0.0])]))
    hits = store.search("a1", [1.0, 0.0]).collect()
    assert [h["memory_id"] for h in hits] == ["a", "b", "c", "e"] and [h["rank"] for h in hits] == [1, 2, 3, 4] and hits[3]["score"] == 0
    assert ids(store.search("a1", [0.0, 1.0], score_threshold=1.0)) == ["c"] and ids(store.search("a1", [1.0, 0.0], top_k=0)) == []
    with pytest.raises(ValueError):
        store.search("a1", [1.0, 0.0], top_k=-1)
    store.store_conflict({"agent_id": "a1", "memory_a_id": "a", "memory_b_id": "b", "conflict_type": "direct_contradiction", "confidence": 0.9, "description": "d"})
    h = {x["memory_id"]: x for x in store.search("a1", [1.0, 0.0]).collect()}
    assert h["a"]["conflict_flag"] and h["a"]["conflicts_with"] == ["b"] and h["a"]["conflict_summary"] == "d" and not h["c"]["conflict_flag"]
    assert h["a"]["recommended"] and not h["b"]["recommended"]  # equal age: the worse rank loses


def test_conflict_records(store):
    base = {"agent_id": "a1", "memory_a_id": "a", "memory_b_id": "b", "conflict_type": "direct_contradiction", "confidence": 0.9, "description": "d"}
    store.store_conflict(base | {"conflict_id": "c1"})
    with pytest.raises(InvalidRecords):
        store.store_conflict(base | {"memory_b_id": " A "})
    assert [r["conflict_id"] for r in store.pending_review("a1").collect()] == ["c1"]
    with pytest.raises(ValueError):
        store.resolve_conflict("a1", "c1", "pending")
    store.resolve_conflict("a1", "c1", "human_reviewed", "ok")
    r = store.fetch_conflict("a1", "c1").first()
    assert r["resolution_status"] == "human_reviewed" and r["resolved_at"] is not None and store.pending_review("a1").count() == 0
    assert store.delete_conflict("a1", "c1") and not store.delete_conflict("a1", "c1")
    with pytest.raises(NotFound):
        store.resolve_conflict("a1", "c1", "human_reviewed")


def newer(pairs):
    return pairs.withColumns({"verdict": F.lit("temporal_supersession"), "confidence": F.lit(0.95), "summary": F.lit("newer")})


def test_scan_plan_consolidate_lineage(store):
    store.classifier = newer
    store.store_batch(store.frame([row(f"v{i}", n=i, embedding=[1.0, i / 100], importance=0.2 + i / 10) for i in range(3)] + [row("p", n=9, embedding=[0.0, 1.0]), row("q", n=8, embedding=[0.01, 1.0], importance=0.9)]))
    assert store.scan_contradictions("a1").count() == 4
    assert store.scan_contradictions("a1").count() == 0  # known pairs are left out
    dry = store.consolidate("a1", dry_run=True).orderBy("action_seq").collect()
    assert [(r["action_type"], r["source_memory_ids"]) for r in dry] == [("chain_supersede", ["v0", "v1", "v2"]), ("supersede", ["q", "p"])] and dry[0]["result_memory_id"] == "v0"
    assert store.count("a1", "superseded") == 0
    done = store.consolidate("a1").orderBy("action_seq").collect()
    assert [r["result_memory_id"] for r in done] == ["v2", "p"]
    m = {r["memory_id"]: r for r in store.mem("a1").collect()}
    assert m["v0"]["status"] == m["v1"]["status"] == "superseded" and m["v0"]["superseded_by"] == "v2" and m["v2"]["supersedes"] == ["v0", "v1"]
    assert m["p"]["importance"] == 0.9 and m["p"]["supersedes"] == ["q"] and m["p"]["updated_at"] == T + dt.timedelta(seconds=9)
    assert store.open_conflicts("a1").count() == 0
    assert store.lineage("a1", "v2") == ["v0", "v2"] and store.lineage("a1", "v1") == ["v1", "v2"] and store.lineage("a1", "zz") == []
    h = store.health("a1").first()
    assert h["total_memories"] == 2 and h["conflict_count"] == 0 and h["contradiction_score"] == 0


def test_detection_on_store(store):
    store.classifier = newer
    store.store(row("m1"))
    found = store.store(row("m2", n=1, embedding=[0.99, 0.01]))
    assert [(r["memory_a_id"], r["memory_b_id"]) for r in found.collect()] == [("m2", "m1")]
    assert store.pending_review("a1").count() == 1


def test_compaction(store, tmp_path, spark):
    store.store_batch(store.frame([row("m1"), row("m2")]))
    store.store_batch(store.frame([row("m1", text="new")]))
    store.delete("a1", "m2")
    store.memories.compact(f"file://{tmp_path}/c/memories")
    small = MemoryStore(spark, f"file://{tmp_path}/c")
    assert small.memories.rows().count() == 1 and small.fetch("a1", "m1").first()["text"] == "new"


def test_chat_and_documents(store):
    chat = bridge.ChatHistory(store, "s1")
    chat.add_messages([("user", "hello"), ("assistant", ["part", 1], {"ok": 1, "bad": object()})])
    assert chat.messages == [("human", "hello", {}), ("ai", ["part", 1], {"ok": 1})]
    assert [(r["turn"], r["role"]) for r in bridge.history(store.mem()).orderBy("turn").collect()] == [(1, "human"), (2, "ai")]
    assert chat.clear() == 2 and chat.messages == []
    with pytest.raises(ValueError):
        chat.add_messages([("user", "  ")])
    docs = bridge.Documents(store, "d1", lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)))
    docs.add_texts(["aa", "bbbbbbbbbbbb"], [{"k": 1}, {"k": 2}], ["x", "y"])
    assert [r["memory_id"] for r in docs.similarity_search("cc", 1).collect()] == ["x"]
    assert [r["memory_id"] for r in docs.similarity_search("cc", filter={"k": 2}).collect()] == ["y"]
    assert docs.delete(["x"]) and not docs.delete(["x"])
    with pytest.raises(ValueError):
        docs.add_texts(["a"], [{}, {}])


def test_cli_config(tmp_path, capsys):
    p = tmp_path / "c.json"
    p.write_text('{"name": "x", "api_key": "s", "in": {"password": "p", "n": 1}}')
    assert cli.main(["show-config", str(p)]) == 0
    assert '"api_key": "***"' in capsys.readouterr().out
    r = tmp_path / "r.json"
    for v in (1, 2):
        cli.keep_result(str(r), "spark", {"v": v})
    cli.keep_result(str(r), "naive", {"v": 3})
    assert r.read_text().count('"system"') == 2


def test_stream(store, spark, tmp_path):
    from loomary.streaming import ingest

    src = str(tmp_path / "in")
    store.frame([row("m1"), row("m2", n=1, embedding=[0.99, 0.0])]).write.parquet(src)
    stream = spark.readStream.schema(store.memories.schema).parquet(src)
    for i in range(2):  # the second run replays the same files from a fresh checkpoint
        ingest.ingest(stream, store, str(tmp_path / f"ck{i}"), newer).awaitTermination()
    assert store.count("a1") == 2 and store.memories.rows().count() == 2
    assert [(r["memory_a_id"], r["memory_b_id"]) for r in store.pending_review("a1").collect()] in ([("m2", "m1")], [("m1", "m2")])


def test_stream_counts(spark, data, tmp_path):
    from loomary.streaming import ingest

    e = spark.read.parquet(f"{data}/events.parquet")
    e.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    q = ingest.access_counts(s).writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["user_id"]: r["n"] for r in spark.table("counts").collect()}
    assert got == {r["user_id"]: r["count"] for r in e.groupBy("user_id").count().collect()}


def test_rule_classifier_has_all_verdicts(spark):
    rows = spark.range(8).selectExpr("100 as seq_a", "id * 100 as seq_b")
    assert {r["verdict"] for r in detect.rule_classifier(rows).collect()} == {"direct_contradiction", "temporal_supersession", "partial_conflict", "unrelated"}


def test_writers_never_share_a_number_and_read_only_their_buckets(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = MemoryStore(spark, f"{tmp_path}/n")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.store_batch(store.frame([row(f"m{i}-{k}", agent=f"t{i}") for k in range(5)])), range(6)))
    seqs = [r[0] for r in store.mem().select("version_seq").collect()]
    assert len(seqs) == 30 == len(set(seqs))
    frame = store.frame([row("m0-0", agent="t0")])
    at = store.memories.touched(frame)
    plan = store.memories.state(buckets=at)._jdf.queryExecution().executedPlan().toString()
    assert len(at) == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "(bucket" in plan
    first = {r["memory_id"]: r["first_seq"] for r in store.mem("t0").collect()}
    store.update(frame)
    again = store.fetch("t0", "m0-0").first()
    assert again["first_seq"] == first["m0-0"] < again["version_seq"]
    order = [r["memory_id"] for r in store.mem("t1").orderBy("first_seq").collect()]
    assert order == [f"m1-{k}" for k in range(5)]


def test_a_store_keeps_its_vector_size_and_its_conflict_rules(spark, tmp_path):
    path = f"{tmp_path}/v"
    MemoryStore(spark, path, vector_size=2)
    MemoryStore(spark, path, vector_size=2)
    with pytest.raises(ValueError):
        MemoryStore(spark, path, vector_size=3)
    store = MemoryStore(spark, path)
    store.store_conflict({"agent_id": "a1", "conflict_id": "c1", "memory_a_id": "x", "memory_b_id": "y", "conflict_type": "partial_conflict", "confidence": 0.9, "description": "d"})
    with pytest.raises(InvalidRecords):
        store.update_conflict(store.fetch_conflict("a1", "c1").withColumn("confidence", F.lit(2.0)))
    with pytest.raises(ValueError):
        schema.check_instants(spark.sql("select timestamp_ntz'2024-01-01' as t"))
    assert isinstance(store, Storage)


def test_metrics(spark, tmp_path):
    store = MemoryStore(spark, f"{tmp_path}/m")
    store.store_batch(store.frame([row("near", embedding=[1.0, 0.1]), row("far", embedding=[5.0, 0.0]), row("side", embedding=[0.0, 0.5])]))
    best = lambda m: store.search("a1", [1.0, 0.0], 1, metric=m).first()["memory_id"]
    assert [best(m) for m in ("cosine", "dot", "euclid", "manhattan")] == ["far", "far", "near", "near"]
    assert [r["memory_id"] for r in store.search("a1", [1.0, 0.0], 5, 0.2, metric="euclid").collect()] == ["near"]


def test_actions_are_executed_once(spark, tmp_path):
    from loomary.operators import consolidate

    a = spark.createDataFrame([("a", "x", "flag", ["m"], None, None)], "agent_id string, action_id string, action_type string, source_memory_ids array<string>, result_memory_id string, executed_at timestamp")
    done = consolidate.executed(a, F.lit("2026-01-01").cast("timestamp"))
    assert done.first()["result_memory_id"] == "m"
    with pytest.raises(Exception, match="executed before"):
        consolidate.executed(done, F.current_timestamp()).collect()


def test_a_break_between_the_writes_of_a_batch_loses_no_conflict(spark, tmp_path):
    from loomary.streaming import ingest

    broken = {"yes": True}

    def classify(pairs):
        if broken.pop("yes", False):
            raise RuntimeError("broke off")
        return pairs.withColumns({"verdict": F.lit("direct_contradiction"), "confidence": F.lit(0.9), "summary": F.lit("s")})

    store = MemoryStore(spark, f"{tmp_path}/store")
    rows = store.frame([row(i, embedding=[1.0, k / 100]) for k, i in enumerate("abc")])
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: ingest.ingest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint", classify)
    with pytest.raises(Exception, match="broke off"):
        stream().awaitTermination()
    assert store.mem().count() == 3 and store.conf().count() == 0
    stream().awaitTermination()
    assert store.mem().count() == 3 and store.conf().count() == 3
    one = store.conf().first()
    store.resolve_conflict("a1", one["conflict_id"], "human_reviewed")
    again = ingest.ingest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/other", classify)
    again.awaitTermination()
    assert store.conf().count() == 3 and store.open_conflicts().count() == 2


def test_scratch_scope_removes_its_tables(spark):
    from loomary.session import Scratch, scratch_scope

    with scratch_scope():
        s = Scratch(spark, "scope")
        s.save(spark.range(3), "t")
        assert s._fs.exists(s._path(s.root))
    assert not s._fs.exists(s._path(s.root))
