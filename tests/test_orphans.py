import datetime as dt
import random

from conftest import frame

from loomary.operators import orphans
from loomary.streaming import integrity

MEM = "agent_id string, memory_id string, superseded_by string, updated_at timestamp, first_seq bigint, version_seq bigint, op string"
CON = "agent_id string, conflict_id string, memory_a_id string, memory_b_id string, detected_at timestamp, first_seq bigint, version_seq bigint, op string"
T = dt.datetime(2025, 3, 1)


def test_reasons(spark):
    mem = frame(spark, MEM, [("a", "m1", "M9", T, 1, 1, "insert"), ("a", "m2", " ", T, 2, 2, "insert"), ("a", "m3", None, T, 9, 9, "insert"), ("a", "m4", None, T, 3, 3, "insert"), ("a", "m4", None, T, 3, 5, "delete")])
    con = frame(spark, CON, [("a", "c1", " M4 ", "m3", T, 4, 4, "insert"), ("a", "c2", None, "m1", None, 6, 6, "insert"), ("b", "c3", "m1", "m1", None, 7, 7, "insert"), ("a", "c4", "zz", "zz", T, 7, 7, "insert"), ("a", "c4", "zz", "zz", T, 7, 8, "delete")])
    got = {(r["table_name"], r["field"], r["version_seq"], r["reason"], r["period"]) for r in orphans.orphans(mem, con).collect()}
    assert got == {
        ("memories", "superseded_by", 1, "missing", "2025-03"), ("conflicts", "memory_a_id", 4, "deleted", "2025-03"), ("conflicts", "memory_b_id", 4, "late", "2025-03"),
        ("conflicts", "memory_a_id", 7, "missing", None), ("conflicts", "memory_b_id", 7, "missing", None),
    }


def test_changes_in_batches_give_the_whole(spark):
    r = random.Random(3)
    ids = [f"m{i}" for i in range(8)]
    log = [("a", r.choice(ids), r.choice([*ids, "x1", None]), T, 0, n, r.choice(["insert", "update", "delete"])) for n in range(60)]
    first = {}
    for x in log:
        first.setdefault(x[1], x[5])
    log = [(*x[:4], first[x[1]], *x[5:]) for x in log]
    whole = orphans.versions(frame(spark, MEM, log), orphans.MEMORIES)
    want = sorted(map(tuple, orphans.orphan_keys(orphans.add_up(orphans.deltas(whole, 1))).select("agent_id", "key", "refs").collect()))
    records, counts = spark.createDataFrame([], orphans.RECORDS), spark.createDataFrame([], orphans.COUNTS)
    r.shuffle(log)  # late and repeated rows
    for i in range(0, 60, 20):
        batch = log[i : i + 20] + log[:3]
        records, counts = orphans.apply_changes(records, counts, orphans.versions(frame(spark, MEM, batch), orphans.MEMORIES))
        records, counts = (spark.createDataFrame(x.collect(), x.schema) for x in (records, counts))
    assert sorted(map(tuple, orphans.orphan_keys(counts).select("agent_id", "key", "refs").collect())) == want


def test_empty(spark):
    assert orphans.orphans(spark.createDataFrame([], MEM), spark.createDataFrame([], CON)).count() == 0


def random_logs(seed, n=80):
    r = random.Random(seed)
    ids = [f"m{i}" for i in range(9)]
    first, mem, con = {}, [], []
    for seq in range(1, n):
        op = r.choice(["insert", "update", "delete"])
        if r.random() < 0.5:
            i = r.choice(ids)
            mem.append(("a", i, r.choice([*ids, "x1", None, " "]), T, first.setdefault(i, seq), seq, op))
        else:
            i = f"c{r.randrange(12)}"
            con.append(("a", i, r.choice([*ids, "x2"]), r.choice([*ids, None]), T, first.setdefault(i, seq), seq, op))
    return mem, con


def test_state_in_batches_replays_and_compaction(spark, tmp_path):
    row = lambda x: sorted(map(tuple, x.select("table_name", "field", "agent_id", "key", "version_seq", "reason", "period").collect()))
    for seed in range(2):
        mem, con = random_logs(seed)
        want = row(orphans.orphans(frame(spark, MEM, mem), frame(spark, CON, con)))
        assert want
        state = orphans.ReferenceState(spark, f"{tmp_path}/s{seed}")
        random.Random(seed).shuffle(mem)
        for i in range(0, len(mem), 15):
            state.apply(f"memories-{i}", (frame(spark, MEM, mem[i : i + 15] + mem[:3]), orphans.MEMORIES))
            state.apply(f"memories-{i}", (frame(spark, MEM, mem[:9]), orphans.MEMORIES))  # a replay under the same name
        state.compact()
        state.apply("conflicts-0", (frame(spark, CON, con[::2]), orphans.CONFLICTS))
        state.apply("conflicts-1", (frame(spark, CON, con), orphans.CONFLICTS))
        assert row(state.orphans()) == want
        state.compact()
        assert len(state.batches()) == 1 and row(state.orphans()) == want


def test_a_batch_that_broke_off_counts_once(spark, tmp_path):
    mem, con = random_logs(5)
    state = orphans.ReferenceState(spark, str(tmp_path))
    state.apply("memories-0", (frame(spark, MEM, mem), orphans.MEMORIES))
    want = sorted(map(tuple, state.counts().collect()))
    state._fs.delete(state._path(f"{tmp_path}/done-memories-0"), False)  # written, but never marked
    assert state.counts().count() == 0
    state.apply("memories-0", (frame(spark, MEM, mem), orphans.MEMORIES))
    assert sorted(map(tuple, state.counts().collect())) == want


def test_stream(spark, tmp_path):
    mem, con = random_logs(6)
    frame(spark, MEM, mem).write.parquet(f"{tmp_path}/m")
    frame(spark, CON, con).write.parquet(f"{tmp_path}/c")
    state = orphans.ReferenceState(spark, f"{tmp_path}/state")
    for at, ddl, of in ((f"{tmp_path}/m", MEM, orphans.MEMORIES), (f"{tmp_path}/c", CON, orphans.CONFLICTS)):
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(at)
        integrity.maintain(stream, of, state, f"{at}-checkpoint").awaitTermination()
    assert state.orphans().count() == orphans.orphans(frame(spark, MEM, mem), frame(spark, CON, con)).count()


def test_a_hot_key(spark):
    mem = [("a", f"m{i}", "Gone" if i % 3 == 0 else f"m{i + 1}", T, i, i, "insert") for i in range(1, 301)]
    got = [r["key"] for r in orphans.orphans(frame(spark, MEM, mem), spark.createDataFrame([], CON)).collect()]
    assert got.count("gone") == 100 and len(got) == 100 + 200  # the others name a memory written after them
