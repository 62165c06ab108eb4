import datetime as dt
import random

from pyspark.sql import functions as F

from loomary.llm import alignment, survivor
from loomary.llm.alignment import Profile, align, distance, tokens
from loomary.llm.survivor import FieldRule, survivors

ROWS = "g string, id string, text string, n double, trust double"


def run(spark, rows, mode="rank"):
    rules = [FieldRule("text", F.col("text"), F.col("text") != "", F.col("trust"), text=True), FieldRule("n", F.col("n"), F.col("n") >= 0, F.col("trust"))]
    got = survivors(spark, spark.createDataFrame(rows, ROWS), ["g"], "id", rules, mode).collect()
    return {(r["g"], r["field"]): (r["group_id"], r["value"], r["from_id"]) for r in got}


def test_most_trusted_wins(spark):
    rows = [
        ("a", "2", "the cat sat", 1.0, 0.5), ("a", "1", "the dog sat", 2.0, 0.9), ("a", "3", "the dog sat", None, 0.9), ("a", "0", "", -1.0, 1.0),
        ("b", "9", "alone", 1.0, 1.0), (None, "8", "x", 1.0, 1.0), ("c", "5", None, None, None), ("c", "6", None, None, None), ("d", "1", "p", 3.0, None), ("d", "2", "q", 4.0, None),
    ]
    got = run(spark, rows + rows[:2])
    assert got == {("a", "text"): ("0", "the dog sat", "1"), ("a", "n"): ("0", "2.0", "1"), ("d", "text"): ("1", "p", "1"), ("d", "n"): ("1", "3.0", "1")}


def test_votes_add_up(spark):
    rows = [("a", "1", "red big fox", None, 5.0), ("a", "2", "red old fox", None, 3.0), ("a", "3", "red old box", None, 3.0), ("a", "4", "sad old fox", None, 1.0)]
    assert run(spark, rows, "sum")[("a", "text")] == ("1", "red old fox", "2")
    assert run(spark, rows)[("a", "text")] == ("1", "red big fox", "1")


def plain(rows, mode):
    """The same by one profile per group, in Python."""
    out = {}
    groups = {}
    for g, i, text, _, trust in rows:
        groups.setdefault(g, {}).setdefault(i, (text, trust))
    for g, recs in groups.items():
        if len(recs) < 2:
            continue
        votes = {}
        for i, (text, trust) in recs.items():
            if text:
                vote = (-trust if trust is not None else 0.0 if mode == "sum" else float("inf"), i)
                own = (-trust if trust is not None else float("inf"), i)
                had = votes.get(text)
                if had is None:
                    votes[text] = [vote, own]
                else:
                    had[0] = (had[0][0] + vote[0], min(had[0][1], i)) if mode == "sum" else min(had[0], vote)
                    had[1] = min(had[1], own)
        if votes:
            p = Profile(mode)
            for t, (v, _) in sorted(votes.items(), key=lambda x: x[1][0]):
                p.add(tokens(t), v)
            t = min(votes, key=lambda t: (distance(tokens(t), p.consensus()), *votes[t][0]))
            out[g, "text"] = (min(recs), t, votes[t][1][1])
    return out


def random_rows(seed, n=80):
    r = random.Random(seed)
    words = "one two three four five six".split()
    base = "one two three four five six one two".split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.4:
            w.insert(r.randrange(len(w)), r.choice(words))
        if r.random() < 0.3:
            w.pop(r.randrange(len(w)))
        rows.append((r.choice("aab"), f"{i:03}", " ".join(w), None, r.choice([None, *map(float, range(1, 30))])))
    return rows


def test_equals_plain_profiles(spark):
    for mode in ("rank", "sum"):
        for seed in range(3):
            rows = random_rows(seed, 40)
            got = {k: v for k, v in run(spark, rows + rows[:4], mode).items() if k[1] == "text"}
            assert got == plain(rows, mode)


def test_wide_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(survivor, "BACKBONE", 6)
    monkeypatch.setattr(survivor, "PART", 4)
    for seed in range(3):
        rows = random_rows(seed)
        got = {k: v for k, v in run(spark, rows).items() if k[1] == "text"}
        assert got == plain(rows, "rank")  # the most trusted value, in parts or not
    # parts of a wide group add up: the votes are those of one part
    rows = random_rows(7)
    few = run(spark, rows, "sum")
    monkeypatch.setattr(survivor, "PART", 10_000)
    assert run(spark, rows, "sum") == few


def test_majority_overrules_the_most_trusted(spark):
    mem = "agent_id string, memory_id string, text string, status string, created_at timestamp, updated_at timestamp, importance double, metadata string, provenance struct<source_id:string,chunk_index:int>, version_seq bigint, op string"
    day = lambda n: dt.datetime(2026, 6, n)
    rows = [("a", f"m{i}", t, "Active ", day(n), day(n), 0.5, "{}", ("S1", 0), i, "insert") for i, (t, n) in enumerate([("the limit is 60", 1), ("the limit is 60 now", 2), ("the limit is 60 ", 3), ("the limit is 90", 30)])]
    con = "agent_id string, conflict_id string, memory_a_id string, memory_b_id string, conflict_type string, confidence double, description string, detected_at timestamp, version_seq bigint, op string"
    m, c = spark.createDataFrame(rows, mem), spark.createDataFrame([], con)
    got = {r["field"]: (r["value"], r["from_id"]) for r in survivor.consensus_survivors(spark, m, c, F.lit("2026-07-01").cast("timestamp")).collect()}
    assert got["text"][0].startswith("the limit is 60") and got["status"] == ("active", "m3")
    assert survivor.consensus_survivors(spark, m.limit(0), c, F.current_timestamp()).count() == 0


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_alignment():
    assert tokens("a  b, c.") == ["a", "  ", "b", ",", " ", "c", "."]
    a, b = list("abcdef"), list("abxdef")
    assert distance(a, b) == 1 and distance(a, a) == 0 and distance([], a) == 6
    for p, q in ((a, b), ([], b), (a, [])):
        got = align(p, q)
        assert [i for i, _ in got if i >= 0] == list(range(len(p))) and [j for _, j in got if j >= 0] == list(range(len(q)))
    long = ["x", "y"] * 1000
    assert distance(long, ["new", *long]) == 1 and distance(long[:700] + ["new"] + long[700:], long) == 1
    p = Profile("rank")
    p.add(["x", "y"], (-1.0, "a"))
    p.add(["x", "z", "y"], (-0.5, "b"))
    assert p.consensus() == ["x", "y"]


def test_alignment_is_a_longest_match_at_any_length(monkeypatch):
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(30))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        monkeypatch.setattr(alignment, "CELLS", 1_000_000)
        got = align(a, b)
        assert sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in got) >= best[-1][-1]
        monkeypatch.setattr(alignment, "CELLS", 0)
        assert align(a, b) == got
