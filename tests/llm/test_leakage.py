import pickle
import random
import re

from loomary.llm import leakage


def brute(docs, items, run):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda x: {tuple(x[i : i + run]) for i in range(len(x) - run + 1)}
    return {(d, i) for d, t in docs for i, s in items if grams(w(t)) & grams(w(s))}


def solve(spark, docs, items, run=10):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, lang string")
    i = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, category string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaked(spark, d, i, run).collect()}


def test_equals_brute_force(spark):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 40)))) for i in range(60)]
    docs = []
    for d in range(60):
        t = [r.choice(vocab) for _ in range(r.randrange(200))]
        if r.random() < 0.7:
            w = r.choice(items)[1].split()
            k = r.randrange(len(w))
            t[len(t) // 2 : len(t) // 2] = w[k : k + r.randrange(4, 16)]
        docs.append((d, " ".join(t)))
    for run in (4, 6, 10):
        assert solve(spark, docs, items, run) == brute(docs, items, run)


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "INDEX_BYTES", 60)
    items = [(i, f"alpha beta gamma delta {i} epsilon") for i in range(5)]
    assert solve(spark, [(1, "x alpha beta gamma delta 3 y")], items, 5) == {(1, 3)}


def test_hidden_characters_and_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "a one t­wo three fo​ur five six se-\n  ven eight nine ten"), (2, None), (3, ""), (4, "one two three four five six seven eight nine"), (1, "again"), (5, "drop-off " + item.upper()), (None, item)]
    items = [(7, f"  {item}\n"), (8, "too short"), (9, None), (7, item), (None, item)]
    assert solve(spark, docs, items) == {(1, 7), (5, 7)}
    assert solve(spark, docs, []) == set()
    assert solve(spark, [], items) == set()


def test_index_survives_being_sent_and_tells_equal_hashes_apart(monkeypatch):
    items = [(5, "a b c d e a b c d e"), (6, "a b c d e f"), (7, "x y z")]
    whole = pickle.loads(pickle.dumps(leakage.ItemIndex(items, 5)))
    assert {whole.ids[d]: n for d, n in whole.leaks("q a b c d e a").items()} == {5: 2, 6: 1}
    assert [whole.n_runs(d) for d in range(2)] == [5, 2]
    want, plain = whole.leaks("q a b c d e a"), leakage.ItemIndex._hashes
    monkeypatch.setattr(leakage.ItemIndex, "_hashes", lambda self, w, s: plain(self, w, s) % (4 if self.salt == 0 else 1 << 62))
    again = leakage.ItemIndex(items, 5)
    assert again.salt > 0 and again.leaks("q a b c d e a") == want
