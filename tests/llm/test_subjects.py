import os
import random

import numpy as np
import pytest

from loomary.llm import subjects
from loomary.session import Scratch

WORDS = {
    "cooking": "oven dough garlic recipe broth whisk", "law": "court judge appeal clause verdict bail", "sport": "goal referee league sprint trophy match", "smalltalk": "hello weather thanks morning bye nice",
}


def text(r, mix, n=20):
    out = []
    for _ in range(n):
        s = r.choice(mix)
        w = WORDS[s].split() if s else ["note", "saved", "item"]
        out.append(f"The user said the {r.choice(w)} is near the {r.choice(w)} for {r.randrange(9)} days.")
    return " ".join(out)


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.choice(list(WORDS))
        out.append((text(r, [s, s, s, None]), "en", [s if r.random() > 0.1 else r.choice(list(WORDS))]))
    return out


def classified(spark, df, m):
    scratch = Scratch(spark, "test")
    return subjects.classify(subjects.scored(scratch, subjects.encoded(scratch, df, m.vocabulary), m), m).collect()


def shares(m, batch):
    return m.shares(len(batch), *m.scored(batch))


def test_corpus_statistics_cover_all_documents(spark):
    """With the labelled documents as the whole corpus, the distributed counts give the local model."""
    data = rows(60, 3)
    names = sorted(WORDS)
    local = subjects.train(data, names)
    sample = subjects.Sample.of(data, names)
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(data)], "doc_id bigint, text string, lang string").repartition(3)
    scratch = Scratch(spark, "test")
    m, _ = subjects.trained(scratch, subjects.encoded(scratch, df, sample.vocabulary), sample, names)
    assert m.bound == local.bound and np.allclose(m.uni, local.uni) and np.allclose(m.bi, local.bi) and np.allclose(m.tongue, local.tongue)
    more = df.unionByName(spark.createDataFrame([(900 + i, "die katze schläft. " * 30, "de") for i in range(9)], df.schema))
    other, _ = subjects.trained(scratch, subjects.encoded(scratch, more, sample.vocabulary), sample, names)
    assert other.tongue.shape[0] == 2


def test_long_documents_in_pieces(monkeypatch):
    m = subjects.train(rows(200, 1), sorted(WORDS))
    r = random.Random(9)
    batch = [subjects.encode(text(r, ["law", "sport"], n), m.vocabulary) for n in (3, 400, 1, 50)] + [subjects.encode("", m.vocabulary)]
    want, n = shares(m, batch), len(m.scored(batch)[0])
    monkeypatch.setattr(subjects, "SLICE", 100)
    assert np.allclose(shares(m, batch), want) and len(m.scored(batch)[0]) == n


def test_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en") for i in range(50)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, "law") for i in range(50)], "doc_id bigint, subject string")
    assert len(subjects.labelled(docs, labels, chars=1000)) == 10 and len(subjects.labelled(docs, labels, limit=7)) == 7
    assert len(subjects.labelled(docs, labels, chars=1)) == 1


def test_held_out_accuracy_with_wrong_labels():
    m = subjects.train(rows(200, 1), sorted(WORDS))
    r = random.Random(5)
    docs = [(s, text(r, [s, s, None])) for s in WORDS for _ in range(20)]
    share = shares(m, [subjects.encode(t, m.vocabulary) for _, t in docs])
    assert sum(m.subjects[x.argmax()] == s for x, (s, _) in zip(share, docs, strict=True)) >= 0.97 * len(docs)
    assert (share[:, [m.subjects.index(s) for s in WORDS]] >= 0.2).sum() <= 1.05 * len(docs)


def test_several_subjects_and_last_resort(spark):
    m = subjects.train(rows(200, 2), sorted(WORDS))
    r = random.Random(6)
    docs = [(1, text(r, ["law", "sport"], 40)), (2, text(r, ["law", "smalltalk"], 40)), (3, text(r, ["smalltalk"])), (4, None), (5, ""), (6, "12 34 !!"), (1, "x"), (None, text(r, ["law"]))]
    df = spark.createDataFrame([(i, t, None, 0.0) for i, t in docs], "doc_id bigint, text string, lang string, share double")
    got = {(x["doc_id"], x["subject"]) for x in classified(spark, df, m)}
    assert got == {(1, "law"), (1, "sport"), (2, "law"), (3, "smalltalk")}


def test_nothing_to_learn_from(spark):
    m = subjects.train([], ["law"])
    df = spark.createDataFrame([(1, "some words here.", "en")], "doc_id bigint, text string, lang string")
    assert classified(spark, df, m) == []
    none = subjects.subject_areas(spark, df, spark.createDataFrame([], "doc_id bigint, subject string"), spark.createDataFrame([("law",)], "subject string"))
    assert none.count() == 0
    assert subjects.subject_areas(spark, df.limit(0), spark.createDataFrame([(1, "law")], "doc_id bigint, subject string"), spark.createDataFrame([("law",)], "subject string")).count() == 0


def test_held_out_labels_of_the_tables(spark):
    root = os.path.join(os.path.dirname(os.environ.get("LOOMARY_TESTDATA", "/root/testdata/sf0.001").rstrip("/")), "sf0.1")
    if not os.path.isdir(root):
        pytest.skip("no test tables")
    t = lambda n: spark.read.parquet(f"{root}/{n}.parquet")
    names = sorted(r[0] for r in t("subjects").select("subject").collect())
    all_ = subjects.labelled(t("documents"), t("doc_labels"))
    cut = len(all_) * 3 // 4
    m = subjects.train(all_[:cut], names)
    share = shares(m, [subjects.encode(x, m.vocabulary) for x, _, _ in all_[cut:]])
    pairs = [(i, names.index(s)) for i, (_, _, ls) in enumerate(all_[cut:]) for s in ls if s in names]
    assert sum(share[i, s] >= subjects.SHARE for i, s in pairs) >= 0.9 * len(pairs)  # about one label in twenty is wrong


def test_training_takes_twelve_thousand_labelled_documents(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "'some text.' AS text", "'en' AS lang")
    labels = spark.range(10_000).selectExpr("id AS doc_id", "'law' AS subject")
    assert len(subjects.labelled(docs, labels)) == 10_000
