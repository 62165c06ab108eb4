"""Extra columns whose names the core operators use themselves, and columns that are all null."""

from conftest import frame
from pyspark.sql import functions as F
from test_orphans import CON, MEM, T

from loomary.operators import graph, hierarchy, orphans, sequence
from loomary.session import Scratch

EXTRA = ["at", "rank", "root", "node", "low", "seg", "steps", "salt", "n_links", "parent", "refs", "key", "existing", "ever", "live", "row", "_row", "_seq", "bucket", "period", "reason", "u", "v", "m", "label", "_range", "_n"]


def clash(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns})


def test_extra_columns(spark):
    links = clash(frame(spark, "agent_id string, child string, parent string", [("a", "x", "y"), ("a", "y", "z")]))
    assert {r["node"]: r["depth"] for r in hierarchy.resolve(spark, links, chunk_links=1).collect()} == {"x": 2, "y": 1, "z": 0}
    mem = clash(frame(spark, MEM, [("a", "m1", "gone", T, 1, 1, "insert")]))
    con = clash(frame(spark, CON, [("a", "c1", "m1", "other", T, 2, 2, "insert")]))
    assert {(r["field"], r["reason"]) for r in orphans.orphans(mem, con).collect()} == {("superseded_by", "missing"), ("memory_b_id", "missing")}
    e = graph.undirected(clash(frame(spark, "agent_id string, a string, b string", [("a", "x", "y")])))
    scratch = Scratch(spark, "t")
    assert graph.minimum_labels(scratch, scratch.save(e, "e")).count() == 2
    assert [r["n"] for r in sequence.numbered(clash(frame(spark, "g string, o int", [("a", 2), ("a", 1)])).drop("_range", "_row", "_n"), ["g"], ["o"], "n").orderBy("o").collect()] == [1, 2]


def test_columns_of_nulls(spark):
    mem = frame(spark, MEM, [("a", None, None, None, None, 1, None), (None, "m", "x", None, None, None, None), ("a", "m2", "m2", None, None, 3, None)])
    con = frame(spark, CON, [(None, None, None, None, None, None, None, None), ("a", "c", None, None, None, None, 4, None)])
    assert orphans.orphans(mem, con).count() == 0
    links = hierarchy.memory_links(mem.withColumn("supersedes", F.lit(None).cast("array<string>")))
    assert [(r["node"], r["root_id"], r["depth"]) for r in hierarchy.resolve(spark, links).collect()] == [("m2", "m2", -1)]
