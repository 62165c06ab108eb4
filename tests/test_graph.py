import random

from conftest import frame

from loomary.operators import graph
from loomary.session import Scratch


def labels(spark, links, **kw):
    scratch = Scratch(spark, "test")
    edges = scratch.save(graph.undirected(frame(spark, "agent_id string, a string, b string", links)), "edges")
    got = graph.minimum_labels(scratch, edges, **kw).collect()
    out = {(r["agent_id"], r["node"]): r["label"] for r in got}
    assert len(out) == len(got)
    return out


def test_one_task_gives_the_labels_of_the_rounds(spark):
    r = random.Random(5)
    links = [(r.choice("xy"), f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(45)] + [("x", f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    whole = labels(spark, links)
    assert labels(spark, links, finish=10_000) == whole == labels(spark, links, finish=40)
    assert len({v for k, v in whole.items() if k[1].startswith("c")}) == 1


def test_no_edges(spark):
    assert labels(spark, []) == {} == labels(spark, [("x", "a", "a"), ("x", None, "b")], finish=5)
