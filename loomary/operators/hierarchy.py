"""Parent links to full hierarchies: root, depth, path, descendants and cycles.

Every node has at most one parent, so a component is a tree whose root has no parent, or trees
hanging on one cycle.  The links are cut into chunks of bounded size; each chunk builds a weighted
disjoint-set forest, in which a node stores its offset to its set's root, and compresses it.

Forests are merged hierarchically.  Of a chunk only the nodes that are the root of another chunk's
set go on, each as one weighted link to its own root; these links are cut into chunks again, and so
on, until every chunk holds all links of its agent.  The answers then come back down, one join a
level.  Chunks follow the order of a locality column where there is one (records that replace each
other are written near each other), so that few links cross them; without one they follow a hash.
Where a level doesn't halve the links, they are finished by joins that double the distance covered
each round.  Paths come from walking the compressed parents.

Agents whose links fit one chunk are finished at the first level; a larger one may hold any share of
the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..session import Scratch, any_rows, hold
from .versions import current_memories

#: Most links that one disjoint-set forest holds in memory at once.
CHUNK_LINKS = 100_000

LINKS = "agent_id string, child string, parent string, steps bigint, low string, closed boolean, seg array<string>, at bigint"
FOREST = "agent_id string, node string, root string, depth bigint, low string, cyclic boolean, whole boolean, path array<string>, at bigint"


def memory_links(memories: DataFrame) -> DataFrame:
    """(agent_id, child, parent, at) of current memories; ``at`` is the child's first write number.

    The parent is the current memory that ``superseded_by`` names; failing that, the smallest id
    among current memories whose ``supersedes`` lists the child.  Null and blank ids name nothing;
    a record naming itself is a circle of one.
    """
    # written once: the joins' sides are then plain shuffles, and AQE's skew join splits a parent of very many
    now = hold(current_memories(memories, {"up": norm_id(F.col("superseded_by")), "downs": F.col("supersedes"), "at": F.col("first_seq")}), "links")
    ids = now.select("agent_id", F.col("memory_id").alias("id"), "at")
    stated = now.filter("up is not null").select("agent_id", F.col("memory_id").alias("child"), F.col("up").alias("parent"), F.lit(0).alias("rank"), "at")
    stated = stated.join(ids.select("agent_id", F.col("id").alias("parent")), ["agent_id", "parent"], "left_semi").select("agent_id", "child", "parent", "rank", "at")
    listed = now.select("agent_id", F.col("memory_id").alias("parent"), F.explode("downs").alias("d")).select("agent_id", norm_id(F.col("d")).alias("child"), "parent", F.lit(1).alias("rank")).filter("child is not null")
    listed = listed.join(ids.withColumnRenamed("id", "child"), ["agent_id", "child"]).select("agent_id", "child", "parent", "rank", "at")
    return stated.unionByName(listed).groupBy("agent_id", "child").agg(F.min(F.struct("rank", "parent")).alias("p"), F.min("at").alias("at")).select("agent_id", "child", F.col("p.parent").alias("parent"), "at")


class WeightedForest:
    """Disjoint sets of one chunk's links; each node's weight is its number of steps to the set's root.

    ``links`` maps a node to (parent, steps, smallest node passed, nodes passed or None).  ``closed``
    maps nodes known to run in a circle to its smallest node.
    """

    def __init__(self, links: dict[str, tuple], closed: dict[str, str] | None = None):
        self.links = links
        #: node -> (root, steps, smallest node passed before the root, runs in a circle)
        self.at: dict[str, tuple[str, int, str, bool]] = {n: (low, -1, low, True) for n, low in (closed or {}).items()}
        for n in links:
            if n not in self.at:
                self._compress(n)

    def _compress(self, start: str) -> None:
        links, at, walk, order, n = self.links, self.at, [], {}, start
        while n in links and n not in at and n not in order:
            order[n] = len(walk)
            walk.append(n)
            n = links[n][0]
        if n in order:  # the walk met itself: its tail from there on is a cycle
            cycle = walk[order[n] :]
            low = min(links[x][2] for x in cycle)
            for x in cycle:
                at[x] = (low, -1, low, True)
            walk = walk[: order[n]]
        root, steps, low, cyclic = at.get(n, (n, 0, None, False))
        for x in reversed(walk):
            if cyclic:
                at[x] = (root, -1, root, True)
            else:
                _, more, passed, _ = links[x]
                steps, low = steps + more, passed if low is None or passed < low else low
                at[x] = (root, steps, low, False)

    def path(self, node: str) -> list[str]:
        """From the set's root (left out) down to the node; of a node in or above a cycle, the node alone."""
        if self.at[node][3]:
            return [node]
        out, end = [], self.at[node][0]
        while node != end:
            out.append(self.links[node][3] or [node])
            node = self.links[node][0]
        return [n for seg in reversed(out) for n in seg]


def _forests(limit: int, paths: bool):
    def rows(agent: str, n_links: int, links: dict[str, tuple], closed: dict[str, str], ats: dict[str, int]) -> pd.DataFrame:
        f = WeightedForest(links, closed)
        whole = len(ats) == n_links
        return pd.DataFrame([(agent, n, *f.at[n], whole, f.path(n) if paths else None, at) for n, at in ats.items()], columns=["agent_id", "node", "root", "depth", "low", "cyclic", "whole", "path", "at"]).astype({"at": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, links, closed, ats = None, {}, {}, {}
        for b in batches:
            segs = b.seg if paths else [None] * len(b)
            for agent, n, child, parent, steps, low, end, seg, at in zip(b.agent_id, b.n_links, b.child, b.parent, b.steps, b.low, b.closed, segs, b["at"], strict=True):
                if ats and (key[0] != agent or len(ats) >= limit):
                    yield rows(*key, links, closed, ats)
                    links, closed, ats = {}, {}, {}
                key = (agent, n)
                ats[child] = None if pd.isna(at) else int(at)
                if end:
                    closed[child] = low
                else:
                    links[child] = (parent, steps, low, None if seg is None else list(seg))
        if ats:
            yield rows(*key, links, closed, ats)

    return run


def _chunks(scratch: Scratch, links: DataFrame, limit: int) -> DataFrame:
    """Links with their agent's number of links, grouped into chunks by locality (or hash) and sorted."""
    sizes = links.groupBy("agent_id").agg(F.count("*").alias("n_links"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    sizes = scratch.save(sizes, "sizes")  # a written side lets AQE split an agent that holds a large share
    parts = F.ceil(F.col("n_links") / limit)
    near = F.floor((F.col("at") - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1))
    salt = F.when(F.col("n_links") <= limit, F.lit(0).cast("bigint")).otherwise(F.coalesce(near, F.pmod(F.xxhash64("child"), parts)))
    cut = links.join(sizes, "agent_id").withColumn("salt", salt)
    return cut.repartition("agent_id", "salt").sortWithinPartitions("agent_id", "salt", "at", "child").select("agent_id", "n_links", "child", "parent", "steps", "low", "closed", "seg", "at")


def _level(scratch: Scratch, links: DataFrame, paths: bool, limit: int, seen: list[int] | None) -> DataFrame:
    """FOREST rows of all nodes with a link, at their final roots."""
    forest = scratch.save(_chunks(scratch, links, limit).mapInPandas(_forests(limit, paths), FOREST), "forest")
    open_rows = forest.filter("not whole")
    if not any_rows(open_rows):
        return forest
    # what other sets end at: roots that have a link themselves, in another chunk
    ends = open_rows.filter("not cyclic").select("agent_id", F.col("root").alias("node")).distinct()
    heads = scratch.save(open_rows.join(ends, ["agent_id", "node"], "left_semi").select(*forest.columns), "heads")
    n_open, n_heads = open_rows.count(), heads.count()
    if seen is not None:
        seen.append(n_heads)
    if not n_heads:
        return forest
    if n_heads * 2 > n_open:
        ahead = _double(scratch, heads)
    else:
        up = heads.select("agent_id", F.col("node").alias("child"), F.col("root").alias("parent"), F.col("depth").alias("steps"), "low", F.col("cyclic").alias("closed"), F.col("path").alias("seg"), "at")
        ahead = _level(scratch, up, paths, limit, seen)
    return forest.filter("whole").unionByName(scratch.save(_step(open_rows, ahead), "merged"))


def resolve(spark: SparkSession, links: DataFrame, paths: bool = False, chunk_links: int = CHUNK_LINKS, seen: list[int] | None = None) -> DataFrame:
    """(agent_id, node, root_id, depth[, path]) of every node that has a parent or is one.

    ``links`` holds (agent_id, child, parent), one row per child, and may hold ``at``, a number that is
    near for linked nodes.  Roots have depth 0.  A node on a cycle or leading into one has the
    cycle's smallest node as root and depth -1.  ``path`` runs from root to node; on cycles it is
    null.  No links give no rows.  ``seen`` receives the number of links that each merge took on.
    """
    scratch = Scratch(spark, "hierarchy")
    at = F.col("at").try_cast("bigint") if "at" in links.columns else F.lit(None).cast("bigint")
    links = links.filter("agent_id is not null and child is not null and parent is not null")
    seg = F.array("child") if paths else F.lit(None).cast("array<string>")
    first = links.select("agent_id", "child", "parent", F.lit(1).cast("bigint").alias("steps"), F.col("child").alias("low"), F.lit(False).alias("closed"), seg.alias("seg"), at.alias("at"))
    done = _level(scratch, first, paths, chunk_links, seen)
    nodes = done.select("agent_id", "node", F.col("root").alias("root_id"), F.when(F.col("cyclic"), F.lit(-1).cast("bigint")).otherwise(F.col("depth")).alias("depth"), *([F.when(~F.col("cyclic"), F.concat(F.array("root"), "path")).alias("path")] if paths else []))
    tops = done.filter("not cyclic").select("agent_id", F.col("root").alias("node")).distinct()
    roots = tops.select("agent_id", "node", F.col("node").alias("root_id"), F.lit(0).cast("bigint").alias("depth"), *([F.array("node").alias("path")] if paths else []))
    return nodes.unionByName(roots)


def _step(rows: DataFrame, ahead: DataFrame) -> DataFrame:
    """``rows`` with each root replaced by where the forest ``ahead`` takes it."""
    b = ahead.select("agent_id", F.col("node").alias("root"), *[F.col(c).alias(f"b_{c}") for c in ("root", "depth", "low", "cyclic", "path")])
    moved = F.col("b_root").isNotNull() & ~F.col("cyclic")
    circle = moved & (F.col("b_cyclic") | (F.col("low") == F.col("b_low")))
    return rows.join(b, ["agent_id", "root"], "left").select(
        "agent_id", "node",
        F.when(moved & F.col("b_cyclic"), F.col("b_root")).when(circle, F.col("low")).when(moved, F.col("b_root")).otherwise(F.col("root")).alias("root"),
        F.when(circle, F.lit(-1).cast("bigint")).when(moved, F.col("depth") + F.col("b_depth")).otherwise(F.col("depth")).alias("depth"),
        F.when(moved & F.col("b_cyclic"), F.col("b_root")).when(moved, F.least("low", "b_low")).otherwise(F.col("low")).alias("low"),
        (F.col("cyclic") | F.coalesce(circle, F.lit(False))).alias("cyclic"), "whole",
        F.when(moved & ~circle, F.concat("b_path", "path")).otherwise(F.col("path")).alias("path"), "at",
    )


def _double(scratch: Scratch, entries: DataFrame) -> DataFrame:
    """Links at their final roots, by joins that double the distance each round."""
    while any_rows(entries.filter("not cyclic").join(entries.select("agent_id", F.col("node").alias("root")), ["agent_id", "root"], "left_semi")):
        ahead = scratch.save(_step(entries, entries), "entries")
        scratch.drop(entries)
        entries = ahead
    return entries


def descendants(nodes: DataFrame) -> DataFrame:
    """(agent_id, memory_id, descendant_id, distance) for every node and all nodes below it.

    ``nodes`` comes from ``resolve`` with paths: each node's path lists all its ancestors.
    """
    p = nodes.filter("path is not null").select("agent_id", F.col("node").alias("descendant_id"), F.posexplode("path").alias("pos", "memory_id"), "depth")
    return p.filter("pos < depth").select("agent_id", "memory_id", "descendant_id", (F.col("depth") - F.col("pos")).cast("bigint").alias("distance"))
