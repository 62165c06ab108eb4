"""Connected components by minimum propagation.

Large-star and small-star steps in turn: each vertex's neighbours are linked to the smallest of
them, which keeps the number of edges and shortens paths geometrically.  Every step is an
aggregation and an equi-join on a vertex; the edges of each round are written to the shared folder,
and counted and hashed while they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Scratch

#: Edges up to which any vertex's arcs fit a task without being split.
PLAIN = 5_000_000


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("agent_id", "u", "v").unionByName(e.select("agent_id", F.col("v").alias("u"), F.col("u").alias("v")))


def undirected(links: DataFrame) -> DataFrame:
    """Edges (agent_id, u, v) with u < v, once each, of links (agent_id, a, b); nulls and loops are none."""
    clean = links.filter("agent_id is not null and a is not null and b is not null and a <> b")
    return clean.select("agent_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _nearest(scratch: Scratch, arcs: DataFrame, key: str, of: str, hubs: bool) -> DataFrame:
    """``arcs`` with the smallest ``of`` of each ``key`` as ``m``.

    With ``hubs`` the minima are written first: both sides of the join are then plain shuffles, and
    AQE's skew join can split the arcs of a vertex that has a large share of them.
    """
    low = arcs.groupBy("agent_id", key).agg(F.min(of).alias("m"))
    return arcs.join(scratch.save(low, "minima") if hubs else low, ["agent_id", key])


def _large_star(scratch: Scratch, e: DataFrame, hubs: bool) -> DataFrame:
    arcs = _nearest(scratch, both_ways(e), "u", "v", hubs).withColumn("m", F.least("u", "m"))
    return arcs.filter("v > u").select("agent_id", F.col("m").alias("u"), "v").filter("u <> v").distinct()


def _small_star(scratch: Scratch, e: DataFrame, hubs: bool) -> DataFrame:
    near = _nearest(scratch, e, "v", "u", hubs)  # one edge of each v leads to m itself
    return near.select("agent_id", F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).distinct()


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    boss: dict[tuple, tuple] = {}

    def top(x: tuple) -> tuple:
        while boss[x] != x:
            boss[x] = x = boss[boss[x]]
        return x

    for b in batches:
        for g, u, v in zip(b.agent_id, b.u, b.v, strict=True):
            p, q = (top(x) if boss.setdefault(x, x) != x else x for x in ((g, u), (g, v)))
            if p != q:
                boss[max(p, q)] = min(p, q)
    yield pd.DataFrame([(g, n, top((g, n))[1]) for g, n in boss], columns=["agent_id", "node", "label"])


def minimum_labels(scratch: Scratch, edges: DataFrame, finish: int = 0) -> DataFrame:
    """(agent_id, node, label) of every vertex of ``edges``; the label is the component's smallest vertex.

    A round that changes no edge ends it, which is seen while its edges are written.  At most
    ``finish`` edges are labelled at once in one task instead; the labels are the same.
    """
    n, before = edges.count(), None
    while n > finish:
        seen = Observation()
        hubs = n > PLAIN
        both = _small_star(scratch, _large_star(scratch, edges, hubs), hubs)
        nearer = scratch.save(both.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("agent_id", "u", "v")), F.lit(0)).alias("x")), "edges")
        scratch.drop(edges)
        edges, now = nearer, (seen.get["n"], seen.get["x"])
        if now == before:
            stars = edges.select("agent_id", F.col("v").alias("node"), F.col("u").alias("label"))
            return stars.unionByName(stars.select("agent_id", F.col("label").alias("node"), "label").distinct())
        before, n = now, now[0]
    return edges.select("agent_id", "u", "v").coalesce(1).mapInPandas(_union_find, "agent_id string, node string, label string")
