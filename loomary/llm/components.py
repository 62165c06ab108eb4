"""Pairwise matches to groups: peel the giant component, then propagate minima.

Real match graphs have one component far larger than all others, and that one is shallow: a
breadth-first search from the vertex with most links reaches it in few joins, each of which moves
only the frontier.  It is then anti-joined away, and the many small components left are labelled by
minimum propagation (alternating large-star and small-star steps, which keep the number of edges
and halve distances).  A deep giant doesn't make the search long: after ``peel_rounds`` what was
reached is contracted into one vertex and left to the propagation, which is exact either way.

Every step is an aggregation or an equi-join; no step gathers a component in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code, norm_id
from ..operators.graph import both_ways, minimum_labels, undirected
from ..operators.versions import current_conflicts
from ..session import Scratch, any_rows


def supersession_links(conflicts: DataFrame) -> DataFrame:
    """(agent_id, a, b) of current conflicts of type temporal_supersession with two different ids."""
    now = current_conflicts(conflicts, {"a": norm_id(F.col("memory_a_id")), "b": norm_id(F.col("memory_b_id")), "kind": code(F.col("conflict_type"))})
    return now.filter("kind = 'temporal_supersession' and a is not null and b is not null and a <> b").select("agent_id", "a", "b")


def _peel(scratch: Scratch, edges: DataFrame, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """The vertices reached from the one of highest degree as (agent_id, node, group_id), and the edges left."""
    top = both_ways(edges).groupBy("agent_id", "u").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent_id", "u").limit(1).take(1)
    if not top:
        return None, edges
    agent, seed = top[0]["agent_id"], top[0]["u"]
    arcs = both_ways(edges.filter(F.col("agent_id") == agent)).select("u", "v")
    reached = [scratch.save(edges.sparkSession.createDataFrame([(seed,)], "node string"), "frontier")]
    whole = False
    for _ in range(rounds):
        seen = reduce(DataFrame.unionByName, reached)
        ahead = arcs.join(reached[-1].withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        ahead = scratch.save(ahead, "frontier")
        if whole := not any_rows(ahead):
            break
        reached.append(ahead)
    seen = reduce(DataFrame.unionByName, reached)
    low = seen.agg(F.min("node")).first()[0]
    giant = seen.select(F.lit(agent).alias("agent_id"), "node", F.lit(low).alias("group_id"))
    if whole:  # no edge leads out of it
        return giant, scratch.save(edges.join(giant.select("agent_id", F.col("node").alias("u")), ["agent_id", "u"], "left_anti").select("agent_id", "u", "v"), "edges")
    marks = giant.select("agent_id", F.col("node").alias("u"), F.col("group_id").alias("gu"))
    left = edges.join(marks, ["agent_id", "u"], "left").join(marks.select("agent_id", F.col("u").alias("v"), F.col("gu").alias("gv")), ["agent_id", "v"], "left")
    left = left.select("agent_id", F.coalesce("gu", "u").alias("u"), F.coalesce("gv", "v").alias("v")).filter("u <> v")
    return giant, scratch.save(left.select("agent_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")


def connected_groups(spark: SparkSession, links: DataFrame, peel_rounds: int = 16) -> DataFrame:
    """(agent_id, memory_id, group_id) of every vertex; ``group_id`` is the smallest linked to it.

    ``links`` holds (agent_id, a, b).  Nulls and a vertex linked to itself make no link, repeats and
    both directions are one link, other columns are ignored, and no links give no rows.
    """
    scratch = Scratch(spark, "groups")
    edges = scratch.save(undirected(links), "edges")
    giant, left = _peel(scratch, edges, peel_rounds)
    groups = minimum_labels(scratch, left).select("agent_id", F.col("node").alias("memory_id"), F.col("label").alias("group_id"))
    if giant is None:
        return groups
    # The giant's stand-in may have been linked on: its members follow it, and it is a member itself.
    onward = groups.select("agent_id", F.col("memory_id").alias("group_id"), F.col("group_id").alias("on"))
    members = giant.join(onward, ["agent_id", "group_id"], "left").select("agent_id", F.col("node").alias("memory_id"), F.coalesce("on", "group_id").alias("group_id"))
    return groups.join(giant.select("agent_id", F.col("node").alias("memory_id")), ["agent_id", "memory_id"], "left_anti").unionByName(members)
