"""Supersession chains through a memory, from its oldest ancestor to its newest successor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hierarchy


def _backward(mem: DataFrame) -> DataFrame:
    """(agent_id, child, parent): each memory's oldest existing predecessor, first listed on a tie."""
    listed = mem.select("agent_id", F.col("memory_id").alias("child"), F.posexplode("supersedes").alias("pos", "memory_id"))
    found = listed.join(mem.select("agent_id", "memory_id", "created_at"), ["agent_id", "memory_id"]).filter("child <> memory_id")
    return found.groupBy("agent_id", "child").agg(F.min_by("memory_id", F.struct("created_at", "pos")).alias("parent"))


def _forward(mem: DataFrame) -> DataFrame:
    step = mem.filter("superseded_by is not null and superseded_by <> memory_id").select("agent_id", F.col("memory_id").alias("child"), F.col("superseded_by").alias("parent"))
    return step.join(mem.select("agent_id", F.col("memory_id").alias("parent")), ["agent_id", "parent"], "left_semi").select("agent_id", "child", "parent")


def _walks(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(agent_id, memory_id, steps): the nodes after each one along its links, until the end or a repeat."""
    nodes = hierarchy.resolve(spark, links, paths=True)
    plain = nodes.filter("depth > 0").select("agent_id", F.col("node").alias("memory_id"), F.reverse(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("steps"))
    round_ = nodes.filter("depth = -1").select("agent_id", F.col("node").alias("child"), "root_id").join(links, ["agent_id", "child"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def finish() -> pd.DataFrame:
            to = {c: p for c, p in rows}
            out = []
            for c in to:
                seen, steps, n = {c}, [], to[c]
                while n is not None and n not in seen:
                    seen.add(n)
                    steps.append(n)
                    n = to.get(n)
                out.append((now[0], c, steps))
            return pd.DataFrame(out, columns=["agent_id", "memory_id", "steps"])

        for b in batches:
            for a, r, c, p in zip(b.agent_id, b.root_id, b.child, b.parent, strict=True):
                if (a, r) != now:
                    if rows:
                        yield finish()
                    now, rows = (a, r), []
                rows.append((c, p))
        if rows:
            yield finish()

    circles = round_.select("agent_id", "root_id", "child", "parent").repartition("agent_id", "root_id").sortWithinPartitions("agent_id", "root_id").mapInPandas(walk, "agent_id string, memory_id string, steps array<string>")
    return plain.unionByName(circles)


def lineage(spark: SparkSession, mem: DataFrame) -> DataFrame:
    """(agent_id, memory_id, chain) of every memory, oldest to newest, itself included.

    Backward the oldest existing predecessor is followed, forward the successor; a missing link or a
    memory already in the chain ends it.
    """
    back = _walks(spark, _backward(mem)).withColumnRenamed("steps", "back")
    ahead = _walks(spark, _forward(mem)).withColumnRenamed("steps", "ahead")
    none = F.array().cast("array<string>")
    j = mem.select("agent_id", "memory_id").join(back, ["agent_id", "memory_id"], "left").join(ahead, ["agent_id", "memory_id"], "left")
    j = j.select("agent_id", "memory_id", F.coalesce("back", none).alias("back"), F.coalesce("ahead", none).alias("ahead"))
    met = F.array_min(F.filter(F.transform("back", lambda x: F.array_position("ahead", x)), lambda i: i > 0))
    cut = F.when(met.isNull(), F.col("ahead")).otherwise(F.slice("ahead", F.lit(1), (met - 1).cast("int")))
    return j.select("agent_id", "memory_id", F.concat(F.reverse("back"), F.array("memory_id"), cut).alias("chain"))
