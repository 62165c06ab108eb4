"""Write logs: the newest version of each record.

A log holds one row per written version, in any order and with repeats.  The record's state is its
row with the highest ``version_seq``.  ``max_by`` keeps one row per key and map task before the
shuffle, so a record that is rewritten very often costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_id


def latest(log: DataFrame, keys: dict[str, Column], seq: str = "version_seq", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: ``keep`` columns of the row with the highest ``seq``.

    Rows with a null key part or a null ``seq`` name no record version and are left out.  Repeats
    of a version are one version; an empty log gives no rows.  ``keep`` is evaluated before the
    shuffle, so only those columns move.
    """
    keep = keep or {c: F.col(f"`{c}`") for c in log.columns if c not in keys}
    row = log.select(*[v.alias(k) for k, v in keys.items()], F.col(f"`{seq}`").alias("_seq"), F.struct(*[v.alias(k) for k, v in keep.items()]).alias("_row"))
    known = row.filter(F.col("_seq").isNotNull())
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.max_by("_row", "_seq").alias("_row")).select(*keys, "_row.*")


def current_memories(log: DataFrame, keep: dict[str, Column], deleted: bool = False) -> DataFrame:
    """Current memories as (agent_id, memory_id in lower case, *keep*).

    With ``deleted`` also the deleted ones; the column ``live`` then tells them apart.
    """
    out = latest(log, {"agent_id": F.col("agent_id"), "memory_id": norm_id(F.col("memory_id"))}, keep=keep | {"live": ~F.col("op").eqNullSafe("delete")})
    return out if deleted else out.filter("live").drop("live")


def current_conflicts(log: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """Current conflicts as (agent_id, conflict_id in lower case, *keep*)."""
    out = latest(log, {"agent_id": F.col("agent_id"), "conflict_id": norm_id(F.col("conflict_id"))}, keep=keep | {"live": ~F.col("op").eqNullSafe("delete")})
    return out.filter("live").drop("live")
