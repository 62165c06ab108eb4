"""One surviving record per group of duplicates, field by field, by token consensus.

For each group and field the eligible values are aligned token by token, every record votes in each
column with its trust, and the existing value closest to the voted consensus survives, with the
record it comes from.  Equal values vote once, summed before the shuffle.

Values of a group are aligned progressively, best vote first.  The first ``BACKBONE`` of them fix
the columns; any further ones are aligned to those columns in parts, emit their votes as rows, and
the votes of a column are added up by aggregation.  So a group may hold any share of all rows, and
no row or task holds a whole group.

Trust is lexicographic with ``rank``: a record outweighs all less trusted ones together, ties go to
the smallest id, and the consensus is the most trusted value.  With ``sum`` the weights add up and
the majority may overrule, column by column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import code, norm_id, strip
from ..operators.versions import current_conflicts, current_memories
from ..session import Scratch, any_rows
from .alignment import Profile, add_vote, align, distance, tokens

#: Distinct values that fix a group's columns, and further values aligned to them in one piece.
BACKBONE, PART = 128, 4096
#: Place of a column of the backbone among the columns inserted before it.
OWN = 2**31 - 1


@dataclass(frozen=True)
class FieldRule:
    """How one field's survivor is chosen: its value, which records may supply it, and their trust.

    ``trust`` is a double, higher is more trusted, null least.  ``text`` fields are aligned by
    words; values of others are one token.
    """

    name: str
    value: Column
    eligible: Column
    trust: Column
    text: bool = False


def survivors(spark: SparkSession, records: DataFrame, group: list[str], record_id: str, rules: list[FieldRule], mode: str = "rank") -> DataFrame:
    """(*group, group_id, field, value, from_id) for groups of two or more records.

    ``group_id`` is the smallest record id of the whole group.  A field no record can supply gives
    no row; rows with a null group column or id belong to no group; repeated rows are one record;
    an empty table gives no rows.
    """
    rows = records
    for c in [*group, record_id]:
        rows = rows.filter(F.col(c).isNotNull())
    scratch = Scratch(spark, "survivors")
    sizes = rows.groupBy(*group).agg(F.min(record_id).alias("group_id"), F.max(record_id).alias("_top")).filter("group_id <> _top").drop("_top")
    sizes = scratch.save(sizes, "sizes")  # a written side lets AQE's skew join split a group that holds a large share
    picks = F.array(*[F.struct(F.lit(r.name).alias("field"), F.lit(r.text).alias("text"), F.when(r.eligible, r.value.cast("string")).alias("value"), (-F.coalesce(r.trust.cast("double"), F.lit(float("-inf")))).alias("score")) for r in rules])
    long = rows.select(*group, F.col(record_id).alias("id"), F.explode(F.filter(picks, lambda p: p["value"].isNotNull())).alias("p")).select(*group, "id", "p.*")
    best = F.min(F.struct("score", "id"))
    if mode == "sum":  # -trust is the weight; a repeated record still votes once
        long = long.distinct()
        best = F.struct(F.sum(F.when(F.col("score") < float("inf"), F.col("score")).otherwise(0.0)).alias("score"), F.min("id").alias("id"))
    # from_id is always the most trusted holder of the value, whatever the votes
    votes = long.groupBy(*group, "field", "text", "value").agg(best.alias("vote"), F.min(F.struct("score", "id"))["id"].alias("from_id"))
    key = [*group, "group_id", "field"]
    voted = scratch.save(votes.join(sizes, group).select(*key, "text", "value", "vote.*", "from_id"), "votes")
    return _aligned(scratch, voted, key, mode)


def _cut(value: str, text: bool) -> list[str]:
    return tokens(value) if text else [value]


def _grouped(key: list[str], cols: list[str], finish):
    """Stream over rows sorted by ``key`` and finish each group: no task start per group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for b in batches:
            out = []
            for k, r in zip(zip(*[b[c] for c in key], strict=True), zip(*[b[c] for c in cols], strict=True), strict=True):
                if k != now:
                    if rows:
                        out += finish(now, rows)
                    now, rows = k, []
                rows.append(r)
            if out:
                yield pd.DataFrame(out)
        if rows and (out := finish(now, rows)):
            yield pd.DataFrame(out)

    return run


def _profile(rows: list[tuple], text: bool, mode: str) -> Profile:
    """Progressive alignment of (value, score, id, ...), best vote first."""
    p = Profile(mode)
    for value, score, rid, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        p.add(_cut(value, text), (score, rid))
    return p


def _whole(mode: str, key: list[str]):
    """The survivor of a group whose values fit one backbone."""

    def finish(k: tuple, rows: list) -> list[dict]:
        text = k[-1]
        if len(rows) > 1:
            agreed = _profile(rows, text, mode).consensus()
            rows = [min(rows, key=lambda r: (distance(_cut(r[0], text), agreed), r[1], r[2]))]
        return [dict(zip(key, k[:-1], strict=True)) | {"value": rows[0][0], "from_id": rows[0][3]}]

    return _grouped([*key, "text"], ["value", "score", "id", "from_id"], finish)


def _columns(mode: str, key: list[str]):
    """The columns of a wide group: the tokens of each, as JSON."""

    def finish(k: tuple, rows: list) -> list[dict]:
        p = _profile(rows, k[-1], mode)
        return [dict(zip(key, k[:-1], strict=True)) | {"shape": json.dumps([[t for t in c if t is not None] for c in p.columns])}]

    return _grouped([*key, "text"], ["value", "score", "id"], finish)


def _votes(mode: str, key: list[str]):
    """One part of a wide group, behind its columns: its votes as (col, ins, token, score, id)."""

    def finish(k: tuple, rows: list) -> list[dict]:
        shape = [frozenset(c) for c in json.loads(rows[0][4])]
        out: dict[tuple[int, int], dict] = {}
        for value, score, rid, text, _ in rows[1:]:
            col, ins = 0, 0
            for i, j in align(shape, _cut(value, text)):
                if i >= 0:
                    add_vote(out.setdefault((i, OWN), {}), value_at(value, text, j), (score, rid), mode)
                    col, ins = i + 1, 0
                else:
                    add_vote(out.setdefault((col, ins), {}), value_at(value, text, j), (score, rid), mode)
                    ins += 1
        own = dict(zip(key, k[:-1], strict=True))
        return [own | {"col": c, "ins": n, "token": t, "score": s, "id": i} for (c, n), votes in out.items() for t, (s, i) in votes.items()]

    def value_at(value: str, text: bool, j: int) -> str | None:
        if j < 0:
            return None
        if last[0] != value:
            last[:] = [value, _cut(value, text)]
        return last[1][j]

    last: list = [None, None]
    return _grouped([*key, "part"], ["value", "score", "id", "text", "head"], finish)


def _far(key: list[str]):
    """One part of a wide group, behind its consensus: each value's distance to it."""

    def finish(k: tuple, rows: list) -> list[dict]:
        agreed = json.loads(rows[0][5])
        own = dict(zip(key, k[:-1], strict=True))
        return [own | {"value": v, "score": s, "id": i, "from_id": f, "far": distance(_cut(v, t), agreed)} for v, s, i, t, f, _ in rows[1:]]

    return _grouped([*key, "part"], ["value", "score", "id", "text", "from_id", "head"], finish)


def _behind(heads: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Each part of a wide group behind one copy of its head (a column ``head``), sorted for a stream."""
    copies = heads.select(*key, "head", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1)).alias("part"), F.lit(0).alias("side"))
    body = rows.select(*key, "value", "score", "id", "text", "from_id", "part", F.lit(1).alias("side"))
    both = copies.unionByName(body, allowMissingColumns=True)
    return both.repartition(*key, "part").sortWithinPartitions(*key, "part", "side", "score", "id")


def _aligned(scratch: Scratch, votes: DataFrame, key: list[str], mode: str) -> DataFrame:
    keys = ", ".join(f"{c} {t}" for c, t in votes.select(*key).dtypes)
    counts = votes.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > BACKBONE).withColumn("n_parts", F.ceil(F.col("n") / PART)).drop("n")
    counts = scratch.save(counts, "wide")
    none_wide = not any_rows(counts)
    narrow = votes if none_wide else votes.join(counts, key, "left_anti")
    order = [*key, "text"]
    done = narrow.repartition(*key).sortWithinPartitions(*order, "score", "id").mapInPandas(_whole(mode, key), f"{keys}, value string, from_id string")
    if none_wide:
        return done
    wide = votes.join(counts, key).withColumn("part", F.pmod(F.xxhash64("value"), F.col("n_parts"))).drop("n_parts")
    first = wide.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("score", "id"))).filter(F.col("_n") <= BACKBONE)
    shapes = first.repartition(*key).sortWithinPartitions(*order, "score", "id").mapInPandas(_columns(mode, key), f"{keys}, shape string")
    heads = scratch.save(shapes.join(counts, key).withColumnRenamed("shape", "head"), "shapes")
    cast = scratch.save(_behind(heads, wide, key).mapInPandas(_votes(mode, key), f"{keys}, col bigint, ins bigint, token string, score double, id string"), "cast")
    agreed = scratch.save(_agreed(cast, wide, key, mode).join(counts, key), "agreed")
    near = _behind(agreed, wide, key).mapInPandas(_far(key), f"{keys}, value string, score double, id string, from_id string, far bigint")
    return done.unionByName(near.groupBy(*key).agg(F.min_by(F.struct("value", "from_id"), F.struct("far", "score", "id")).alias("s")).select(*key, "s.*"))


def _agreed(cast: DataFrame, wide: DataFrame, key: list[str], mode: str) -> DataFrame:
    """(*key, head): the consensus of each wide group, as JSON.

    In an inserted column all values without a token there vote for the gap: what is left of the
    group's total with ``sum``, the most trusted record (unless it has one there) with ``rank``.
    """
    vote = F.struct("score", F.col("token").isNotNull().alias("token_last"), "id", "token")
    add = F.sum("score") if mode == "sum" else F.min("score")
    # with rank the id of the best vote goes with its score; with sum the smallest id breaks ties
    first = F.min("id") if mode == "sum" else F.min(F.struct("score", "id"))["id"]
    by_token = cast.groupBy(*key, "col", "ins", "token").agg(add.alias("_s"), first.alias("_i")).withColumnsRenamed({"_s": "score", "_i": "id"})
    columns = by_token.groupBy(*key, "col", "ins").agg(F.min(vote).alias("b"), F.sum("score").alias("s"))
    whole = wide.groupBy(*key).agg(F.sum("score").alias("all"), F.min(F.struct("score", "id")).alias("top"))
    wins = (F.col("b.score") < F.col("all") - F.col("s")) if mode == "sum" else F.struct(F.col("b.score").alias("score"), F.col("b.id").alias("id")) == F.col("top")
    kept = columns.join(whole, key).filter(F.col("b.token").isNotNull() & ((F.col("ins") == OWN) | wins))
    words = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("col", "ins", F.col("b.token").alias("token")))).alias("w"))
    return whole.select(*key).join(words, key, "left").select(*key, F.to_json(F.coalesce(F.transform("w", lambda x: x["token"]), F.array().cast("array<string>"))).alias("head"))


#: The statuses a memory may have.
STATUSES = ("active", "pending_review", "flagged", "superseded", "archived")


def memory_survivors(spark: SparkSession, memories: DataFrame) -> DataFrame:
    """Survivors of memories ingested again from one source chunk: created_at and status."""
    now = current_memories(memories, {"source_id": norm_id(F.col("provenance.source_id")), "chunk_index": F.col("provenance.chunk_index"), "created_at": F.col("created_at"), "status": F.col("status"), "updated_at": F.col("updated_at")})
    year = F.year("created_at")
    rules = [
        FieldRule("created_at", F.unix_micros("created_at"), year.between(2015, 2029), F.unix_micros("created_at")),
        FieldRule("status", F.lower(strip(F.col("status"))), F.lower(strip(F.col("status"))).isin(*STATUSES), F.unix_micros("updated_at")),
    ]
    return survivors(spark, now, ["agent_id", "source_id", "chunk_index"], "memory_id", rules)


def conflict_survivors(spark: SparkSession, conflicts: DataFrame) -> DataFrame:
    """Survivors of conflicts reported more than once for a pair: confidence and description."""
    a, b = norm_id(F.col("memory_a_id")), norm_id(F.col("memory_b_id"))
    now = current_conflicts(conflicts, {"lo": F.least(a, b), "hi": F.greatest(a, b), "whole": a.isNotNull() & b.isNotNull(), "confidence": F.col("confidence"), "description": F.col("description")}).filter("whole and lo <> hi")
    usable = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    trust = F.when(usable, F.col("confidence"))
    rules = [
        FieldRule("confidence", F.col("confidence"), usable, trust),
        FieldRule("description", F.col("description"), strip(F.col("description")) != "", trust, text=True),
    ]
    return survivors(spark, now, ["agent_id", "lo", "hi"], "conflict_id", rules)


def weights(filled: list[str], at: Column, newest: Column, trust: Column, half_life_days: float = 365.0) -> Column:
    """A record's weight: the share of ``filled`` columns it has, halved for every half-life it is older
    than the newest time, times its trust."""
    share = sum((F.col(c).isNotNull().cast("double") for c in filled), F.lit(0.0)) / len(filled)
    days = F.greatest(F.lit(0.0), (F.unix_micros(newest) - F.unix_micros(at)) / F.lit(86400e6))
    return F.coalesce(share * F.pow(F.lit(0.5), days / half_life_days) * trust, F.lit(0.0))


def consensus_survivors(spark: SparkSession, memories: DataFrame, conflicts: DataFrame, as_of: Column) -> DataFrame:
    """(table_name, agent_id, group_id, field, value, from_id) by weighted majority instead of rank.

    The weight of a record is completeness times recency times trust (of a memory: active or not, of
    a conflict: its confidence); records without a usable time, or without trust, weigh nothing but
    stay candidates.  Groups are those of ``all_survivors``.
    """
    text = lambda c: strip(F.col(c)) != ""
    mem = current_memories(memories, {"source_id": norm_id(F.col("provenance.source_id")), "chunk_index": F.col("provenance.chunk_index"), "created_at": F.col("created_at"), "updated_at": F.col("updated_at"), "importance": F.col("importance"), "metadata": F.col("metadata"), "text": F.col("text"), "status": code(F.col("status"))})
    w = weights(["created_at", "updated_at", "importance", "metadata", "text"], F.col("updated_at"), as_of, F.when(F.col("status") == "active", 1.0).otherwise(0.5))
    rules = [
        FieldRule("text", F.col("text"), text("text"), w, text=True),
        FieldRule("status", F.col("status"), F.col("status").isin(*STATUSES), w),
        FieldRule("created_at", F.unix_micros("created_at"), F.year("created_at").between(2015, 2029), w),
    ]
    m = survivors(spark, mem, ["agent_id", "source_id", "chunk_index"], "memory_id", rules, "sum")
    a, b = norm_id(F.col("memory_a_id")), norm_id(F.col("memory_b_id"))
    con = current_conflicts(conflicts, {"lo": F.least(a, b), "hi": F.greatest(a, b), "whole": a.isNotNull() & b.isNotNull(), "detected_at": F.col("detected_at"), "confidence": F.col("confidence"), "description": F.col("description"), "conflict_type": code(F.col("conflict_type"))}).filter("whole and lo <> hi")
    usable = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    w = weights(["detected_at", "confidence", "description", "conflict_type"], F.col("detected_at"), as_of, F.when(usable, F.col("confidence")).otherwise(0.0))
    rules = [
        FieldRule("description", F.col("description"), text("description"), w, text=True),
        FieldRule("conflict_type", F.col("conflict_type"), F.col("conflict_type").isNotNull(), w),
        FieldRule("confidence", F.col("confidence"), usable, w),
    ]
    c = survivors(spark, con, ["agent_id", "lo", "hi"], "conflict_id", rules, "sum")
    cols = ["agent_id", "group_id", "field", "value", "from_id"]
    return m.select(F.lit("memories").alias("table_name"), *cols).unionByName(c.select(F.lit("conflicts").alias("table_name"), *cols))


def all_survivors(spark: SparkSession, memories: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(table_name, agent_id, group_id, field, value, from_id) of both tables."""
    cols = ["agent_id", "group_id", "field", "value", "from_id"]
    return memory_survivors(spark, memories).select(F.lit("memories").alias("table_name"), *cols).unionByName(conflict_survivors(spark, conflicts).select(F.lit("conflicts").alias("table_name"), *cols))
