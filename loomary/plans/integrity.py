"""Queries of the general data-processing operators: hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, orphans
from ..session import Scratch
from ..sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    nodes = hierarchy.resolve(spark, hierarchy.memory_links(table(spark, root, "memories")))
    return nodes.select("agent_id", F.col("node").alias("memory_id"), "root_id", "depth")


def p3_descendants(spark: SparkSession, root: str) -> DataFrame:
    nodes = hierarchy.resolve(spark, hierarchy.memory_links(table(spark, root, "memories")), paths=True)
    return hierarchy.descendants(nodes)


def p3_paths(spark: SparkSession, root: str) -> DataFrame:
    nodes = hierarchy.resolve(spark, hierarchy.memory_links(table(spark, root, "memories")), paths=True)
    return nodes.select("agent_id", F.col("node").alias("memory_id"), "root_id", "depth", F.concat_ws(">", "path").alias("path"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    found = orphans.orphans(table(spark, root, "memories"), table(spark, root, "conflicts"))
    return found.select("table_name", "field", "version_seq", "reason", "period")


#: Batches in which the logs are replayed.
P5_BATCHES = 4


def p5_replayed(spark: SparkSession, root: str) -> DataFrame:
    """The same references from counters maintained over several batches of both logs."""
    state = orphans.ReferenceState(spark, Scratch(spark, "state").root)
    found = orphans.replayed(state, table(spark, root, "memories"), table(spark, root, "conflicts"), P5_BATCHES)
    return found.select("table_name", "field", "version_seq", "reason", "period")


def p5_keys(spark: SparkSession, root: str) -> DataFrame:
    """The orphan keys of the counters, with the references each has."""
    state = orphans.ReferenceState(spark, Scratch(spark, "state").root)
    orphans.replayed(state, table(spark, root, "memories"), table(spark, root, "conflicts"), P5_BATCHES)
    return orphans.orphan_keys(state.counts()).select("agent_id", F.col("key").alias("memory_id"), "refs", (F.col("ever") > 0).alias("was_there"))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphans.report(orphans.orphans(table(spark, root, "memories"), table(spark, root, "conflicts")))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p5_found": p5_found, "p5_replayed": p5_replayed, "p5_keys": p5_keys, "p5_report": p5_report}

_MEM = """mem_all AS (SELECT * FROM (SELECT *, lower(trim(memory_id)) AS mid, row_number() OVER (PARTITION BY agent_id, lower(trim(memory_id)) ORDER BY version_seq DESC) AS rn FROM memories) WHERE rn = 1),
mem AS (SELECT * FROM mem_all WHERE op IS DISTINCT FROM 'delete')"""
_CONF = """conf AS (SELECT * FROM (SELECT *, lower(trim(conflict_id)) AS cid, row_number() OVER (PARTITION BY agent_id, lower(trim(conflict_id)) ORDER BY version_seq DESC) AS rn FROM conflicts) WHERE rn = 1 AND op IS DISTINCT FROM 'delete')"""

_ORPHANS = f"""{_MEM}, {_CONF},
refs AS (
  SELECT 'conflicts' AS table_name, 'memory_a_id' AS field, agent_id, nullif(lower(trim(memory_a_id)), '') AS k, version_seq, detected_at AS ts FROM conf
  UNION ALL SELECT 'conflicts', 'memory_b_id', agent_id, nullif(lower(trim(memory_b_id)), ''), version_seq, detected_at FROM conf
  UNION ALL SELECT 'memories', 'superseded_by', agent_id, nullif(lower(trim(superseded_by)), ''), version_seq, updated_at FROM mem),
judged AS (
  SELECT r.table_name, r.field, r.version_seq, strftime(r.ts AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN m.mid IS NULL THEN 'missing' WHEN m.op = 'delete' THEN 'deleted' WHEN m.first_seq > r.version_seq THEN 'late' END AS reason
  FROM refs r LEFT JOIN mem_all m ON m.agent_id = r.agent_id AND m.mid = r.k WHERE r.k IS NOT NULL)"""

_LINKS = f"""{_MEM},
said AS (SELECT m.agent_id, m.mid AS child, p.mid AS parent, 0 AS rk FROM mem m JOIN mem p ON p.agent_id = m.agent_id AND p.mid = lower(trim(m.superseded_by))),
listed AS (SELECT l.agent_id, c.mid AS child, l.mid AS parent, 1 AS rk FROM (SELECT agent_id, mid, lower(trim(unnest(supersedes))) AS d FROM mem) l JOIN mem c ON c.agent_id = l.agent_id AND c.mid = l.d),
links AS (SELECT agent_id, child, parent FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, child ORDER BY rk, parent) AS n FROM (SELECT * FROM said UNION ALL SELECT * FROM listed)) WHERE n = 1),
walk AS (
  SELECT agent_id, child AS node, parent AS cur, 1 AS d, [child] AS seen FROM links
  UNION ALL SELECT w.agent_id, w.node, l.parent, w.d + 1, list_append(w.seen, w.cur) FROM walk w JOIN links l ON l.agent_id = w.agent_id AND l.child = w.cur WHERE NOT list_contains(w.seen, w.cur)),
ends AS (SELECT *, list_contains(seen, cur) AS cyclic, row_number() OVER (PARTITION BY agent_id, node ORDER BY d DESC) AS n FROM walk),
nodes AS (
  SELECT agent_id, node AS memory_id, CASE WHEN cyclic THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id, CASE WHEN cyclic THEN -1 ELSE d END::BIGINT AS depth,
    CASE WHEN NOT cyclic THEN list_concat([cur], list_reverse(seen)) END AS path
  FROM ends WHERE n = 1
  UNION ALL SELECT DISTINCT agent_id, cur, cur, 0::BIGINT, [cur] FROM ends WHERE n = 1 AND NOT cyclic)"""

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT agent_id, memory_id, root_id, depth FROM nodes",
    "p3_paths": f"WITH RECURSIVE {_LINKS} SELECT agent_id, memory_id, root_id, depth, coalesce(array_to_string(path, '>'), '') AS path FROM nodes",
    "p3_descendants": f"WITH RECURSIVE {_LINKS} SELECT agent_id, path[i] AS memory_id, memory_id AS descendant_id, depth - i + 1 AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM nodes WHERE depth > 0)",
    "p5_found": f"WITH {_ORPHANS} SELECT table_name, field, version_seq, reason, period FROM judged WHERE reason IS NOT NULL",
    "p5_replayed": f"WITH {_ORPHANS} SELECT table_name, field, version_seq, reason, period FROM judged WHERE reason IS NOT NULL",
    "p5_keys": f"WITH {_ORPHANS} SELECT r.agent_id, r.k AS memory_id, count(*) AS refs, bool_or(m.mid IS NOT NULL) AS was_there FROM refs r LEFT JOIN mem_all m ON m.agent_id = r.agent_id AND m.mid = r.k WHERE r.k IS NOT NULL AND (m.mid IS NULL OR m.op = 'delete') GROUP BY ALL",
    "p5_report": f"WITH {_ORPHANS} SELECT table_name, field, reason, period, count(*) AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
