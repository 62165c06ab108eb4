"""Queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import components, leakage, mixing, neardup, pii, subjects, survivor


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_survivors(spark, root).drop("value")


def p1_survivors(spark: SparkSession, root: str) -> DataFrame:
    return survivor.all_survivors(spark, table(spark, root, "memories"), table(spark, root, "conflicts"))


#: The present of the recency weights.
P1_AS_OF = "2026-07-01 00:00:00"


def p1_consensus(spark: SparkSession, root: str) -> DataFrame:
    return survivor.consensus_survivors(spark, table(spark, root, "memories"), table(spark, root, "conflicts"), F.lit(P1_AS_OF).cast("timestamp"))


#: Key of the pseudonyms; a deployment passes its own secret.
P2_KEY = b"example key of the test queries"


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "memories").select("version_seq", "text", F.col("provenance.raw_content").alias("raw_content"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = pii.scrub(spark, _texts(spark, root), ["text", "raw_content"], P2_KEY, texts=False)
    found = rows.select("version_seq", F.explode("mentions").alias("m")).select("version_seq", "m.field", "m.kind", "m.start_pos")
    return found.filter(F.col("kind").isin("name", "email", "phone", "id_number", "address")).distinct()


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    rows = pii.scrub(spark, _texts(spark, root), ["text", "raw_content"], P2_KEY)
    return rows.select("version_seq", "text", "raw_content", F.size("mentions").alias("n_mentions")).distinct()


#: Near-duplicate memories: words in a run, and similarity, as TESTDATA states them.
P4_RUN, P4_SIMILARITY = 3, 0.5


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = neardup.similar_pairs(spark, neardup.memory_texts(table(spark, root, "memories")), P4_SIMILARITY, P4_RUN)
    return pairs.select(F.col("scope").alias("agent_id"), F.col("id_a").alias("memory_a_id"), F.col("id_b").alias("memory_b_id"))


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    groups = neardup.similar_groups(spark, neardup.memory_texts(table(spark, root, "memories")), P4_SIMILARITY, P4_RUN)
    return groups.select(F.col("scope").alias("agent_id"), F.col("id").alias("memory_id"), "class_id", "n_links", "group_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return components.connected_groups(spark, components.supersession_links(table(spark, root, "conflicts")))


def p6_sizes(spark: SparkSession, root: str) -> DataFrame:
    return p6_found(spark, root).groupBy("agent_id", "group_id").agg(F.count("*").alias("n_members"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_overlap(spark, root).select("doc_id", "item_id")


def p7_overlap(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked(spark, table(spark, root, "documents"), table(spark, root, "eval_items"))


#: The domains of the sources.
P8_DOMAINS = {
    "chat_export": "conversation", "forum_archive": "conversation", "voice_transcript": "conversation", "kb_article": "knowledge", "policy_page": "knowledge",
    "eval_writeup": "knowledge", "skill_card": "knowledge", "handoff_note": "operations", "ticket_log": "operations", "tool_trace": "operations",
}


def p8_selection(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(spark, table(spark, root, "documents"), table(spark, root, "mix_targets"), domains=P8_DOMAINS)


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(p8_selection(spark, root), table(spark, root, "mix_targets"))


def p8_budget(spark: SparkSession, root: str) -> DataFrame:
    """As many tokens as there are: small sources run short, and their siblings take over."""
    return mixing.mix(spark, table(spark, root, "documents"), table(spark, root, "mix_targets"), domains=P8_DOMAINS, corpora=1.0)


def p8_budget_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(p8_budget(spark, root), table(spark, root, "mix_targets"))


def _areas(spark: SparkSession, root: str) -> DataFrame:
    return subjects.subject_areas(spark, table(spark, root, "documents"), table(spark, root, "doc_labels"), table(spark, root, "subjects"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _areas(spark, root).select("doc_id", "subject")


def p9_composition(spark: SparkSession, root: str) -> DataFrame:
    return subjects.composition(_areas(spark, root), table(spark, root, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p1_consensus": p1_consensus,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p6_found": p6_found,
    "p6_sizes": p6_sizes,
    "p7_found": p7_found,
    "p7_overlap": p7_overlap,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_budget": p8_budget,
    "p8_budget_shares": p8_budget_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_MEM = """mem AS (SELECT * FROM (SELECT *, lower(trim(memory_id)) AS mid, row_number() OVER (PARTITION BY agent_id, lower(trim(memory_id)) ORDER BY version_seq DESC) AS rn FROM memories) WHERE rn = 1 AND op IS DISTINCT FROM 'delete')"""
_CONF = """conf AS (SELECT * FROM (SELECT *, lower(trim(conflict_id)) AS cid, nullif(lower(trim(memory_a_id)), '') AS a, nullif(lower(trim(memory_b_id)), '') AS b, row_number() OVER (PARTITION BY agent_id, lower(trim(conflict_id)) ORDER BY version_seq DESC) AS rn FROM conflicts) WHERE rn = 1 AND op IS DISTINCT FROM 'delete')"""
_SURVIVORS = f"""WITH {_MEM}, {_CONF},
m AS (SELECT *, lower(trim(provenance.source_id)) AS s, provenance.chunk_index AS c, lower(trim(status)) AS st FROM mem WHERE nullif(trim(provenance.source_id), '') IS NOT NULL AND provenance.chunk_index IS NOT NULL),
mg AS (SELECT agent_id, s, c, min(mid) AS group_id FROM m GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN confidence >= 0 AND confidence <= 1 THEN confidence END AS good FROM conf WHERE a <> b),
pg AS (SELECT agent_id, lo, hi, min(cid) AS group_id FROM p GROUP BY ALL HAVING count(*) > 1),
rows_ AS (
  SELECT 'memories' AS table_name, agent_id, group_id, 'created_at' AS field, epoch_us(created_at)::VARCHAR AS value, mid AS from_id, row_number() OVER (PARTITION BY agent_id, group_id, s, c ORDER BY created_at DESC, mid) AS n
  FROM m JOIN mg USING (agent_id, s, c) WHERE year(created_at) BETWEEN 2015 AND 2029
  UNION ALL SELECT 'memories', agent_id, group_id, 'status', st, mid, row_number() OVER (PARTITION BY agent_id, group_id, s, c ORDER BY updated_at DESC NULLS LAST, mid)
  FROM m JOIN mg USING (agent_id, s, c) WHERE st IN ('active', 'pending_review', 'flagged', 'superseded', 'archived')
  UNION ALL SELECT 'conflicts', agent_id, group_id, 'confidence', good::VARCHAR, cid, row_number() OVER (PARTITION BY agent_id, group_id, lo, hi ORDER BY good DESC, cid)
  FROM p JOIN pg USING (agent_id, lo, hi) WHERE good IS NOT NULL
  UNION ALL SELECT 'conflicts', agent_id, group_id, 'description', description, cid, row_number() OVER (PARTITION BY agent_id, group_id, lo, hi ORDER BY good DESC NULLS LAST, cid)
  FROM p JOIN pg USING (agent_id, lo, hi) WHERE regexp_matches(description, '\\S'))"""

_GROUPS = f"""WITH RECURSIVE {_CONF},
e AS (SELECT DISTINCT agent_id, a, b FROM conf WHERE a <> b AND regexp_replace(lower(trim(conflict_type)), '[\\s-]+', '_', 'g') = 'temporal_supersession'),
s AS (SELECT agent_id, a AS u, b AS v FROM e UNION SELECT agent_id, b, a FROM e),
reach AS (SELECT agent_id, u, u AS v FROM s UNION SELECT r.agent_id, r.u, s.v FROM reach r JOIN s ON s.agent_id = r.agent_id AND s.u = r.v),
groups AS (SELECT agent_id, u AS memory_id, min(v) AS group_id FROM reach GROUP BY ALL)"""

_NEAR = f"""WITH {_MEM},
w AS (SELECT agent_id, mid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM mem WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT agent_id, mid, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS s FROM w WHERE len(w) > 2),
n AS (SELECT agent_id, mid, count(*) AS n FROM sh GROUP BY ALL),
c AS (SELECT a.agent_id, a.mid AS a, b.mid AS b, count(*) AS common FROM sh a JOIN sh b ON a.agent_id = b.agent_id AND a.s = b.s AND a.mid < b.mid GROUP BY ALL)"""

_RUNS = """WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
t AS (SELECT kind, id, regexp_extract_all(lower(regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(8203), ''), '(\\p{L})-[ \\t]*\\r?\\n\\s*(\\p{L})', '\\1\\2', 'g'), '\\r', ' ', 'g')), '[\\p{L}\\p{N}]+') AS w FROM w),
r AS (SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, len(w) - 8)]) AS g FROM t WHERE len(w) >= 10),
n AS (SELECT id, count(*) AS total FROM r WHERE kind = 'i' GROUP BY ALL),
hits AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_runs FROM r d JOIN r i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)"""

ORACLE = {
    "p7_found": f"{_RUNS} SELECT doc_id, item_id FROM hits",
    "p7_overlap": f"{_RUNS} SELECT doc_id, item_id, n_runs, n_runs / total::DOUBLE AS share FROM hits JOIN n ON n.id = item_id",
    "p4_found": f"{_NEAR} SELECT c.agent_id, a AS memory_a_id, b AS memory_b_id FROM c JOIN n x ON x.agent_id = c.agent_id AND x.mid = a JOIN n y ON y.agent_id = c.agent_id AND y.mid = b WHERE common * 2 >= x.n + y.n - common",
    "p4_groups": f"""{_NEAR.replace('WITH ', 'WITH RECURSIVE ', 1)},
sets AS (SELECT agent_id, mid, string_agg(s, '|' ORDER BY s) AS whole FROM sh GROUP BY agent_id, mid),
cl AS (SELECT agent_id, mid, min(mid) OVER (PARTITION BY agent_id, whole) AS class_id FROM sets),
near AS (SELECT c.agent_id, p.class_id AS a, q.class_id AS b FROM c JOIN n x ON x.agent_id = c.agent_id AND x.mid = a JOIN n y ON y.agent_id = c.agent_id AND y.mid = b JOIN cl p ON p.agent_id = c.agent_id AND p.mid = a JOIN cl q ON q.agent_id = c.agent_id AND q.mid = b WHERE common * 2 >= x.n + y.n - common AND p.class_id <> q.class_id),
arcs AS (SELECT agent_id, a AS u, b AS v FROM near UNION SELECT agent_id, b, a FROM near),
reach AS (SELECT agent_id, class_id AS u, class_id AS v FROM cl UNION SELECT r.agent_id, r.u, s.v FROM reach r JOIN arcs s ON s.agent_id = r.agent_id AND s.u = r.v),
grp AS (SELECT agent_id, u AS class_id, min(v) AS group_id FROM reach GROUP BY agent_id, u),
deg AS (SELECT agent_id, u AS class_id, count(*) AS n_links FROM arcs GROUP BY agent_id, u)
SELECT cl.agent_id, cl.mid AS memory_id, cl.class_id, coalesce(n_links, 0) AS n_links, group_id FROM cl JOIN grp USING (agent_id, class_id) LEFT JOIN deg USING (agent_id, class_id)""",
    "p1_found": f"{_SURVIVORS} SELECT table_name, agent_id, group_id, field, from_id FROM rows_ WHERE n = 1",
    "p1_survivors": f"{_SURVIVORS} SELECT table_name, agent_id, group_id, field, value, from_id FROM rows_ WHERE n = 1",
    "p6_found": f"{_GROUPS} SELECT agent_id, memory_id, group_id FROM groups",
    "p6_sizes": f"{_GROUPS} SELECT agent_id, group_id, count(*) AS n_members FROM groups GROUP BY ALL",
}
