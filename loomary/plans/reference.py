"""Queries of the memory-reliability operators over whole tables, and the same in SQL.

All read the current records of all tenants.  ``AS_OF`` stands for the present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge, schema
from ..evalsuite import runner
from ..functions import scalars, vector
from ..functions.text import norm_id
from ..operators import consolidate, detect, evaluate, health, lineage, provenance, records, search
from ..operators.similarity import nearest
from ..session import hold
from ..sources.tables import table
from ..streaming import ingest

AS_OF = "2026-07-01 00:00:00"
#: The engine's similarity of candidate pairs, and its health measured on all probes instead of a sample.
SIMILAR = schema.CLUSTER_SIMILARITY
WHOLE = health.HealthConfig(probes=None)


def _now():
    return F.lit(AS_OF).cast("timestamp")


def _mem(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return records.memories(table(spark, root, "memories"), columns or None)


def _held(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The same written once, for queries that read it several times."""
    return hold(_mem(spark, root, *columns), "memories")


def _conf(spark: SparkSession, root: str) -> DataFrame:
    return records.conflicts(table(spark, root, "conflicts"))


def _r(c, n: int = 8):
    return F.round(c, n)


def upsert_latest(spark, root):
    return _mem(spark, root, "status", "version_seq").select("agent_id", "memory_id", "status", "version_seq")


def list_page(spark, root):
    rows = _mem(spark, root, "status", "created_at", "first_seq").filter("agent_id = 'agent-0001' and status = 'active'")
    return rows.orderBy("created_at", "first_seq").offset(20).limit(50).select("agent_id", "memory_id", F.unix_micros("created_at").alias("created_us"))


def status_counts(spark, root):
    return _mem(spark, root, "status").groupBy("agent_id", "status").agg(F.count("*").alias("n"))


def usable_counts(spark, root):
    m = _mem(spark, root, "status", "expires_at")
    return m.groupBy("agent_id").agg(F.count_if(scalars.is_usable(_now())).alias("n_usable"), F.count_if(scalars.is_expired(_now())).alias("n_expired"), F.count("*").alias("n_all"))


def metadata_filter(spark, root):
    m = _mem(spark, root, "metadata", "first_seq").filter(scalars.matches(F.col("metadata"), {"topic": "budget"}))
    return m.select("agent_id", "memory_id", "first_seq")


def conflict_listing(spark, root):
    return _conf(spark, root).filter("resolution_status = 'pending'").select("agent_id", "conflict_id", "memory_a_id", "memory_b_id", "conflict_type", _r("confidence").alias("confidence"))


def deleted_counts(spark, root):
    from ..operators.versions import current_memories

    all_ = current_memories(table(spark, root, "memories"), {"op": F.col("op")}, deleted=True)
    return all_.groupBy("agent_id").agg(F.count_if(~F.col("live")).alias("n_deleted"), F.count_if("live").alias("n_live"))


def _vectors(spark, root):
    return table(spark, root, "embeddings").select(F.lit("all").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")).filter(vector.usable(F.col("vec")))


def knn_topk(spark, root):
    v = hold(_vectors(spark, root), "vectors")
    return nearest(v.filter("id % 20 = 0"), v, 10).select("probe", "id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_threshold(spark, root):
    v = hold(_vectors(spark, root), "vectors")
    return nearest(v.filter("id % 20 = 0"), v, None, 0.2).select("probe", "id", _r("score").alias("score"))


def distances(spark, root):
    """The nearest other vector by each of the other metrics."""
    v = hold(_vectors(spark, root), "vectors")
    best = lambda m, name: nearest(v.filter("id % 20 = 0"), v, 2, metric=m).filter("probe <> id").groupBy("probe").agg((F.max if m == "dot" else F.min)("score").alias(name))
    j = best("euclid", "euclidean").join(best("manhattan", "manhattan"), "probe").join(best("dot", "dot"), "probe")
    return j.select("probe", *[_r(c).alias(c) for c in ("euclidean", "manhattan", "dot")])


def _probes(m: DataFrame) -> DataFrame:
    """Every row whose write number is divisible by 20."""
    return m.filter(F.pmod(F.floor(F.col("first_seq") / 100), F.lit(20)) == 0).select("agent_id", F.col("first_seq").alias("probe"), "embedding")


def search_topk(spark, root):
    m = _held(spark, root, "embedding", "first_seq")
    return search.search_many(m, _probes(m), 10).select("agent_id", "probe", "memory_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def search_enriched(spark, root):
    m = _held(spark, root, "embedding", "first_seq", "status", "superseded_by", "created_at")
    hits = search.enrich(hold(search.search_many(m, _probes(m), 10), "hits"), m, _conf(spark, root))
    return hits.select("agent_id", "probe", "memory_id", F.col("rank").cast("bigint").alias("rank"), "conflict_flag", F.size("conflicts_with").cast("bigint").alias("n_conflicts"), "conflict_summary", "recommended")


def freshness(spark, root):
    f = health.freshness(_mem(spark, root, "status", "expires_at", "updated_at", "importance", "has_provenance"), _now())
    return f.select("agent_id", "total_memories", "stale_count", *[_r(c).alias(c) for c in ("freshness_score", "provenance_completeness", "avg_importance", "oldest_age_days")])


def stale_ids(spark, root):
    return health.stale(_mem(spark, root, "status", "expires_at", "updated_at"), _now())


def candidate_pairs(spark, root):
    p = health.close_pairs(_held(spark, root, "status", "expires_at", "embedding", "first_seq"), _now(), SIMILAR)
    return p.select("agent_id", "seq_a", "seq_b", _r("similarity").alias("similarity"))


def contradiction_score(spark, root):
    m = _held(spark, root, "status", "expires_at", "embedding", "first_seq")
    c = health.contradictions(m, _now(), hold(health.close_pairs(m, _now(), SIMILAR), "pairs"))
    return c.select("agent_id", "n_valid", "n_involved", "n_pairs", _r("contradiction_score").alias("contradiction_score"), _r("embedding_coverage").alias("embedding_coverage"))


def confidence_gap(spark, root):
    """Every usable memory with a vector is a probe."""
    g = health.confidence_gap(_held(spark, root, "status", "expires_at", "embedding", "first_seq"), _now(), WHOLE)
    return g.select("agent_id", _r("confidence_accuracy_gap").alias("confidence_accuracy_gap"), "n_probed")


def health_scores(spark, root):
    m = _held(spark, root, "status", "expires_at", "embedding", "first_seq", "updated_at", "importance", "has_provenance")
    h = health.health(m, _conf(spark, root), _now(), WHOLE)
    return h.select("agent_id", "total_memories", "stale_count", "conflict_count", *[_r(c).alias(c) for c in ("freshness_score", "contradiction_score", "confidence_accuracy_gap", "score")], "risk_level")


def new_conflicts(spark, root):
    m = _held(spark, root, "status", "expires_at", "embedding", "first_seq")
    s = detect.scan(m, _conf(spark, root), _now(), similarity=SIMILAR)
    return s.select("agent_id", "memory_a_id", "memory_b_id", "conflict_type", _r("confidence").alias("confidence"))


def store_conflicts(spark, root):
    """Every memory as the new one, at the time of its writing."""
    m = _held(spark, root, "embedding", "first_seq")
    s = detect.on_store(m, m, similarity=SIMILAR)
    return s.select("agent_id", "memory_a_id", "memory_b_id", "conflict_type", _r("confidence").alias("confidence"))


def components(spark, root):
    rows = consolidate.joined_pending(_mem(spark, root, "created_at", "importance"), _conf(spark, root))
    return consolidate.chains(spark, rows).select("agent_id", "memory_id", "component", "size")


def _plan(spark, root):
    m = _held(spark, root, "created_at", "importance", "status", "superseded_by", "supersedes")
    c = _conf(spark, root)
    return m, c, consolidate.plan(spark, m, c)


def plan_actions(spark, root):
    _, _, a = _plan(spark, root)
    return a.select("agent_id", "action_seq", "action_type", "tier", _r("confidence").alias("confidence"), F.concat_ws(",", "source_memory_ids").alias("sources"), "reasoning")


def plan_preflight(spark, root):
    m, c, a = _plan(spark, root)
    return consolidate.preflight(a, m, c).groupBy("agent_id", "problem").agg(F.count("*").alias("n"))


def execute_effects(spark, root):
    m, _, a = _plan(spark, root)
    changed, _ = consolidate.effects(a, m)
    return changed.select("agent_id", "memory_id", "status", F.when(F.startswith("superseded_by", F.lit("merged-")), F.lit("merged")).otherwise(F.col("superseded_by")).alias("superseded_by"), F.concat_ws(",", "supersedes").alias("supersedes"), _r("importance").alias("importance"))


def execute_resolutions(spark, root):
    _, c, a = _plan(spark, root)
    return consolidate.resolved(a, c).select("agent_id", "conflict_id", "resolution_status")


def skipped_conflicts(spark, root):
    return consolidate.skipped(_mem(spark, root, "created_at", "importance"), _conf(spark, root)).select("agent_id", "conflict_id")


def _actions(spark, root):
    return table(spark, root, "actions").dropDuplicates(["agent_id", "action_id"])


def action_counts(spark, root):
    return _actions(spark, root).groupBy("action_type", "tier").agg(F.count("*").alias("n"), F.count("executed_at").alias("n_executed"))


def plan_views(spark, root):
    v = consolidate.views(_actions(spark, root))
    parts = [d.groupBy("agent_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("view"), "agent_id", "n") for k, d in v.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_sources(spark, root):
    named = _actions(spark, root).select("agent_id", "action_id", F.explode("source_memory_ids").alias("s")).select("agent_id", "action_id", norm_id(F.col("s")).alias("memory_id"))
    return named.join(_mem(spark, root, "first_seq"), ["agent_id", "memory_id"], "left_anti").select("agent_id", "action_id", "memory_id").distinct()


def lineage_chains(spark, root):
    m = _held(spark, root, "superseded_by", "supersedes", "created_at")
    return lineage.lineage(spark, m).filter(F.size("chain") > 1).select("agent_id", "memory_id", F.concat_ws(">", "chain").alias("chain"))


def manifest(spark, root):
    m = provenance.manifest(_mem(spark, root))
    return m.select("agent_id", "memory_id", "record_id", "source_type", "source_id", "ingested_by", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.unix_micros("ingested_at").alias("ingested_us"))


def provenance_json(spark, root):
    """Fields read back from the JSON documents."""
    v = scalars.json_value
    d = provenance.export_json(_mem(spark, root))
    return d.select("agent_id", "memory_id", *[v(F.col("document"), c).alias(c) for c in ("record_id", "source_type", "source_id", "raw_content", "text", "status")], v(F.col("document"), "chunk_index", "bigint").alias("chunk_index"), _r(v(F.col("document"), "importance", "double")).alias("importance"))


def document_view(spark, root):
    return provenance.document_view(_mem(spark, root, "text", "metadata"))


def contains_snippet(spark, root):
    """The best hit of each search whose text holds a snippet."""
    m = _held(spark, root, "embedding", "first_seq", "text")
    return search.first_with(search.search_many(m, _probes(m), 10), m, "Phone Line").select("agent_id", "probe", "memory_id", F.col("rank").cast("bigint").alias("rank"))


def pair_records(spark, root):
    c = hold(records.pending(_conf(spark, root)), "pending")
    key = ["agent_id", "lo", "hi"]
    pick = lambda which, name: consolidate.best_record(c, which).select(*key, F.col("conflict_id").alias(name))
    n = c.groupBy(*key).agg(F.count("*").alias("n"))
    return pick("first", "first_record").join(pick("last", "last_record"), key).join(pick("surest", "best_record"), key).join(n, key)


def invalid_memories(spark, root):
    return schema.violations(table(spark, root, "memories"), schema.memory_rules())


def invalid_conflicts(spark, root):
    return schema.violations(table(spark, root, "conflicts"), schema.conflict_rules())


def invalid_actions(spark, root):
    return schema.violations(table(spark, root, "actions"), schema.action_rules())


def _cases(spark, root):
    return table(spark, root, "case_results").distinct()


def category_scores(spark, root):
    return evaluate.category_scores(_cases(spark, root))


def overall_score(spark, root):
    return evaluate.overall(_cases(spark, root))


def failed_cases(spark, root):
    return evaluate.failures(_cases(spark, root)).select("case_name", "category", _r("score").alias("score"))


def repeated_cases(spark, root):
    return evaluate.repeated_names(table(spark, root, "case_results"))


def invalid_cases(spark, root):
    return schema.violations(_cases(spark, root), schema.case_rules())


def naive_view(spark, root):
    m = runner.naive(_mem(spark, root))
    return m.groupBy("agent_id").agg(F.count("*").alias("n"), F.count_if(vector.usable(F.col("embedding"))).alias("n_searchable"), F.sum(F.length("text")).alias("n_chars"))


def access_stats(spark, root):
    return ingest.access_counts(table(spark, root, "events")).select("user_id", "n", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


def chat_history(spark, root):
    h = bridge.history(_mem(spark, root, "memory_type", "created_at", "first_seq", "metadata", "text"))
    return h.select("agent_id", "memory_id", F.col("turn").cast("bigint").alias("turn"))


def importance_rank(spark, root):
    m = _held(spark, root, "embedding", "first_seq", "importance", "access_count", "last_accessed")
    r = search.by_importance(search.search_many(m, _probes(m), 10), m, _now())
    return r.select("agent_id", "probe", "memory_id", _r("merit").alias("merit"), F.col("rank").cast("bigint").alias("rank"))


_NAMES = """upsert_latest list_page status_counts usable_counts metadata_filter conflict_listing deleted_counts knn_topk knn_threshold distances search_topk search_enriched
freshness stale_ids candidate_pairs contradiction_score confidence_gap health_scores new_conflicts store_conflicts  components plan_actions plan_preflight execute_effects
execute_resolutions skipped_conflicts action_counts plan_views orphan_sources lineage_chains manifest provenance_json document_view contains_snippet pair_records
invalid_memories invalid_conflicts invalid_actions category_scores overall_score failed_cases repeated_cases invalid_cases naive_view access_stats chat_history importance_rank""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_T = f"TIMESTAMPTZ '{AS_OF}+00'"
_MEM = """mem AS (
  SELECT agent_id, lower(trim(memory_id)) AS memory_id, memory_type, text, embedding, metadata, created_at, updated_at, expires_at, importance, access_count, last_accessed, provenance, first_seq, version_seq,
    CASE WHEN st IN ('active', 'superseded', 'flagged', 'archived', 'pending_review') THEN st ELSE 'unknown' END AS status, nullif(lower(trim(superseded_by)), '') AS superseded_by,
    [lower(trim(x)) FOR x IN coalesce(supersedes, []) IF nullif(trim(x), '') IS NOT NULL] AS supersedes
  FROM (SELECT *, regexp_replace(lower(trim(status)), '[\\s-]+', '_', 'g') AS st, row_number() OVER (PARTITION BY agent_id, lower(trim(memory_id)) ORDER BY version_seq DESC) AS rn FROM memories) WHERE rn = 1 AND op IS DISTINCT FROM 'delete')"""
_CONF = """conf AS (
  SELECT *, least(memory_a_id, memory_b_id) AS lo, greatest(memory_a_id, memory_b_id) AS hi FROM (
    SELECT agent_id, lower(trim(conflict_id)) AS conflict_id, nullif(lower(trim(memory_a_id)), '') AS memory_a_id, nullif(lower(trim(memory_b_id)), '') AS memory_b_id,
      CASE WHEN ct IN ('direct_contradiction', 'temporal_supersession', 'partial_conflict') THEN ct ELSE 'unknown' END AS conflict_type, CASE WHEN confidence >= 0 AND confidence <= 1 THEN confidence END AS confidence, description,
      CASE WHEN rs IN ('pending', 'auto_resolved', 'human_reviewed') THEN rs ELSE 'unknown' END AS resolution_status, detected_at, first_seq
    FROM (SELECT *, regexp_replace(lower(trim(conflict_type)), '[\\s-]+', '_', 'g') AS ct, regexp_replace(lower(trim(resolution_status)), '[\\s-]+', '_', 'g') AS rs, row_number() OVER (PARTITION BY agent_id, lower(trim(conflict_id)) ORDER BY version_seq DESC) AS rn FROM conflicts)
    WHERE rn = 1 AND op IS DISTINCT FROM 'delete')),
pend AS (SELECT * FROM conf WHERE resolution_status = 'pending' AND memory_a_id IS NOT NULL AND memory_b_id IS NOT NULL AND memory_a_id <> memory_b_id)"""
_USABLE = f"usable AS (SELECT * FROM mem WHERE status = 'active' AND NOT coalesce({_T} > expires_at, false))"
_OK = "(len(embedding) > 0 AND list_dot_product(embedding, embedding) > 0)"
_COS = lambda a, b: f"greatest(0, least(1, list_cosine_similarity({a}, {b})))"
_VALID = f"valid AS (SELECT * FROM usable WHERE {_OK}), pairs AS (SELECT a.agent_id, a.first_seq AS seq_a, b.first_seq AS seq_b, a.memory_id AS memory_a_id, b.memory_id AS memory_b_id, list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM valid a JOIN valid b ON a.agent_id = b.agent_id AND a.first_seq < b.first_seq WHERE list_cosine_similarity(a.embedding, b.embedding) > {SIMILAR})"
_AGE = f"(epoch_us({_T}) - epoch_us(updated_at)) / 86400e6"
_F = f"least(1, exp(-({_AGE}) * ln(2.0) / 30))"
_FRESH = f"fresh AS (SELECT agent_id, count(*) AS total_memories, CASE WHEN sum(importance) > 0 THEN sum({_F} * importance) / sum(importance) ELSE avg({_F}) END AS freshness_score, count(*) FILTER ({_F} < 0.5) AS stale_count, avg((provenance IS NOT NULL)::INT::DOUBLE) AS provenance_completeness, avg(importance) AS avg_importance, max({_AGE}) AS oldest_age_days FROM usable GROUP BY agent_id)"
_CONTRA = f"""sizes AS (SELECT agent_id, count(*) AS n_usable, count(*) FILTER ({_OK}) AS n_valid, count(embedding) AS n_vectors FROM usable GROUP BY agent_id),
inv AS (SELECT agent_id, count(DISTINCT s) AS n_involved FROM (SELECT agent_id, seq_a AS s FROM pairs UNION ALL SELECT agent_id, seq_b FROM pairs) GROUP BY agent_id),
np AS (SELECT agent_id, count(*) AS n_pairs FROM pairs GROUP BY agent_id),
contra AS (SELECT agent_id, n_valid, coalesce(n_involved, 0) AS n_involved, coalesce(n_pairs, 0) AS n_pairs, CASE WHEN n_valid < 2 THEN 0.0 ELSE coalesce(n_involved, 0) / n_valid::DOUBLE END AS contradiction_score, CASE WHEN n_valid < 2 THEN n_vectors ELSE n_valid END / n_usable::DOUBLE AS embedding_coverage FROM sizes LEFT JOIN inv USING (agent_id) LEFT JOIN np USING (agent_id))"""
_GAP = f"""probes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY md5(memory_id), memory_id) AS n, count(*) OVER (PARTITION BY agent_id) AS n_all FROM valid) WHERE n_all >= 2),
near AS (SELECT * FROM (SELECT p.agent_id, p.first_seq AS probe, m.first_seq AS seq, {_COS('p.embedding', 'm.embedding')} AS score, (m.status = 'active' AND NOT coalesce({_T} > m.expires_at, false))::INT::DOUBLE AS ok,
  row_number() OVER (PARTITION BY p.agent_id, p.first_seq ORDER BY {_COS('p.embedding', 'm.embedding')} DESC, m.first_seq) AS rank FROM probes p JOIN (SELECT * FROM mem WHERE {_OK}) m ON m.agent_id = p.agent_id) WHERE rank <= 6),
five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, probe ORDER BY rank) AS r FROM near WHERE seq <> probe) WHERE r <= 5),
gap AS (SELECT agent_id, avg(g) AS confidence_accuracy_gap, count(*) AS n_probed FROM (SELECT agent_id, probe, abs(avg(score) - avg(ok)) AS g FROM five GROUP BY agent_id, probe) GROUP BY agent_id)"""
_HITS = f"""m AS (SELECT * FROM mem WHERE {_OK}),
hits AS (SELECT * FROM (SELECT p.agent_id, p.first_seq AS probe, m.memory_id, {_COS('p.embedding', 'm.embedding')} AS score, row_number() OVER (PARTITION BY p.agent_id, p.first_seq ORDER BY {_COS('p.embedding', 'm.embedding')} DESC, m.first_seq) AS rank
  FROM m p JOIN m ON m.agent_id = p.agent_id WHERE (p.first_seq // 100) % 20 = 0) WHERE rank <= 10)"""
_VERDICT = """(CASE (seq_a // 100 + seq_b // 100) % 4 WHEN 0 THEN 'direct_contradiction' WHEN 1 THEN 'temporal_supersession' WHEN 2 THEN 'partial_conflict' ELSE 'unrelated' END)"""
_SURE = "(0.7::DOUBLE + ((seq_a // 100) * 7 + (seq_b // 100) * 13) % 31 / 100.0::DOUBLE)"
_PLAN = f"""{_MEM}, {_CONF},
jp AS (SELECT c.*, a.created_at AS ca, b.created_at AS cb, a.importance AS ia, b.importance AS ib FROM pend c JOIN mem a ON a.agent_id = c.agent_id AND a.memory_id = c.memory_a_id JOIN mem b ON b.agent_id = c.agent_id AND b.memory_id = c.memory_b_id),
s AS (SELECT agent_id, memory_a_id AS u, memory_b_id AS v FROM jp WHERE conflict_type = 'temporal_supersession' UNION SELECT agent_id, memory_b_id, memory_a_id FROM jp WHERE conflict_type = 'temporal_supersession'),
reach AS (SELECT agent_id, u, u AS v FROM s UNION SELECT r.agent_id, r.u, s.v FROM reach r JOIN s ON s.agent_id = r.agent_id AND s.u = r.v),
comp AS (SELECT agent_id, u AS memory_id, min(v) AS component, count(*) AS size FROM reach GROUP BY agent_id, u),
many AS (SELECT c.agent_id, c.component, c.size, arg_max(c.memory_id, struct_pack(t := coalesce(m.created_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), i := c.memory_id)) AS keeper, list(c.memory_id ORDER BY c.memory_id) AS ids FROM comp c JOIN mem m USING (agent_id, memory_id) WHERE c.size >= 3 GROUP BY ALL),
acts AS (
  SELECT agent_id, 0 AS phase, component AS key, NULL::VARCHAR AS conflict_id, 'chain_supersede' AS action_type, 'auto_merge' AS tier, 1.0::DOUBLE AS confidence, list_append([x FOR x IN ids IF x <> keeper], keeper) AS src, size::VARCHAR || '-version chain: ' || (size - 1)::VARCHAR || ' stale memories superseded by newest.' AS reasoning FROM many
  UNION ALL
  SELECT agent_id, 1, strftime(detected_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') || ' ' || lpad(first_seq::VARCHAR, 20, '0'), conflict_id, CASE WHEN ca IS NOT DISTINCT FROM cb THEN 'flag' ELSE 'supersede' END,
    CASE WHEN ca IS NOT DISTINCT FROM cb THEN 'human_review' WHEN confidence >= 0.92 THEN 'auto_merge' WHEN confidence >= 0.78 THEN 'auto_flag' ELSE 'human_review' END, confidence,
    CASE WHEN ca IS NOT DISTINCT FROM cb OR ca < cb THEN [memory_a_id, memory_b_id] ELSE [memory_b_id, memory_a_id] END, CASE WHEN ca IS NOT DISTINCT FROM cb THEN 'Tied created_at; manual review required.' ELSE coalesce(description, 'Newer memory supersedes older conflicting fact.') END
  FROM (SELECT jp.*, row_number() OVER (PARTITION BY jp.agent_id, lo, hi ORDER BY detected_at, first_seq) AS n FROM jp JOIN comp c ON c.agent_id = jp.agent_id AND c.memory_id = jp.memory_a_id AND c.size = 2 WHERE conflict_type = 'temporal_supersession') WHERE n = 1
  UNION ALL
  SELECT agent_id, 2, strftime(detected_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') || ' ' || lpad(first_seq::VARCHAR, 20, '0'), conflict_id, CASE WHEN confidence >= 0.9 THEN 'merge' ELSE 'flag' END,
    CASE WHEN confidence >= 0.92 THEN 'auto_merge' WHEN confidence >= 0.78 THEN 'auto_flag' ELSE 'human_review' END, confidence, [memory_a_id, memory_b_id], coalesce(description, '') FROM jp WHERE conflict_type IN ('direct_contradiction', 'partial_conflict')),
plan AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY phase, key, conflict_id NULLS FIRST) AS action_seq FROM acts)"""
_EFFECTS = f"""{_PLAN},
each AS (SELECT agent_id, action_seq, action_type, src[-1] AS keeper, unnest(src) AS memory_id, generate_subscripts(src, 1) AS pos FROM plan),
sets AS (SELECT agent_id, memory_id, action_seq, CASE WHEN action_type = 'merge' THEN 'archived' ELSE 'superseded' END AS st, CASE WHEN action_type = 'merge' THEN 'merged' ELSE keeper END AS by_ FROM each WHERE (action_type IN ('supersede', 'chain_supersede') AND memory_id <> keeper) OR action_type = 'merge'),
fin AS (SELECT agent_id, memory_id, arg_max(st, action_seq) AS st, arg_max(by_, action_seq) AS by_ FROM sets GROUP BY ALL),
gain AS (SELECT e.agent_id, e.keeper AS memory_id, list(e.memory_id ORDER BY action_seq, pos) AS gained, max(m.importance) AS most FROM each e JOIN mem m ON m.agent_id = e.agent_id AND m.memory_id = e.memory_id WHERE action_type IN ('supersede', 'chain_supersede') AND e.memory_id <> keeper GROUP BY ALL)"""

_CASES = "c AS (SELECT DISTINCT * FROM case_results)"


def _rules(tab: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({v}, false)) AS n_rows FROM {tab}" for k, v in rules.items())


ORACLE = {
    "upsert_latest": f"WITH {_MEM} SELECT agent_id, memory_id, status, version_seq FROM mem",
    "list_page": f"WITH {_MEM} SELECT agent_id, memory_id, epoch_us(created_at) AS created_us FROM mem WHERE agent_id = 'agent-0001' AND status = 'active' ORDER BY created_at NULLS FIRST, first_seq LIMIT 50 OFFSET 20",
    "status_counts": f"WITH {_MEM} SELECT agent_id, status, count(*) AS n FROM mem GROUP BY ALL",
    "usable_counts": f"WITH {_MEM} SELECT agent_id, count(*) FILTER (status = 'active' AND NOT coalesce({_T} > expires_at, false)) AS n_usable, count(*) FILTER ({_T} > expires_at) AS n_expired, count(*) AS n_all FROM mem GROUP BY ALL",
    "metadata_filter": f"WITH {_MEM} SELECT agent_id, memory_id, first_seq FROM mem WHERE CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.topic') END = 'budget'",
    "conflict_listing": f"WITH {_CONF} SELECT agent_id, conflict_id, memory_a_id, memory_b_id, conflict_type, round(confidence, 8) AS confidence FROM conf WHERE resolution_status = 'pending'",
    "deleted_counts": "SELECT agent_id, count(*) FILTER (op = 'delete') AS n_deleted, count(*) FILTER (op IS DISTINCT FROM 'delete') AS n_live FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, lower(trim(memory_id)) ORDER BY version_seq DESC) AS rn FROM memories) WHERE rn = 1 GROUP BY agent_id",
    "knn_topk": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT probe, id, round(score, 8) AS score, rank FROM (SELECT p.vec_id AS probe, e.vec_id AS id, {_COS('p.v', 'e.v')} AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_COS('p.v', 'e.v')} DESC, e.vec_id) AS rank FROM e p, e WHERE p.vec_id % 20 = 0) WHERE rank <= 10",
    "knn_threshold": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT p.vec_id AS probe, e.vec_id AS id, round({_COS('p.v', 'e.v')}, 8) AS score FROM e p, e WHERE p.vec_id % 20 = 0 AND {_COS('p.v', 'e.v')} >= 0.2",
    "distances": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT p.vec_id AS probe, round(min(list_distance(p.v, e.v)), 8) AS euclidean, round(min(list_sum([abs(p.v[i] - e.v[i]) FOR i IN range(1, len(p.v) + 1)])), 8) AS manhattan, round(max(list_dot_product(p.v, e.v)), 8) AS dot FROM e p, e WHERE p.vec_id % 20 = 0 AND p.vec_id <> e.vec_id GROUP BY ALL",
    "search_topk": f"WITH {_MEM}, {_HITS} SELECT agent_id, probe, memory_id, round(score, 8) AS score, rank FROM hits",
    "search_enriched": f"""WITH {_MEM}, {_CONF}, {_HITS},
ends AS (SELECT agent_id, memory_a_id AS memory_id, memory_b_id AS other, confidence, description, detected_at, first_seq FROM pend UNION ALL SELECT agent_id, memory_b_id, memory_a_id, confidence, description, detected_at, first_seq FROM pend),
per AS (SELECT agent_id, memory_id, count(*) AS n, arg_min(coalesce(description, chr(1)), struct_pack(c := -coalesce(confidence, -1.0), t := detected_at, s := first_seq)) AS summary FROM ends GROUP BY ALL),
h AS (SELECT hits.*, m.status, m.superseded_by, m.created_at FROM hits JOIN mem m USING (agent_id, memory_id)),
lost AS (SELECT DISTINCT a.agent_id, a.probe, CASE WHEN (a.status = 'active') <> (b.status = 'active') THEN CASE WHEN a.status = 'active' THEN b.memory_id ELSE a.memory_id END
  WHEN a.superseded_by = b.memory_id THEN a.memory_id WHEN b.superseded_by = a.memory_id THEN b.memory_id WHEN a.created_at < b.created_at THEN a.memory_id WHEN a.created_at > b.created_at THEN b.memory_id WHEN a.rank > b.rank THEN a.memory_id ELSE b.memory_id END AS memory_id
  FROM h a JOIN (SELECT DISTINCT agent_id, memory_id, other FROM ends) e USING (agent_id, memory_id) JOIN h b ON b.agent_id = a.agent_id AND b.probe = a.probe AND b.memory_id = e.other)
SELECT h.agent_id, h.probe, h.memory_id, h.rank, p.n IS NOT NULL AS conflict_flag, coalesce(p.n, 0) AS n_conflicts, nullif(p.summary, chr(1)) AS conflict_summary, l.memory_id IS NULL AS recommended
FROM h LEFT JOIN per p USING (agent_id, memory_id) LEFT JOIN lost l USING (agent_id, probe, memory_id)
WHERE NOT (h.status NOT IN ('active', 'flagged', 'pending_review') AND h.agent_id IN (SELECT agent_id FROM pend))""",
    "freshness": f"WITH {_MEM}, {_USABLE}, {_FRESH} SELECT agent_id, total_memories, stale_count, round(freshness_score, 8) AS freshness_score, round(provenance_completeness, 8) AS provenance_completeness, round(avg_importance, 8) AS avg_importance, round(oldest_age_days, 8) AS oldest_age_days FROM fresh",
    "stale_ids": f"WITH {_MEM}, {_USABLE} SELECT agent_id, memory_id FROM usable WHERE {_F} < 0.5",
    "candidate_pairs": f"WITH {_MEM}, {_USABLE}, {_VALID} SELECT agent_id, seq_a, seq_b, round(similarity, 8) AS similarity FROM pairs",
    "contradiction_score": f"WITH {_MEM}, {_USABLE}, {_VALID}, {_CONTRA} SELECT agent_id, n_valid, n_involved, n_pairs, round(contradiction_score, 8) AS contradiction_score, round(embedding_coverage, 8) AS embedding_coverage FROM contra",
    "confidence_gap": f"WITH {_MEM}, {_USABLE}, {_VALID}, {_GAP} SELECT agent_id, round(confidence_accuracy_gap, 8) AS confidence_accuracy_gap, n_probed FROM gap",
    "health_scores": f"""WITH {_MEM}, {_CONF}, {_USABLE}, {_VALID}, {_FRESH}, {_CONTRA}, {_GAP}, pd AS (SELECT agent_id, count(*) AS n_pending FROM pend GROUP BY ALL),
j AS (SELECT a.agent_id, coalesce(total_memories, 0) AS total_memories, coalesce(stale_count, 0) AS stale_count, CASE WHEN coalesce(n_pending, 0) > 0 THEN n_pending ELSE coalesce(n_pairs, 0) END AS conflict_count, coalesce(freshness_score, 1) AS f, coalesce(provenance_completeness, 1) AS p, coalesce(contradiction_score, 0) AS c, coalesce(confidence_accuracy_gap, 0) AS g
  FROM (SELECT DISTINCT agent_id FROM mem) a LEFT JOIN fresh USING (agent_id) LEFT JOIN contra USING (agent_id) LEFT JOIN gap USING (agent_id) LEFT JOIN pd USING (agent_id)),
s AS (SELECT *, 0.25 * f + 0.25 * p + 0.25 * (1 - c) + 0.25 * (1 - g) AS score FROM j)
SELECT agent_id, total_memories, stale_count, conflict_count, round(f, 8) AS freshness_score, round(c, 8) AS contradiction_score, round(g, 8) AS confidence_accuracy_gap, round(score, 8) AS score, CASE WHEN score >= 0.8 THEN 'low' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'high' ELSE 'critical' END AS risk_level FROM s""",
    "new_conflicts": f"WITH {_MEM}, {_CONF}, {_USABLE}, {_VALID} SELECT agent_id, memory_a_id, memory_b_id, {_VERDICT} AS conflict_type, round({_SURE}, 8) AS confidence FROM pairs WHERE {_VERDICT} <> 'unrelated' AND {_SURE} >= 0.8 AND NOT EXISTS (SELECT 1 FROM pend x WHERE x.agent_id = pairs.agent_id AND x.lo = least(pairs.memory_a_id, pairs.memory_b_id) AND x.hi = greatest(pairs.memory_a_id, pairs.memory_b_id))",
    "store_conflicts": f"""WITH {_MEM}, v AS (SELECT * FROM mem WHERE {_OK}),
n AS (SELECT * FROM (SELECT p.agent_id, p.first_seq AS seq_a, m.first_seq AS seq_b, p.memory_id AS memory_a_id, m.memory_id AS memory_b_id, {_COS('p.embedding', 'm.embedding')} AS score, row_number() OVER (PARTITION BY p.agent_id, p.first_seq ORDER BY {_COS('p.embedding', 'm.embedding')} DESC, m.first_seq) AS rank FROM v p JOIN v m ON m.agent_id = p.agent_id AND m.first_seq <= p.first_seq) WHERE rank <= 21 AND score >= {SIMILAR} AND seq_b < seq_a)
SELECT agent_id, memory_a_id, memory_b_id, {_VERDICT} AS conflict_type, round({_SURE}, 8) AS confidence FROM n WHERE {_VERDICT} <> 'unrelated' AND {_SURE} >= 0.8""",
    "components": f"WITH RECURSIVE {_PLAN} SELECT agent_id, memory_id, component, size FROM comp",
    "plan_actions": f"WITH RECURSIVE {_PLAN} SELECT agent_id, action_seq, action_type, tier, round(confidence, 8) AS confidence, array_to_string(src, ',') AS sources, reasoning FROM plan",
    "plan_preflight": f"WITH RECURSIVE {_PLAN}, bad AS (SELECT agent_id, 'missing source' AS problem FROM (SELECT agent_id, action_seq, unnest(src) AS i FROM plan) x WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.agent_id = x.agent_id AND m.memory_id = x.i)) SELECT agent_id, problem, count(*) AS n FROM bad GROUP BY ALL",
    "execute_effects": f"""WITH RECURSIVE {_EFFECTS}
SELECT m.agent_id, m.memory_id, coalesce(f.st, m.status) AS status, coalesce(f.by_, m.superseded_by) AS superseded_by, array_to_string(list_concat(m.supersedes, [x FOR x, i IN coalesce(gained, []) IF NOT list_contains(m.supersedes, x) AND list_position(gained, x) = i]), ',') AS supersedes, round(greatest(m.importance, coalesce(most, m.importance)), 8) AS importance
FROM mem m LEFT JOIN fin f USING (agent_id, memory_id) LEFT JOIN gain g USING (agent_id, memory_id) WHERE f.memory_id IS NOT NULL OR g.memory_id IS NOT NULL""",
    "execute_resolutions": f"""WITH RECURSIVE {_PLAN}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, lo, hi ORDER BY detected_at DESC, first_seq DESC) AS n FROM pend) WHERE n = 1),
done AS (SELECT l.agent_id, l.conflict_id, p.action_type <> 'flag' AS ok FROM last l JOIN plan p ON p.agent_id = l.agent_id AND p.phase > 0 AND list_min(p.src) = l.lo AND list_max(p.src) = l.hi
  UNION ALL SELECT l.agent_id, l.conflict_id, true FROM last l JOIN plan p ON p.agent_id = l.agent_id AND p.phase = 0 AND list_contains(p.src, l.lo) AND list_contains(p.src, l.hi) WHERE l.conflict_type = 'temporal_supersession')
SELECT agent_id, conflict_id, CASE WHEN bool_or(ok) THEN 'auto_resolved' ELSE 'pending' END AS resolution_status FROM done GROUP BY ALL""",
    "skipped_conflicts": f"WITH {_MEM}, {_CONF} SELECT agent_id, conflict_id FROM pend c WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.agent_id = c.agent_id AND m.memory_id = c.memory_a_id) OR NOT EXISTS (SELECT 1 FROM mem m WHERE m.agent_id = c.agent_id AND m.memory_id = c.memory_b_id)",
    "action_counts": "SELECT action_type, tier, count(*) AS n, count(executed_at) AS n_executed FROM (SELECT DISTINCT * FROM actions) GROUP BY ALL",
    "plan_views": " UNION ALL ".join(f"SELECT '{v}' AS view, agent_id, count(*) AS n FROM (SELECT DISTINCT * FROM actions) WHERE {w} GROUP BY ALL" for v, w in (("would_merge", "action_type = 'merge'"), ("would_supersede", "action_type = 'supersede'"), ("would_chain_supersede", "action_type = 'chain_supersede'"), ("would_flag_for_review", "action_type = 'flag'"), ("human_review_actions", "tier = 'human_review'"), ("auto_actions", "tier <> 'human_review'"))),
    "orphan_sources": f"WITH {_MEM} SELECT DISTINCT agent_id, action_id, memory_id FROM (SELECT agent_id, action_id, nullif(lower(trim(unnest(source_memory_ids))), '') AS memory_id FROM actions) a WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.agent_id = a.agent_id AND m.memory_id = a.memory_id)",
    "lineage_chains": f"""WITH RECURSIVE {_MEM},
bl AS (SELECT l.agent_id, l.child, arg_min(l.parent, struct_pack(t := coalesce(x.created_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), p := l.pos)) AS parent FROM (SELECT agent_id, memory_id AS child, unnest(supersedes) AS parent, generate_subscripts(supersedes, 1) AS pos FROM mem) l JOIN mem x ON x.agent_id = l.agent_id AND x.memory_id = l.parent WHERE l.child <> l.parent GROUP BY ALL),
fl AS (SELECT m.agent_id, m.memory_id AS child, x.memory_id AS parent FROM mem m JOIN mem x ON x.agent_id = m.agent_id AND x.memory_id = m.superseded_by WHERE m.memory_id <> x.memory_id),
wb AS (SELECT agent_id, memory_id AS start, memory_id AS cur, []::VARCHAR[] AS path FROM mem UNION ALL SELECT w.agent_id, w.start, b.parent, list_append(w.path, b.parent) FROM wb w JOIN bl b ON b.agent_id = w.agent_id AND b.child = w.cur WHERE b.parent <> w.start AND NOT list_contains(w.path, b.parent)),
wf AS (SELECT agent_id, memory_id AS start, memory_id AS cur, []::VARCHAR[] AS path FROM mem UNION ALL SELECT w.agent_id, w.start, b.parent, list_append(w.path, b.parent) FROM wf w JOIN fl b ON b.agent_id = w.agent_id AND b.child = w.cur WHERE b.parent <> w.start AND NOT list_contains(w.path, b.parent)),
j AS (SELECT b.agent_id, b.start, b.path AS back, f.path AS ahead FROM (SELECT agent_id, start, arg_max(path, len(path)) AS path FROM wb GROUP BY ALL) b JOIN (SELECT agent_id, start, arg_max(path, len(path)) AS path FROM wf GROUP BY ALL) f USING (agent_id, start)),
k AS (SELECT *, list_min([i FOR x, i IN ahead IF list_contains(back, x)]) AS met FROM j),
c AS (SELECT agent_id, start, list_concat(list_reverse(back), [start], CASE WHEN met IS NULL THEN ahead ELSE ahead[1:met - 1] END) AS chain FROM k)
SELECT agent_id, start AS memory_id, array_to_string(chain, '>') AS chain FROM c WHERE len(chain) > 1""",
    "manifest": f"WITH {_MEM} SELECT agent_id, memory_id, provenance.record_id AS record_id, provenance.source_type AS source_type, provenance.source_id AS source_id, provenance.ingested_by AS ingested_by, provenance.chunk_index::BIGINT AS chunk_index, epoch_us(provenance.ingested_at) AS ingested_us FROM mem WHERE provenance IS NOT NULL",
    "provenance_json": f"WITH {_MEM} SELECT agent_id, memory_id, provenance.record_id AS record_id, provenance.source_type AS source_type, provenance.source_id AS source_id, provenance.raw_content AS raw_content, text, status, provenance.chunk_index::BIGINT AS chunk_index, round(importance, 8) AS importance FROM mem WHERE provenance IS NOT NULL",
    "document_view": f"WITH {_MEM} SELECT text AS page_content, metadata, memory_id AS _memory_id, agent_id FROM mem",
    "contains_snippet": f"WITH {_MEM}, {_HITS} SELECT agent_id, probe, arg_min(memory_id, rank) AS memory_id, min(rank) AS rank FROM hits JOIN mem USING (agent_id, memory_id) WHERE contains(lower(text), 'phone line') GROUP BY agent_id, probe",
    "pair_records": f"WITH {_CONF} SELECT agent_id, lo, hi, arg_min(conflict_id, struct_pack(t := detected_at, s := first_seq)) AS first_record, arg_max(conflict_id, struct_pack(t := detected_at, s := first_seq)) AS last_record, arg_min(conflict_id, struct_pack(c := -coalesce(confidence, -1.0), t := detected_at, s := first_seq)) AS best_record, count(*) AS n FROM pend GROUP BY ALL",
    "invalid_memories": _rules("memories", {"agent_not_blank": "trim(agent_id) <> ''", "text_not_blank": "trim(text) <> ''", "embedding_not_empty": "embedding IS NULL OR len(embedding) > 0", "metadata_is_json": "metadata IS NULL OR json_valid(metadata)", "known_type": "memory_type IN ('conversation', 'skill', 'custom')", "known_status": "status IN ('active', 'superseded', 'flagged', 'archived', 'pending_review')", "importance_in_range": "importance >= 0 AND importance <= 1", "access_count_not_negative": "access_count >= 0", "no_self_link": "superseded_by IS DISTINCT FROM memory_id AND NOT coalesce(list_contains(supersedes, memory_id), false)", "provenance_matches": "provenance IS NULL OR provenance.memory_id IS NOT DISTINCT FROM memory_id", "chunk_not_negative": "coalesce(provenance.chunk_index >= 0, true)"}),
    "invalid_conflicts": _rules("conflicts", {"ids_not_blank": "trim(memory_a_id) <> '' AND trim(memory_b_id) <> ''", "ids_differ": "nullif(lower(trim(memory_a_id)), '') IS DISTINCT FROM nullif(lower(trim(memory_b_id)), '')", "known_type": "conflict_type IN ('direct_contradiction', 'temporal_supersession', 'partial_conflict')", "confidence_in_range": "confidence >= 0 AND confidence <= 1", "description_not_blank": "regexp_matches(description, '\\S')", "resolved_after_detected": "coalesce(resolved_at >= detected_at, true)", "resolved_has_time": "resolution_status IS NOT DISTINCT FROM 'pending' OR resolved_at IS NOT NULL"}),
    "invalid_actions": _rules("actions", {"has_sources": "len(source_memory_ids) > 0", "sources_not_blank": "len([x FOR x IN source_memory_ids IF nullif(trim(x), '') IS NULL]) = 0", "confidence_in_range": "confidence >= 0 AND confidence <= 1", "executed_after_created": "coalesce(executed_at >= created_at, true)", "executed_has_result": "executed_at IS NULL OR result_memory_id IS NOT NULL"}),
    "category_scores": f"WITH {_CASES} SELECT category, round_even(avg(score), 4) AS score, round_even(avg(passed::INT), 4) AS pass_rate, count(*) AS n_cases FROM c GROUP BY ALL",
    "overall_score": f"WITH {_CASES}, k AS (SELECT category, avg(score) AS s FROM c GROUP BY ALL), o AS (SELECT avg(s) AS s FROM k) SELECT round_even(s, 4) AS overall, CASE WHEN s >= 0.85 THEN 'low' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'high' ELSE 'critical' END AS risk, (SELECT count(*) FILTER (passed) FROM c) AS n_passed, (SELECT count(*) FROM c) AS n_cases FROM o",
    "failed_cases": f"WITH {_CASES} SELECT case_name, category, round(score, 8) AS score FROM c WHERE NOT passed",
    "repeated_cases": "SELECT case_name, count(*) AS n FROM case_results GROUP BY ALL HAVING count(*) > 1",
    "invalid_cases": f"WITH {_CASES} " + _rules("c", {"error_means_failed": "error IS NULL OR (score = 0 AND NOT passed)", "passed_by_threshold": "error IS NOT NULL OR passed IS NOT DISTINCT FROM (score >= pass_threshold)"}),
    "naive_view": f"WITH {_MEM} SELECT agent_id, count(*) AS n, count(*) FILTER ({_OK}) AS n_searchable, sum(length(text))::BIGINT AS n_chars FROM mem GROUP BY ALL",
    "access_stats": "SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM events GROUP BY ALL",
    "importance_rank": f"""WITH {_MEM}, {_HITS}, j AS (SELECT h.*, x.first_seq, 0.8::DOUBLE * score + 0.2::DOUBLE * ((coalesce(x.importance, 0.5) + (1 - 1.0::DOUBLE / (1 + coalesce(x.access_count, 0))) + greatest(0, least(1, coalesce(exp((epoch_us(x.last_accessed) - epoch_us({_T})) / 2592000e6), 0)))) / 3) AS merit FROM hits h JOIN mem x USING (agent_id, memory_id))
SELECT agent_id, probe, memory_id, round(merit, 8) AS merit, row_number() OVER (PARTITION BY agent_id, probe ORDER BY merit DESC, first_seq) AS rank FROM j""",
    "chat_history": f"WITH {_MEM} SELECT agent_id, memory_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at NULLS FIRST, first_seq) AS turn FROM mem WHERE memory_type = 'conversation'",
}

