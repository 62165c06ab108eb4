"""Further queries of the operators over whole tables, and the same in SQL.

Each calls the operator it stands for; where the tables hold no failing case, one is planted by
leaving out part of a table on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..evalsuite import cases, runner
from ..functions import scalars, vector
from ..functions.text import norm_id
from ..operators import consolidate, detect, evaluate, health, prompts, provenance, records, search
from ..session import Scratch, hold
from ..sources.store import MemoryStore
from ..sources.tables import table
from ..streaming import ingest
from . import reference as r
from .reference import _actions, _cases, _conf, _held, _mem, _now, _probes, _r


# -- consolidation


def merged_memories(spark, root):
    m, _, a = r._plan(spark, root)
    _, new = consolidate.effects(a, m)
    return new.select("agent_id", "text", "status", F.concat_ws(",", "supersedes").alias("supersedes"), _r("importance").alias("importance"))


def resolution_notes(spark, root):
    _, c, a = r._plan(spark, root)
    return consolidate.resolved(a, c).select("agent_id", "conflict_id", "resolution_status", "resolution_notes")


def archive_effects(spark, root):
    """The plan's flags carried out as archiving."""
    m, _, a = r._plan(spark, root)
    flags = a.filter("action_type = 'flag'").withColumn("action_type", F.lit("archive"))
    return consolidate.effects(flags, m)[0].select("agent_id", "memory_id", "status", "superseded_by", _r("importance").alias("importance"))


def tiered_effects(spark, root):
    """Without the actions that a person must decide."""
    m, _, a = r._plan(spark, root)
    return consolidate.effects(a, m, respect_tier=True)[0].select("agent_id", "memory_id", "status")


def planted_preflight(spark, root):
    """The plan against a store that has lost the memories of odd and the conflicts of partial kind meanwhile."""
    m, c, a = r._plan(spark, root)
    return consolidate.preflight(a, m.filter("status <> 'archived'"), c.filter("conflict_type <> 'partial_conflict'")).join(a.select("agent_id", "action_id", "action_seq"), ["agent_id", "action_id"]).select("agent_id", "action_seq", "problem")


def executed_actions(spark, root):
    """Results of the actions that were not run yet."""
    a = _actions(spark, root).filter("executed_at is null")
    e = consolidate.executed(a, _now())
    name = F.when(F.startswith("result_memory_id", F.lit("merged-")), "merged").otherwise(F.col("result_memory_id"))
    return e.select("agent_id", "action_id", name.alias("result_memory_id"), F.unix_micros("executed_at").alias("executed_us"))


# -- search, signals, sets


def hit_signals(spark, root):
    """Signal, composite and label of each enriched hit, as the scenarios score theirs."""
    h = r.search_enriched(spark, root)
    s = scalars.stale_signal(F.lit(True), F.col("conflict_flag"), F.col("recommended"))
    right = F.col("recommended").cast("double")
    h = h.withColumn("signal", s.cast("double")).withColumn("score", scalars.scenario_score(right, F.col("signal"), F.lit(1.0)))
    return h.select("agent_id", "probe", "memory_id", "signal", _r("score").alias("score"), scalars.scenario_risk(F.col("score")).alias("risk"))


def invalid_hits(spark, root):
    m = _held(spark, root, "embedding", "first_seq", "status", "superseded_by", "created_at")
    hits = search.enrich(hold(search.search_many(m, _probes(m), 10), "hits"), m, _conf(spark, root))
    return schema.violations(hits, schema.hit_rules())


def retrieval_overlap(spark, root):
    """Of the memories that share a probe's source, how many its hits hold, and whether all of them."""
    m = hold(_mem(spark, root, "embedding", "first_seq", "provenance").select("agent_id", "memory_id", "embedding", "first_seq", norm_id(F.col("provenance.source_id")).alias("source")), "memories")
    hits = search.search_many(m, _probes(m), 10).select("agent_id", "probe", "memory_id")
    of = m.filter("source is not null").select("agent_id", "memory_id", "source")
    expected = _probes_source(m).join(of, ["agent_id", "source"]).select("agent_id", "probe", "memory_id")
    found = expected.join(hits.withColumn("hit", F.lit(1)), ["agent_id", "probe", "memory_id"], "left")
    return found.groupBy("agent_id", "probe").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found"), (F.count("*") == F.count("hit")).alias("all_found"))


def _probes_source(m: DataFrame) -> DataFrame:
    return _probes(m).join(m.select("agent_id", F.col("first_seq").alias("probe"), "source"), ["agent_id", "probe"]).filter("source is not null").select("agent_id", "probe", "source")


def two_hops(spark, root):
    """Union of two searches: a probe's hits, and those of its best other hit."""
    m = _held(spark, root, "embedding", "first_seq")
    one = hold(search.search_many(m, _probes(m), 3), "hits")
    named = m.select("agent_id", "memory_id", "first_seq", "embedding")
    other = one.join(named, ["agent_id", "memory_id"]).filter("first_seq <> probe")
    best = other.groupBy("agent_id", "probe").agg(F.min_by(F.struct("first_seq", "embedding"), F.struct(F.col("rank"))).alias("b"))
    via = best.select("agent_id", "probe", F.col("b.first_seq").alias("via"))
    two = search.search_many(m, best.select("agent_id", F.col("b.first_seq").alias("probe"), F.col("b.embedding").alias("embedding")).dropDuplicates(["agent_id", "probe"]), 3)
    second = via.join(two.withColumnRenamed("probe", "via"), ["agent_id", "via"]).select("agent_id", "probe", "memory_id")
    return one.select("agent_id", "probe", "memory_id").unionByName(second).distinct()


def search_metrics(spark, root):
    """The five nearest memories by dot product and by Euclidean distance."""
    m = _held(spark, root, "embedding", "first_seq")
    part = lambda k: search.search_many(m, _probes(m), 5, metric=k).select(F.lit(k).alias("metric"), "agent_id", "probe", "memory_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))
    return part("dot").unionByName(part("euclid"))


def mixed_dimensions(spark, root):
    """Tenants with vectors of several lengths, once some are planted shorter."""
    m = _mem(spark, root, "embedding", "importance").withColumn("embedding", F.when(F.col("importance") > 0.9, F.slice("embedding", 1, 4)).otherwise(F.col("embedding")))
    return health.check_dimensions(m)


# -- rules


def invalid_provenance(spark, root):
    return schema.violations(table(spark, root, "memories"), schema.provenance_rules())


def invalid_plans(spark, root):
    return schema.violations(schema.plans(_actions(spark, root)), schema.plan_rules())


def invalid_health(spark, root):
    h = health.freshness(_mem(spark, root, "status", "expires_at", "updated_at", "importance", "has_provenance"), _now())
    h = h.withColumns({"conflict_count": F.lit(-1), "contradiction_score": F.lit(0.0), "confidence_accuracy_gap": F.lit(1.5), "score": F.col("freshness_score"), "risk_level": F.lit("low")})
    return schema.violations(h, schema.health_rules())


def quarantined(spark, root):
    """Valid and invalid memories, with the rules these break."""
    ok, bad = schema.quarantine(table(spark, root, "memories"), schema.memory_rules())
    return ok.select("version_seq", F.lit("").alias("broken")).distinct().unionByName(bad.select("version_seq", F.concat_ws(",", F.array_sort("broken_rules")).alias("broken")).distinct())


# -- records as text


def payloads(spark, root):
    """Memories written as payloads and read again."""
    back = provenance.from_payload(provenance.to_payload(_mem(spark, root)))
    return back.select("agent_id", "memory_id", "text", "status", "metadata", _r("importance").alias("importance"), "access_count", F.unix_micros("created_at").alias("created_us"), F.concat_ws(",", "supersedes").alias("supersedes"), F.col("provenance.source_id").alias("source_id"), F.size("embedding").cast("bigint").alias("n_numbers"))


def row_ids(spark, root):
    return _mem(spark, root, "version_seq").select("agent_id", "memory_id", scalars.row_key(F.col("agent_id"), F.col("memory_id")).alias("row_id"))


def prompts_asked(spark, root):
    """The prompt of each open conflict, as length and digest."""
    rows = prompts.with_texts(records.pending(_conf(spark, root)), _mem(spark, root, "text"))
    return rows.select("agent_id", "conflict_id", F.md5(prompts.classify_prompt()).alias("classify"), F.md5(prompts.decide_prompt()).alias("decide"))


def replies_read(spark, root):
    """Verdicts and actions of replies made of the conflict log, broken ones included."""
    c = table(spark, root, "conflicts").select("version_seq", "conflict_type", "confidence", "description").distinct()
    sure = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    reply = F.when(F.col("description").isNull(), "no answer").otherwise(F.to_json(F.struct(F.concat(F.lit(" "), F.upper("conflict_type"), F.lit(" ")).alias("verdict"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), F.lit("s ").alias("summary"))))
    v = c.select("version_seq", scalars.parse_verdict(reply).alias("v"))
    return v.select("version_seq", "v.verdict", _r("v.confidence").alias("confidence"), "v.summary").distinct()


def asked_conflicts(spark, root):
    """Detection with a text model in place of the rule: one client a partition, answering by the texts' lengths."""
    m = _held(spark, root, "status", "expires_at", "embedding", "first_seq", "text")

    def make():
        import json

        def answer(prompt: str) -> str:
            first = prompt.split("):\n", 1)[1].split("\n\nSecond note", 1)[0]
            if len(first) % 3 == 0:
                raise RuntimeError("no answer")
            return json.dumps({"verdict": "Direct_Contradiction", "confidence": 0.9 if len(first) % 3 == 1 else 0.5, "summary": "x"})

        return answer

    s = detect.scan(m, _conf(spark, root), _now(), prompts.classifier(make, m), similarity=r.SIMILAR)
    return s.select("agent_id", "memory_a_id", "memory_b_id", "conflict_type", _r("confidence").alias("confidence"))


def keyword_vectors(spark, root):
    t = table(spark, root, "eval_items").filter("text is not null")
    words = F.split(F.lower("text"), " ")
    v = vector.keyword_vector(words, cases.VOCABULARY)
    return t.select("item_id", scalars.namespace(F.col("case_name")).alias("namespace"), _r(vector.norm(v)).alias("norm"), *[_r(F.element_at(v, i + 1)).alias(f"v{i:02}") for i in range(len(cases.VOCABULARY))])


# -- evaluation


def _scores(spark, root) -> DataFrame:
    """Case results as scores of systems: each category stands for one, each threshold for a scenario."""
    return _cases(spark, root).select(F.col("category").alias("system"), F.col("pass_threshold").cast("string").alias("scenario"), F.col("score").alias("correct"), F.col("passed").cast("double").alias("signal"), F.lit(1.0).alias("preserved"), "score")


def system_dimensions(spark, root):
    return evaluate.dimensions(_scores(spark, root)).select("system", *[_r(c).alias(c) for c in ("correct", "signal", "preserved", "score")])


def scenario_pivot(spark, root):
    p = evaluate.by_scenario(_scores(spark, root), ["0.5", "0.7"])
    return p.select("system", _r(F.col("`0.5`")).alias("at_50"), _r(F.col("`0.7`")).alias("at_70"))


def system_headline(spark, root):
    """Case results as two systems: cases that met an error stand for the baseline."""
    both = _cases(spark, root).withColumn("system", F.when(F.col("score") < 0.5, "naive").otherwise("spark"))
    h = evaluate.headline(evaluate.by_system(both), "naive")
    return h.select("n_systems", *[_r(c).alias(c) for c in ("mean", "spread", "baseline", "gap", "category_gap")])


def weighted_score(spark, root):
    return evaluate.overall(_cases(spark, root), {"temporal": 3.0, "importance": 0.0})


def judged_cases(spark, root):
    """Scores and verdicts as the errors and thresholds demand, whatever was recorded."""
    return evaluate.judged(_cases(spark, root)).select("case_name", _r("score").alias("score"), "passed", "error").distinct()


def suite_cases(spark, root):
    """The fifty cases on this engine (no table is read)."""
    res = runner.run(spark)
    return res.select("case_name", "category", _r("score").alias("score"), "passed")


# -- the store


def store_state(spark, root):
    """All valid memories through a store: written, some deleted, some replaced, then read again."""
    store = MemoryStore(spark, Scratch(spark, "store").root)
    ok, _ = schema.quarantine(_mem(spark, root).withColumn("op", F.lit("insert")), schema.memory_rules() | {f"provenance_{k}": v for k, v in schema.provenance_rules().items()})
    ok = hold(ok.drop("first_seq", "version_seq", "op"), "valid")
    store.store_batch(ok)
    store.memories.append(store.mem().filter("status = 'archived'"), "delete")
    store.update(store.mem().filter("status = 'flagged'").withColumn("importance", F.lit(0.25)))
    return store.mem().select("agent_id", "memory_id", "status", _r("importance").alias("importance"))


def store_reads(spark, root):
    """What the store's reading methods give for one tenant, as counts."""
    store = MemoryStore(spark, Scratch(spark, "store").root)
    ok = hold(schema.quarantine(_mem(spark, root).filter("agent_id = 'agent-0001'").withColumn("op", F.lit("insert")), schema.memory_rules() | {f"provenance_{k}": v for k, v in schema.provenance_rules().items()})[0].drop("first_seq", "version_seq", "op"), "valid")
    store.store_batch(ok)
    a = "agent-0001"
    ids = [r_["memory_id"] for r_ in store.list_all(a).select("memory_id").collect()]  # one tenant's ids, as a caller would hold them
    rows = [
        ("all", store.count(a)), ("active", store.count(a, "active")), ("fetched", store.fetch_batch(a, [f" {i.upper()} " for i in ids]).count()), ("page", store.list_all(a, limit=7, offset=3).count()),
        ("there", sum(store.exists(a, i) for i in ids[:2])), ("elsewhere", store.fetch_batch("agent-0002", ids).count()), ("topic", store.where(a, {"topic": "budget"}).count()),
        ("provenance", sum(store.provenance_for(a, i).count() for i in sorted(ids)[:3])), ("deleted", store.delete_batch(a, ids[:4] + ["nobody"])), ("left", store.count(a)),
    ]
    return spark.createDataFrame(rows, "what string, n bigint")


def store_conflict_log(spark, root):
    """Valid conflicts through a store: kept, some resolved, some deleted, and listed."""
    store = MemoryStore(spark, Scratch(spark, "store").root)
    c = _conf(spark, root).drop("lo", "hi", "first_seq", "version_seq").withColumns({"resolved_at": F.when(F.col("resolution_status") != "pending", F.col("detected_at")), "resolution_notes": F.lit(None).cast("string")})
    store.conflicts.append(hold(schema.quarantine(c, schema.conflict_rules())[0], "valid"), "insert")
    sure = store.conflicts.state().filter("resolution_status = 'pending' and confidence >= 0.9")
    store.update_conflict(sure.withColumns({"resolution_status": F.lit("human_reviewed"), "resolved_at": F.col("detected_at"), "resolution_notes": F.lit("sure")}))
    store.conflicts.append(store.conflicts.state().filter("conflict_type = 'partial_conflict'"), "delete")
    return store.conflicts.state().select("agent_id", "conflict_id", "resolution_status", "resolution_notes")


# -- streams, run to the end of what there is


def _streamed(spark, root, name: str, make, mode: str) -> DataFrame:
    at = Scratch(spark, "stream").root
    source = spark.readStream.schema(table(spark, root, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)
    rows = make(source)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    spark.createDataFrame([], rows.schema).write.parquet(f"{at}/out")
    rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def stream_access(spark, root):
    out = _streamed(spark, root, "events", ingest.access_counts, "complete")
    return out.select("user_id", "n", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


def stream_activity(spark, root):
    """Hourly activity of the windows that the watermark has closed."""
    out = _streamed(spark, root, "events", ingest.activity, "append")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


_NAMES = """merged_memories resolution_notes archive_effects tiered_effects planted_preflight executed_actions hit_signals invalid_hits retrieval_overlap two_hops search_metrics
mixed_dimensions invalid_provenance invalid_plans invalid_health quarantined payloads row_ids prompts_asked replies_read asked_conflicts keyword_vectors system_dimensions
scenario_pivot system_headline weighted_score judged_cases suite_cases store_state store_reads store_conflict_log stream_access stream_activity""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_M, _C = r._MEM, r._CONF
_MERGE_TEXT = consolidate.MERGED_TEXT
_RULES = {
    "agent_not_blank": "trim(agent_id) <> ''", "text_not_blank": "trim(text) <> ''", "embedding_not_empty": "embedding IS NULL OR len(embedding) > 0", "metadata_is_json": "metadata IS NULL OR json_valid(metadata)",
    "known_type": "memory_type IN ('conversation', 'skill', 'custom')", "known_status": "status IN ('active', 'superseded', 'flagged', 'archived', 'pending_review')", "importance_in_range": "importance >= 0 AND importance <= 1",
    "access_count_not_negative": "access_count >= 0", "no_self_link": "superseded_by IS DISTINCT FROM memory_id AND NOT coalesce(list_contains(supersedes, memory_id), false)",
    "provenance_matches": "provenance IS NULL OR provenance.memory_id IS NOT DISTINCT FROM memory_id", "chunk_not_negative": "coalesce(provenance.chunk_index >= 0, true)",
}
_PROV = {
    "memory_id_not_blank": "provenance IS NULL OR trim(provenance.memory_id) <> ''", "source_id_not_blank": "provenance.source_id IS NULL OR trim(provenance.source_id) <> ''", "ingested_by_not_blank": "provenance.ingested_by IS NULL OR trim(provenance.ingested_by) <> ''",
    "chunk_not_negative": "coalesce(provenance.chunk_index >= 0, true)", "derived_from_not_blank": "len([x FOR x IN coalesce(provenance.derived_from, []) IF nullif(trim(x), '') IS NULL]) = 0",
}
_HOLDS = lambda rules: " AND ".join(f"coalesce({v}, false)" for v in rules.values())
_BROKEN = ", ".join(f"CASE WHEN NOT coalesce({v}, false) THEN '{k}' END" for k, v in sorted(_RULES.items()))
_NEAR3 = f"""m AS (SELECT * FROM mem WHERE {r._OK}),
hits AS (SELECT * FROM (SELECT p.agent_id, p.first_seq AS probe, m.memory_id, m.first_seq AS seq, row_number() OVER (PARTITION BY p.agent_id, p.first_seq ORDER BY {r._COS('p.embedding', 'm.embedding')} DESC, m.first_seq) AS rank FROM m p JOIN m ON m.agent_id = p.agent_id) WHERE rank <= 3)"""
_FLAGS = "archived AS (SELECT agent_id, unnest(src) AS memory_id FROM plan WHERE action_type = 'flag')"


def _filled(template: str, values: dict[str, str]) -> str:
    """SQL of a filled template: its pieces and values in order."""
    parts, rest = [], template
    while rest:
        at = {rest.find("{" + k + "}"): k for k in values if "{" + k + "}" in rest}
        i = min(at, default=len(rest))
        if rest[:i]:
            parts.append("'" + rest[:i].replace("'", "''") + "'")
        if not at:
            break
        parts.append(f"coalesce({values[at[i]]}, '')")
        rest = rest[i + len(at[i]) + 2 :]
    return " || ".join(parts)


_SIDES = {"id_a": "c.memory_a_id", "text_a": "a.text", "id_b": "c.memory_b_id", "text_b": "b.text"}
_CLASSIFY = _filled(prompts.CLASSIFY, _SIDES)
_DECIDE = _filled(prompts.DECIDE, _SIDES | {"conflict_type": "c.conflict_type", "description": "coalesce(c.description, 'no description')"})
_KEYWORDS = ", ".join(f"list_contains(w, '{k}')::INT::DOUBLE" for k in cases.VOCABULARY)
_METRIC = lambda name, score, order, out: f"SELECT '{name}' AS metric, agent_id, probe, memory_id, round(greatest(0, least(1, s)), 8) AS score, rank FROM (SELECT p.agent_id, p.first_seq AS probe, m.memory_id, {score} AS s, row_number() OVER (PARTITION BY p.agent_id, p.first_seq ORDER BY {score} {order}, m.first_seq) AS rank FROM m p JOIN m ON m.agent_id = p.agent_id WHERE (p.first_seq // 100) % 20 = 0) WHERE rank <= 5"

ORACLE = {
    "merged_memories": f"WITH RECURSIVE {r._PLAN} SELECT p.agent_id, CASE WHEN reasoning <> '' THEN reasoning ELSE '{_MERGE_TEXT}' END AS text, 'active' AS status, array_to_string(src, ',') AS supersedes, round((SELECT max(m.importance) FROM mem m WHERE m.agent_id = p.agent_id AND list_contains(p.src, m.memory_id)), 8) AS importance FROM plan p WHERE action_type = 'merge'",
    "resolution_notes": f"""WITH RECURSIVE {r._PLAN}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, lo, hi ORDER BY detected_at DESC, first_seq DESC) AS n FROM pend) WHERE n = 1),
done AS (SELECT l.agent_id, l.conflict_id, p.action_type <> 'flag' AS ok, CASE WHEN p.action_type = 'flag' THEN coalesce(reasoning, '{consolidate.FLAG_TEXT}') END AS note FROM last l JOIN plan p ON p.agent_id = l.agent_id AND p.phase > 0 AND list_min(p.src) = l.lo AND list_max(p.src) = l.hi
  UNION ALL SELECT l.agent_id, l.conflict_id, true, NULL FROM last l JOIN plan p ON p.agent_id = l.agent_id AND p.phase = 0 AND list_contains(p.src, l.lo) AND list_contains(p.src, l.hi) WHERE l.conflict_type = 'temporal_supersession')
SELECT agent_id, conflict_id, CASE WHEN bool_or(ok) THEN 'auto_resolved' ELSE 'pending' END AS resolution_status, max(note) AS resolution_notes FROM done GROUP BY agent_id, conflict_id""",
    "archive_effects": f"WITH RECURSIVE {r._PLAN}, {_FLAGS} SELECT m.agent_id, m.memory_id, 'archived' AS status, m.superseded_by, round(m.importance, 8) AS importance FROM mem m WHERE EXISTS (SELECT 1 FROM archived x WHERE x.agent_id = m.agent_id AND x.memory_id = m.memory_id)",
    "tiered_effects": "WITH RECURSIVE " + r._EFFECTS.replace("FROM plan)", "FROM plan WHERE tier <> 'human_review')") + " SELECT m.agent_id, m.memory_id, coalesce(f.st, m.status) AS status FROM mem m LEFT JOIN fin f USING (agent_id, memory_id) LEFT JOIN gain g USING (agent_id, memory_id) WHERE f.memory_id IS NOT NULL OR g.memory_id IS NOT NULL",
    "planted_preflight": f"""WITH RECURSIVE {r._PLAN}, n AS (SELECT DISTINCT agent_id, action_seq, unnest(src) AS i FROM plan)
SELECT DISTINCT agent_id, action_seq, 'missing source' AS problem FROM n WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.agent_id = n.agent_id AND m.memory_id = n.i AND m.status <> 'archived')
UNION ALL SELECT agent_id, action_seq, 'no open conflict' FROM plan p WHERE phase > 0 AND NOT EXISTS (SELECT 1 FROM pend c WHERE c.agent_id = p.agent_id AND c.conflict_type <> 'partial_conflict' AND c.lo = list_min(p.src) AND c.hi = list_max(p.src))""",
    "executed_actions": f"SELECT DISTINCT agent_id, action_id, CASE WHEN action_type IN ('supersede', 'chain_supersede') THEN source_memory_ids[-1] WHEN action_type = 'merge' THEN 'merged' ELSE source_memory_ids[1] END AS result_memory_id, epoch_us({r._T}) AS executed_us FROM actions WHERE executed_at IS NULL",
    "hit_signals": "SELECT agent_id, probe, memory_id, CASE WHEN conflict_flag THEN 1.0 WHEN NOT recommended THEN 0.5 ELSE 0.0 END::DOUBLE AS signal, round(s, 8) AS score, CASE WHEN s >= 0.85 THEN 'low' WHEN s >= 0.65 THEN 'medium' WHEN s >= 0.4 THEN 'high' ELSE 'critical' END AS risk FROM (SELECT *, 0.4::DOUBLE * recommended::INT + 0.4::DOUBLE * CASE WHEN conflict_flag THEN 1.0 WHEN NOT recommended THEN 0.5 ELSE 0.0 END::DOUBLE + 0.2::DOUBLE AS s FROM (" + r.ORACLE["search_enriched"] + "))",
    "invalid_hits": "SELECT unnest(['score_in_range', 'rank_from_one', 'flag_iff_conflicts']) AS rule, 0::BIGINT AS n_rows",
    "retrieval_overlap": f"""WITH {_M}, {r._HITS}, s AS (SELECT agent_id, memory_id, first_seq, embedding, nullif(lower(trim(provenance.source_id)), '') AS source FROM mem),
e AS (SELECT p.agent_id, p.first_seq AS probe, s.memory_id FROM s p JOIN s ON s.agent_id = p.agent_id AND s.source = p.source WHERE (p.first_seq // 100) % 20 = 0)
SELECT e.agent_id, e.probe, count(*) AS n_expected, count(h.memory_id) AS n_found, count(*) = count(h.memory_id) AS all_found FROM e LEFT JOIN hits h USING (agent_id, probe, memory_id) GROUP BY ALL""",
    "two_hops": f"""WITH {_M}, {_NEAR3}, one AS (SELECT * FROM hits WHERE (probe // 100) % 20 = 0), best AS (SELECT agent_id, probe, arg_min(seq, rank) AS via FROM one WHERE seq <> probe GROUP BY ALL)
SELECT agent_id, probe, memory_id FROM one UNION SELECT b.agent_id, b.probe, h.memory_id FROM best b JOIN hits h ON h.agent_id = b.agent_id AND h.probe = b.via""",
    "search_metrics": f"WITH {_M}, m AS (SELECT * FROM mem WHERE {r._OK}) " + _METRIC("dot", "list_dot_product(p.embedding, m.embedding)", "DESC", "s") + " UNION ALL " + _METRIC("euclid", "list_distance(p.embedding, m.embedding)", "", "s"),
    "mixed_dimensions": f"WITH {_M}, d AS (SELECT agent_id, CASE WHEN importance > 0.9 THEN len(embedding[1:4]) ELSE len(embedding) END AS n FROM mem) SELECT agent_id, count(DISTINCT n) AS n_dimensions FROM d WHERE n > 0 GROUP BY agent_id HAVING count(DISTINCT n) > 1",
    "invalid_provenance": r._rules("memories", _PROV),
    "invalid_plans": "WITH p AS (SELECT plan_id, count(*) AS n_actions, count(DISTINCT agent_id) AS n_agents, count(executed_at) AS n_executed, min(created_at) AS created_at, min(executed_at) AS executed_at FROM (SELECT DISTINCT * FROM actions) GROUP BY plan_id) " + r._rules("p", {"has_actions": "n_actions > 0", "one_agent": "n_agents = 1", "executed_whole_or_not": "n_executed = 0 OR n_executed = n_actions", "executed_after_created": "coalesce(executed_at >= created_at, true)"}),
    "invalid_health": f"WITH {_M}, {r._USABLE}, {r._FRESH} " + r._rules("fresh", {"avg_importance_in_range": "avg_importance BETWEEN 0 AND 1", "contradiction_score_in_range": "true", "freshness_score_in_range": "freshness_score BETWEEN 0 AND 1", "confidence_accuracy_gap_in_range": "false", "provenance_completeness_in_range": "provenance_completeness BETWEEN 0 AND 1", "score_in_range": "freshness_score BETWEEN 0 AND 1", "counts_not_negative": "false", "stale_within_total": "stale_count <= total_memories", "age_not_negative": "coalesce(oldest_age_days >= 0, true)", "known_risk": "true"}),
    "quarantined": f"SELECT DISTINCT version_seq, concat_ws(',', {_BROKEN}) AS broken FROM memories",
    "payloads": f"WITH {_M} SELECT agent_id, memory_id, text, status, metadata, round(importance, 8) AS importance, access_count, epoch_us(created_at) AS created_us, array_to_string(supersedes, ',') AS supersedes, provenance.source_id AS source_id, len(embedding) AS n_numbers FROM mem",
    "row_ids": f"WITH {_M} SELECT agent_id, memory_id, sha256(agent_id || '|' || memory_id) AS row_id FROM mem",
    "prompts_asked": f"WITH {_M}, {_C} SELECT c.agent_id, c.conflict_id, md5({_CLASSIFY}) AS classify, md5({_DECIDE}) AS decide FROM pend c JOIN mem a ON a.agent_id = c.agent_id AND a.memory_id = c.memory_a_id JOIN mem b ON b.agent_id = c.agent_id AND b.memory_id = c.memory_b_id",
    "replies_read": "SELECT DISTINCT version_seq, CASE WHEN description IS NULL THEN 'unrelated' WHEN conflict_type IS NULL THEN 'unrelated' ELSE lower(trim(conflict_type)) END AS verdict, CASE WHEN description IS NULL THEN 0 ELSE round(greatest(0, least(1, CASE WHEN isnan(confidence) THEN 0 ELSE coalesce(confidence, 0) END)), 8) END AS confidence, CASE WHEN description IS NULL THEN '' ELSE 's' END AS summary FROM conflicts",
    "asked_conflicts": f"WITH {_M}, {_C}, {r._USABLE}, {r._VALID} SELECT p.agent_id, p.memory_a_id, p.memory_b_id, 'direct_contradiction' AS conflict_type, 0.9::DOUBLE AS confidence FROM pairs p JOIN mem a ON a.agent_id = p.agent_id AND a.memory_id = p.memory_a_id WHERE length(coalesce(a.text, '')) % 3 = 1 AND NOT EXISTS (SELECT 1 FROM pend x WHERE x.agent_id = p.agent_id AND x.lo = least(p.memory_a_id, p.memory_b_id) AND x.hi = greatest(p.memory_a_id, p.memory_b_id))",
    "keyword_vectors": f"WITH k AS (SELECT item_id, case_name, string_split(lower(text), ' ') AS w FROM eval_items WHERE text IS NOT NULL), v AS (SELECT *, [{_KEYWORDS}] AS h FROM k), u AS (SELECT *, sqrt(list_sum(h)) AS n FROM v) SELECT item_id, 'eval_' || lower(replace(case_name, '.', '_')) AS namespace, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, " + ", ".join(f"round(CASE WHEN n > 0 THEN h[{i + 1}] / n ELSE 0 END, 8) AS v{i:02}" for i in range(len(cases.VOCABULARY))) + " FROM u",
    "system_dimensions": f"WITH {r._CASES} SELECT category AS system, round(avg(score), 8) AS correct, round(avg(passed::INT), 8) AS signal, 1.0::DOUBLE AS preserved, round(avg(score), 8) AS score FROM c GROUP BY category",
    "scenario_pivot": f"WITH {r._CASES} SELECT category AS system, round(max(score) FILTER (pass_threshold = 0.5), 8) AS at_50, round(max(score) FILTER (pass_threshold = 0.7), 8) AS at_70 FROM c GROUP BY category",
    "system_headline": f"WITH {r._CASES}, k AS (SELECT CASE WHEN score < 0.5 THEN 'naive' ELSE 'spark' END AS system, category, avg(score) AS s FROM c GROUP BY ALL), y AS (SELECT system, avg(s) AS o, coalesce(max(s) FILTER (category = 'temporal'), 0) AS t FROM k GROUP BY system) SELECT count(*) FILTER (system <> 'naive') AS n_systems, round(avg(o) FILTER (system <> 'naive'), 8) AS mean, round(stddev_pop(o) FILTER (system <> 'naive'), 8) AS spread, round(max(o) FILTER (system = 'naive'), 8) AS baseline, round(avg(o) FILTER (system <> 'naive') - max(o) FILTER (system = 'naive'), 8) AS gap, round(avg(t) FILTER (system <> 'naive') - avg(t) FILTER (system = 'naive'), 8) AS category_gap FROM y",
    "weighted_score": f"WITH {r._CASES}, k AS (SELECT CASE category WHEN 'temporal' THEN 3.0 WHEN 'importance' THEN 0.0 ELSE 1.0 END::DOUBLE AS w, avg(score) AS s FROM c GROUP BY category), o AS (SELECT sum(w * s) / sum(w) AS s FROM k) SELECT round_even(s, 4) AS overall, CASE WHEN s >= 0.85 THEN 'low' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'high' ELSE 'critical' END AS risk, (SELECT count(*) FILTER (passed) FROM c) AS n_passed, (SELECT count(*) FROM c) AS n_cases FROM o",
    "judged_cases": f"WITH {r._CASES} SELECT DISTINCT case_name, round(CASE WHEN error IS NOT NULL THEN 0.0 ELSE score END, 8) AS score, CASE WHEN error IS NOT NULL THEN false ELSE score >= pass_threshold END AS passed, error FROM c",
    "store_state": f"WITH {_M}, ok AS (SELECT * FROM mem WHERE {_HOLDS(_RULES)} AND {_HOLDS(_PROV)}) SELECT agent_id, memory_id, status, CASE WHEN status = 'flagged' THEN 0.25 ELSE round(importance, 8) END AS importance FROM ok WHERE status <> 'archived'",
    "store_reads": f"""WITH {_M}, ok AS (SELECT * FROM mem WHERE agent_id = 'agent-0001' AND {_HOLDS(_RULES)} AND {_HOLDS(_PROV)}), n AS (SELECT count(*) AS n FROM ok)
SELECT 'all' AS what, n FROM n UNION ALL SELECT 'active', count(*) FILTER (status = 'active') FROM ok UNION ALL SELECT 'fetched', n FROM n UNION ALL SELECT 'page', greatest(0, least(7, n - 3)) FROM n UNION ALL SELECT 'there', least(2, n) FROM n UNION ALL SELECT 'elsewhere', 0
UNION ALL SELECT 'topic', count(*) FROM ok WHERE CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.topic') END = 'budget' UNION ALL SELECT 'provenance', count(provenance) FROM (SELECT provenance FROM ok ORDER BY memory_id LIMIT 3) UNION ALL SELECT 'deleted', least(4, n) FROM n UNION ALL SELECT 'left', n - least(4, n) FROM n""",
    "store_conflict_log": f"""WITH {_C}, ok AS (SELECT * FROM conf WHERE memory_a_id IS NOT NULL AND memory_b_id IS NOT NULL AND memory_a_id <> memory_b_id AND conflict_type <> 'unknown' AND confidence IS NOT NULL AND regexp_matches(description, '\\S') AND (resolution_status = 'pending' OR detected_at IS NOT NULL))
SELECT agent_id, conflict_id, CASE WHEN resolution_status = 'pending' AND confidence >= 0.9 THEN 'human_reviewed' ELSE resolution_status END AS resolution_status, CASE WHEN resolution_status = 'pending' AND confidence >= 0.9 THEN 'sure' END AS resolution_notes FROM ok WHERE conflict_type <> 'partial_conflict'""",
    "stream_access": r.ORACLE["access_stats"],
    "stream_activity": "WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type, value FROM events WHERE ts IS NOT NULL), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM e, w WHERE h + INTERVAL 1 HOUR <= mark GROUP BY h, event_type",
}
