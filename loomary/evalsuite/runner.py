"""Run the cases: all tenants are one table, all queries one search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import evaluate, records, search
from . import cases

Rerank = Callable[[DataFrame, DataFrame], DataFrame]
_DEFAULTS = {"memory_type": "custom", "status": "active", "importance": schema.DEFAULT_IMPORTANCE, "access_count": 0, "supersedes": [], "op": "insert"}


def fixtures(spark: SparkSession, chosen: list[cases.Case]) -> DataFrame:
    """The write log of all cases, one tenant each."""
    ddl = T.StructType.fromDDL(schema.MEMORIES)
    rows, n = [], 0
    for c in chosen:
        first: dict[str, int] = {}
        for i, r in enumerate(c.rows):
            n += 1
            at = cases.T0 + cases.dt.timedelta(minutes=i)
            full = _DEFAULTS | {"created_at": at, "updated_at": at} | r | {"agent_id": c.agent_id, "first_seq": first.setdefault(r["memory_id"], n), "version_seq": n}
            if full.get("provenance"):
                full["provenance"] = {f.name: full["provenance"].get(f.name) for f in ddl["provenance"].dataType.fields} | {"memory_id": r["memory_id"]}
            rows.append({f.name: full.get(f.name) for f in ddl.fields})
    return spark.createDataFrame(rows, ddl)


def naive(mem: DataFrame) -> DataFrame:
    """What a bare vector store keeps: id, tenant, text and vector; all else is default, and listings know no status."""
    kinds = dict(mem.dtypes)
    keep = ("agent_id", "memory_id", "text", "embedding", "first_seq")
    none = F.lit(None)
    blank = {c: none.cast(k) for c, k in kinds.items() if c not in keep}
    return mem.withColumns(blank | {"status": F.lit("active"), "importance": F.lit(schema.DEFAULT_IMPORTANCE), "access_count": F.lit(0).cast("bigint"), "supersedes": F.array().cast("array<string>")})


def run(spark: SparkSession, categories: set[str] | None = None, view: Callable[[DataFrame], DataFrame] | None = None, rerank: Rerank | None = None, hook: Callable | None = None) -> DataFrame:
    """Case results (case_name, category, score, pass_threshold, passed, error) of a store.

    ``view`` stands for a store that keeps less, ``rerank`` for another order of hits.
    """
    chosen = [c for c in cases.ALL if not categories or c.category in categories]
    if not chosen:
        raise ValueError("no case of these categories")
    mem = records.memories(fixtures(spark, chosen))
    if view:
        mem = view(mem)
    asked = [(c.agent_id, i, q) for c in chosen for i, q in enumerate(cases.queries(c))]
    found: dict[tuple, list] = {}
    if asked:
        probes = spark.createDataFrame([(a, i, cases.vector(*q.split())) for a, i, q in asked], "agent_id string, probe bigint, embedding array<double>")
        hits = search.search_many(mem, probes, 10)
        if rerank:
            hits = rerank(hits, mem)
        for r in hits.orderBy("agent_id", "probe", "rank").collect():
            found.setdefault((r["agent_id"], r["probe"]), []).append((r["memory_id"], r["score"]))
    by_agent: dict[str, dict] = {}
    for r in mem.collect():
        by_agent.setdefault(r["agent_id"], {})[r["memory_id"]] = r.asDict(recursive=True)
    out = []
    for n, c in enumerate(chosen):
        seen = cases.Seen(by_agent.get(c.agent_id, {}), {q: found.get((c.agent_id, i), []) for i, q in enumerate(cases.queries(c))}, by_status=view is not naive)
        try:
            s, error = cases.score(c, seen), None
        except Exception as e:  # a broken case is a failed one, not a failed run
            s, error = 0.0, repr(e)
        out.append((c.name, c.category, float(s), c.pass_threshold, error is None and s >= c.pass_threshold, error))
        if hook:
            hook(out[-1], n, len(chosen))
    return spark.createDataFrame(out, schema.CASE_RESULTS)


def document(results: DataFrame, system: str, run_at: str) -> dict:
    """The run as a JSON document: scores, and every case below its category."""
    o = evaluate.overall(results).first()
    rows: dict[str, list[dict]] = {}
    for r in results.orderBy("category", "case_name").collect():
        rows.setdefault(r["category"], []).append({k: r[k] for k in ("case_name", "score", "passed", "pass_threshold", "error")})
    by = {r["category"]: r for r in evaluate.category_scores(results).collect()}
    order = sorted(by, key=lambda c: (cases.CATEGORIES.index(c) if c in cases.CATEGORIES else 99, c))
    return {
        "schema_version": "1", "run_at": run_at, "backend_name": system, "overall_score": o["overall"], "hallucination_risk": o["risk"],
        "categories": [{"category": c, "score": by[c]["score"], "pass_rate": by[c]["pass_rate"], "results": rows[c]} for c in order],
    }


def report(results: DataFrame) -> str:
    """The run as plain text."""
    o = evaluate.overall(results).first()
    lines = [f"overall {o['overall']:.4f}  risk {o['risk']}  passed {o['n_passed']} of {o['n_cases']}"]
    order = {c: i for i, c in enumerate(cases.CATEGORIES)}
    for r in sorted(evaluate.category_scores(results).collect(), key=lambda r: order.get(r["category"], 99)):
        bar = "#" * round(r["score"] * 20)
        lines.append(f"{r['category']:<14} {r['score']:.4f} {bar:<20} {r['n_cases']} cases")
    lines += [f"failed: {r['category']}.{r['case_name']} ({r['error'] or r['score']})" for r in evaluate.failures(results).orderBy("category", "case_name").collect()]
    return "\n".join(lines)
