"""Seven behavioural scenarios over facts with fixed vectors and a rule classifier.

Each scenario adds facts to a tenant, lets the engine detect (and consolidate) conflicts, and asks.
Three parts count: the right fact is recommended, the stale one is signalled, nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import consolidate, detect, records, search
from ..schema import CONFLICTS
from . import cases
from .runner import fixtures


@dataclass(frozen=True)
class Scenario:
    name: str
    facts: list[dict]
    query: str
    current: str | None  # the fact that must be recommended
    stale: str | None  # the fact that must be signalled; None: nothing may be
    keep: int


def f(mid: str, words: str, day: int, text: str = "") -> dict:
    at = cases.T0 + cases.dt.timedelta(days=day)
    return cases.m(mid, words, text=text or f"fact {mid}: {words}", created_at=at, updated_at=at)


ALL = [
    Scenario("B1", [f("old", "refund policy window", 0), f("new", "refund policy window", 1)], "refund policy window", "new", "old", 2),
    Scenario("B2", [f("a", "password security", 0), f("b", "price plan", 1), f("c", "api rate", 2)], "password security", "a", None, 3),
    Scenario("B3", [f("old", "api rate limit", 0), f("new", "api rate limit", 3)], "api rate limit", "new", "old", 2),
    Scenario("B4", [f("a", "price plan", 0), f("b", "refund return", 1)], "price plan", "a", None, 2),
    Scenario("B5", [f("old", "days window", 0), f("new", "days window", 2)], "days window", "new", "old", 2),
    Scenario("B6", [f("v1", "subscription price", 0), f("v2", "subscription price", 1), f("v3", "subscription price", 2)], "subscription price", "v3", "v1", 3),
    Scenario("B7", [f("old", "password expire days", -30), f("new", "password expire days", 0)], "password expire days", "new", "old", 2),
]


def newer_wins(pairs: DataFrame) -> DataFrame:
    """Classifier of the scenarios: same words at another time is a temporal supersession."""
    return pairs.withColumns({"verdict": F.lit("temporal_supersession"), "confidence": F.lit(0.95), "summary": F.lit("newer statement")})


def run(spark: SparkSession, mode: str = "detect") -> DataFrame:
    """(scenario, system, correct, signal, preserved, score); mode is naive, detect or consolidate."""
    chosen = [cases.Case(s.name, "scenario", s.facts, []) for s in ALL]
    mem = records.memories(fixtures(spark, chosen))
    conf = records.conflicts(spark.createDataFrame([], CONFLICTS))
    if mode != "naive":
        found = detect.scan(mem, conf, F.lit(cases.AS_OF), newer_wins)
        log = found.withColumns({"detected_at": F.lit(cases.AS_OF).cast("timestamp"), "first_seq": F.row_number().over(_window()).cast("bigint"), "op": F.lit("insert")}).withColumn("version_seq", F.col("first_seq"))
        conf = spark.createDataFrame(records.conflicts(log).collect(), records.conflicts(log).schema)
    if mode == "consolidate":
        actions = consolidate.plan(spark, mem, conf)
        changed, _ = consolidate.effects(actions, mem)
        new = ["status", "superseded_by", "supersedes", "importance"]
        mem = mem.drop(*new).join(changed.select("agent_id", "memory_id", *new), ["agent_id", "memory_id"]).unionByName(mem.join(changed.select("agent_id", "memory_id"), ["agent_id", "memory_id"], "left_anti").select(*[c for c in mem.columns if c not in new], *new))
    probes = spark.createDataFrame([(c.agent_id, 0, cases.vector(*s.query.split())) for c, s in zip(chosen, ALL, strict=True)], "agent_id string, probe bigint, embedding array<double>")
    hits = search.search_many(mem, probes, 10, 0.5)
    rows = search.enrich(hits, mem, conf, strict_status=mode == "consolidate").collect() if mode != "naive" else [r.asDict() | {"conflict_flag": False, "recommended": True} for r in hits.collect()]
    kept = {r["agent_id"]: r["n"] for r in mem.groupBy("agent_id").agg(F.count("*").alias("n")).collect()}
    out = []
    for c, s in zip(chosen, ALL, strict=True):
        mine = {r["memory_id"]: r for r in rows if r["agent_id"] == c.agent_id}
        right = 1.0 if s.current in mine and mine[s.current]["recommended"] else 0.0
        # where nothing may be signalled, a flag anywhere counts as a stale fact that was let through
        old = mine.get(s.stale) if s.stale else None
        found, flagged, told = (any(r["conflict_flag"] for r in mine.values()), False, True) if s.stale is None else (old is not None, bool(old and old["conflict_flag"]), bool(old and old["recommended"]))
        out.append((s.name, mode, right, found, flagged, told, min(1.0, kept.get(c.agent_id, 0) / s.keep)))
    judged = spark.createDataFrame(out, "scenario string, system string, correct double, found boolean, flagged boolean, told boolean, preserved double")
    judged = judged.withColumn("signal", scalars.stale_signal(F.col("found"), F.col("flagged"), F.col("told")).cast("double"))
    return judged.select("scenario", "system", "correct", "signal", "preserved", scalars.scenario_score(F.col("correct"), F.col("signal"), F.col("preserved")).alias("score"))


def _window():
    return Window.orderBy("agent_id", "memory_a_id", "memory_b_id")
