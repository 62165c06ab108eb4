"""Consolidation: from open conflicts to ordered actions, and from actions to new record versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_action, row_key, tier
from ..session import Scratch, hold
from .graph import minimum_labels, undirected
from .records import pending
from .sequence import numbered


# The texts that actions and records carry.
CHAIN_TEXT = ("-version chain: ", " stale memories superseded by newest.")
TIED_TEXT = "Tied created_at; manual review required."
NEWER_TEXT = "Newer memory supersedes older conflicting fact."
MERGED_TEXT = "Merged memory synthesised from conflicting sources."
FLAG_TEXT = "Flagged for human review."


#: Links that one task labels; more are labelled by distributed rounds, to the same result.
FEW_LINKS = 200_000


def rule_planner(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: confident pairs are merged, the rest is flagged."""
    return rows.withColumns({"action": F.when(F.col("confidence") >= 0.9, "merge").otherwise("flag"), "plan_confidence": F.col("confidence"), "reasoning": F.coalesce("description", F.lit(""))})


def model_planner(ask: Callable, prompt: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    """A planner around a text model; unknown actions give no row, broken replies a flag."""

    def run(rows: DataFrame) -> DataFrame:
        r = rows.withColumn("_r", parse_action(ask(prompt())))
        return r.withColumns({"action": F.col("_r.action"), "plan_confidence": F.col("_r.confidence"), "reasoning": F.col("_r.reasoning")}).drop("_r").filter(F.col("action").isin("merge", "flag"))

    return run


def best_record(conf: DataFrame, which: str) -> DataFrame:
    """One record of each unordered pair: the ``first`` or ``last`` detected (then written), or the ``surest`` (the first of equals).

    Combined before the shuffle, so a pair reported any number of times costs no more than another.
    """
    seen = F.struct(F.col("detected_at").isNotNull(), "detected_at", "first_seq")
    by = {"first": F.min_by, "last": F.max_by, "surest": F.min_by}[which]
    order = F.struct(-F.coalesce("confidence", F.lit(-1.0)), seen) if which == "surest" else seen
    rest = [c for c in conf.columns if c not in ("agent_id", "lo", "hi")]
    return conf.groupBy("agent_id", "lo", "hi").agg(by(F.struct(*rest), order).alias("_r")).select("agent_id", "lo", "hi", "_r.*")


def joined_pending(mem: DataFrame, conf: DataFrame) -> DataFrame:
    """Open conflicts with both memories' facts; those with a missing side are left out."""
    m = mem.select("agent_id", "memory_id", "created_at", "importance")
    side = lambda s: m.select("agent_id", F.col("memory_id").alias(f"memory_{s}_id"), F.col("created_at").alias(f"created_{s}"), F.col("importance").alias(f"importance_{s}"))
    return pending(conf).join(side("a"), ["agent_id", "memory_a_id"]).join(side("b"), ["agent_id", "memory_b_id"])


def skipped(mem: DataFrame, conf: DataFrame) -> DataFrame:
    """Open conflicts that name a memory that isn't there."""
    return pending(conf).join(joined_pending(mem, conf).select("agent_id", "conflict_id"), ["agent_id", "conflict_id"], "left_anti")


def chains(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(agent_id, memory_id, component, size) of memories linked by open temporal conflicts."""
    scratch = Scratch(spark, "chains")
    links = rows.filter("conflict_type = 'temporal_supersession'").select("agent_id", F.col("memory_a_id").alias("a"), F.col("memory_b_id").alias("b"))
    labels = minimum_labels(scratch, scratch.save(undirected(links), "links"), finish=FEW_LINKS)
    sizes = labels.groupBy("agent_id", "label").agg(F.count("*").alias("size"))
    return labels.join(sizes, ["agent_id", "label"]).select("agent_id", F.col("node").alias("memory_id"), F.col("label").alias("component"), "size")


def plan(spark: SparkSession, mem: DataFrame, conf: DataFrame, planner: Callable[[DataFrame], DataFrame] = rule_planner) -> DataFrame:
    """Ordered actions of each tenant: chains first, then single temporal pairs, then the others.

    Three or more memories linked by temporal conflicts are one chain: the newest (largest id on a
    tie) supersedes all others.  A single pair supersedes the older one, or is flagged on a tie.
    Chain sources are the stale ids in order, then the keeper; pairs are (stale, keeper).
    """
    rows = hold(joined_pending(mem, conf), "pending")
    comp = hold(chains(spark, rows), "chains")
    made = mem.select("agent_id", "memory_id", "created_at", "importance")
    many = comp.filter("size >= 3").join(made, ["agent_id", "memory_id"])
    grouped = many.groupBy("agent_id", "component", "size").agg(F.max(F.struct("created_at", "memory_id"))["memory_id"].alias("keeper"), F.array_sort(F.collect_list("memory_id")).alias("ids"))
    stale = F.array_except("ids", F.array("keeper"))
    text = F.concat(F.col("size").cast("string"), F.lit(CHAIN_TEXT[0]), F.size(stale).cast("string"), F.lit(CHAIN_TEXT[1]))
    chain = grouped.select("agent_id", F.lit(0).alias("phase"), F.col("component").alias("key"), F.lit(None).cast("string").alias("conflict_id"), F.lit("chain_supersede").alias("action_type"), F.lit("auto_merge").alias("tier"), F.lit(1.0).alias("confidence"), F.concat(stale, F.array("keeper")).alias("source_memory_ids"), text.alias("reasoning"))

    pair_of = comp.filter("size = 2").select("agent_id", F.col("memory_id").alias("memory_a_id"))
    solo = best_record(rows.filter("conflict_type = 'temporal_supersession'").join(pair_of, ["agent_id", "memory_a_id"], "left_semi"), "first")
    tied = F.col("created_a").eqNullSafe(F.col("created_b"))
    old_a = F.col("created_a") < F.col("created_b")
    single = solo.select(
        "agent_id", F.lit(1).alias("phase"), F.format_string("%s %020d", F.date_format("detected_at", "yyyyMMddHHmmssSSSSSS"), "first_seq").alias("key"), "conflict_id", F.when(tied, "flag").otherwise("supersede").alias("action_type"),
        F.when(tied, "human_review").otherwise(tier(F.col("confidence"))).alias("tier"), "confidence",
        F.when(tied | old_a, F.array("memory_a_id", "memory_b_id")).otherwise(F.array("memory_b_id", "memory_a_id")).alias("source_memory_ids"),
        F.when(tied, TIED_TEXT).otherwise(F.coalesce("description", F.lit(NEWER_TEXT))).alias("reasoning"),
    )
    decided = planner(rows.filter(F.col("conflict_type").isin("direct_contradiction", "partial_conflict")))
    other = decided.select("agent_id", F.lit(2).alias("phase"), F.format_string("%s %020d", F.date_format("detected_at", "yyyyMMddHHmmssSSSSSS"), "first_seq").alias("key"), "conflict_id", F.col("action").alias("action_type"), tier(F.col("plan_confidence")).alias("tier"), F.col("plan_confidence").alias("confidence"), F.array("memory_a_id", "memory_b_id").alias("source_memory_ids"), "reasoning")
    acts = numbered(hold(chain.unionByName(single).unionByName(other), "unordered"), ["agent_id"], ["phase", "key", "conflict_id"], "action_seq")
    acts = acts.withColumn("action_id", row_key(F.col("agent_id"), F.col("phase").cast("string"), F.col("key"), F.coalesce("conflict_id", F.lit("")))).drop("phase", "key")
    return hold(acts, "actions")


def preflight(actions: DataFrame, mem: DataFrame, conf: DataFrame) -> DataFrame:
    """What forbids execution: (agent_id, action_id, problem) for missing sources and pairs without a record."""
    named = actions.select("agent_id", "action_id", F.explode("source_memory_ids").alias("memory_id"))
    missing = named.join(mem.select("agent_id", "memory_id"), ["agent_id", "memory_id"], "left_anti").select("agent_id", "action_id", F.lit("missing source").alias("problem")).distinct()
    pair = actions.filter(F.col("action_type").isin("supersede", "merge", "flag")).select("agent_id", "action_id", F.array_min("source_memory_ids").alias("lo"), F.array_max("source_memory_ids").alias("hi"))
    unheld = pair.join(pending(conf).select("agent_id", "lo", "hi"), ["agent_id", "lo", "hi"], "left_anti").select("agent_id", "action_id", F.lit("no open conflict").alias("problem"))
    return missing.unionByName(unheld)


def effects(actions: DataFrame, mem: DataFrame, respect_tier: bool = False) -> tuple[DataFrame, DataFrame]:
    """Memory versions that executing the actions writes: (changed memories, merged memories).

    Changed rows are (agent_id, memory_id, status, superseded_by, supersedes, importance): the last
    action on a memory sets its status and successor, predecessors are added once in order, and a
    keeper's importance rises to the largest it takes over.  ``updated_at`` is not touched.
    """
    if respect_tier:
        actions = actions.filter("tier <> 'human_review'")
    last = F.element_at("source_memory_ids", -1)
    merged_id = F.concat(F.lit("merged-"), F.substring("action_id", 1, 32))
    each = actions.select("agent_id", "action_id", "action_seq", "action_type", last.alias("keeper"), merged_id.alias("merged"), F.posexplode("source_memory_ids").alias("pos", "memory_id"))
    supers = F.col("action_type").isin("supersede", "chain_supersede")
    retire = each.filter((supers & (F.col("memory_id") != F.col("keeper"))) | F.col("action_type").isin("merge", "archive"))
    sets = retire.select("agent_id", "memory_id", "action_seq", F.when(supers, "superseded").otherwise("archived").alias("status"), F.when(supers, F.col("keeper")).when(F.col("action_type") == "merge", F.col("merged")).alias("superseded_by"))
    base = mem.select("agent_id", "memory_id", "status", "superseded_by", "supersedes", "importance")
    final = sets.groupBy("agent_id", "memory_id").agg(F.max_by("status", "action_seq").alias("new_status"), F.max_by("superseded_by", F.when(F.col("superseded_by").isNotNull(), F.col("action_seq"))).alias("new_by"))
    took = each.filter(supers & (F.col("memory_id") != F.col("keeper"))).join(base.select("agent_id", "memory_id", "importance"), ["agent_id", "memory_id"])
    gains = took.groupBy("agent_id", F.col("keeper").alias("memory_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("action_seq", "pos", "memory_id"))), lambda x: x["memory_id"]).alias("gained"), F.max("importance").alias("most"))
    touched = final.select("agent_id", "memory_id").unionByName(gains.select("agent_id", "memory_id")).distinct()
    j = base.join(touched, ["agent_id", "memory_id"]).join(final, ["agent_id", "memory_id"], "left").join(gains, ["agent_id", "memory_id"], "left")
    gained = F.coalesce("gained", F.array().cast("array<string>"))
    changed = j.select(
        "agent_id", "memory_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_by", "superseded_by").alias("superseded_by"),
        F.concat("supersedes", F.array_except(F.array_distinct(gained), F.col("supersedes"))).alias("supersedes"), F.greatest("importance", F.coalesce("most", "importance")).alias("importance"),
    )
    merges = actions.filter("action_type = 'merge'").select("agent_id", merged_id.alias("memory_id"), "reasoning", "source_memory_ids", "action_id")
    imp = merges.select("agent_id", "action_id", F.explode("source_memory_ids").alias("memory_id")).join(base.select("agent_id", "memory_id", "importance"), ["agent_id", "memory_id"]).groupBy("agent_id", "action_id").agg(F.max("importance").alias("importance"))
    new = merges.join(imp, ["agent_id", "action_id"]).select("agent_id", "memory_id", F.when(F.col("reasoning") != "", F.col("reasoning")).otherwise(MERGED_TEXT).alias("text"), F.lit("active").alias("status"), F.col("source_memory_ids").alias("supersedes"), "importance")
    return changed, new


def resolved(actions: DataFrame, conf: DataFrame) -> DataFrame:
    """(agent_id, conflict_id, resolution_status, resolution_notes) that executing the actions writes.

    A pairwise action resolves the last open record of its pair; a chain those of type temporal
    supersession with both ends in it; a flag only notes its reason.
    """
    lookup = best_record(pending(conf), "last")
    pair = actions.filter(F.col("action_type").isin("supersede", "merge", "flag")).select("agent_id", "action_type", "reasoning", F.array_min("source_memory_ids").alias("lo"), F.array_max("source_memory_ids").alias("hi"))
    p = lookup.join(pair, ["agent_id", "lo", "hi"])
    ends = actions.filter("action_type = 'chain_supersede'").select("agent_id", "action_id", F.explode("source_memory_ids").alias("id"))
    c = lookup.filter("conflict_type = 'temporal_supersession'").join(ends.select("agent_id", F.col("action_id").alias("x"), F.col("id").alias("lo")), ["agent_id", "lo"]).join(ends.select("agent_id", F.col("action_id").alias("y"), F.col("id").alias("hi")), ["agent_id", "hi"]).filter("x = y")
    done = c.select("agent_id", "conflict_id", F.lit(True).alias("done"), F.lit(None).cast("string").alias("note")).unionByName(p.select("agent_id", "conflict_id", (F.col("action_type") != "flag").alias("done"), F.when(F.col("action_type") == "flag", F.coalesce("reasoning", F.lit(FLAG_TEXT))).alias("note")))
    return done.groupBy("agent_id", "conflict_id").agg(F.when(F.bool_or("done"), "auto_resolved").otherwise("pending").alias("resolution_status"), F.max("note").alias("resolution_notes"))


def executed(actions: DataFrame, at: Column, dry_run: bool = False) -> DataFrame:
    """Actions stamped as executed, with their result; a dry run names the first source.

    An action is executed once: one that has a time already raises an error when the rows are read.
    """
    first = F.element_at("source_memory_ids", 1)
    result = F.when(F.col("action_type").isin("supersede", "chain_supersede"), F.element_at("source_memory_ids", -1)).when(F.col("action_type") == "merge", F.concat(F.lit("merged-"), F.substring("action_id", 1, 32))).otherwise(first)
    if "executed_at" in actions.columns:
        at = F.when(F.col("executed_at").isNull(), at).otherwise(F.raise_error(F.concat(F.lit("executed before: "), F.col("action_id"))).cast("timestamp"))
    return actions.withColumns({"result_memory_id": first if dry_run else result, "executed_at": at})


def views(actions: DataFrame) -> dict[str, DataFrame]:
    """The plan by what it would do and who decides."""
    kind = lambda k: actions.filter(F.col("action_type") == k)
    review = F.col("tier") == "human_review"
    return {"would_merge": kind("merge"), "would_supersede": kind("supersede"), "would_chain_supersede": kind("chain_supersede"), "would_flag_for_review": kind("flag"), "human_review_actions": actions.filter(review), "auto_actions": actions.filter(~review)}
