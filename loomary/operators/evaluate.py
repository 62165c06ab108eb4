"""Scores of evaluation runs: per category, overall, failures, and comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import eval_risk


def judged(results: DataFrame) -> DataFrame:
    """Results with ``passed`` and ``score`` as the error and the threshold demand."""
    failed = F.col("error").isNotNull()
    return results.withColumns({"score": F.when(failed, 0.0).otherwise(F.col("score")), "passed": F.when(failed, False).otherwise(F.col("score") >= F.col("pass_threshold"))})


def category_scores(results: DataFrame) -> DataFrame:
    """(category, score, pass_rate, n_cases), rounded half-even to four places."""
    return results.groupBy("category").agg(F.bround(F.avg("score"), 4).alias("score"), F.bround(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), F.count("*").alias("n_cases"))


def overall(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(overall, risk, n_passed, n_cases): the mean of category means, weighted if weights are given.

    A category without a weight counts 1; the risk label comes from the unrounded score.  Weights
    that add up to nothing (or less) over the categories there are raise an error; no results give 0.
    """
    by = results.groupBy("category").agg(F.avg("score").alias("s"), F.count_if("passed").alias("p"), F.count("*").alias("n"))
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col("category") == k, F.lit(float(v))).otherwise(w)
    none = F.count("*") == 0
    mean = F.when(none, 0.0).when(F.sum(w) > 0, F.sum(F.col("s") * w) / F.sum(w)).otherwise(F.raise_error(F.lit("the weights must add up to more than zero")).cast("double"))
    s = by.agg(mean.alias("s"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_passed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cases"))
    return s.select(F.bround("s", 4).alias("overall"), eval_risk(F.col("s")).alias("risk"), "n_passed", "n_cases")


def failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("passed"))


def repeated_names(results: DataFrame) -> DataFrame:
    return results.groupBy("case_name").agg(F.count("*").alias("n")).filter("n > 1")


def by_system(results: DataFrame) -> DataFrame:
    """(system, overall, n_passed, n_cases, categories) of results with a column ``system``."""
    by = results.groupBy("system", "category").agg(F.avg("score").alias("s"), F.count_if("passed").alias("p"), F.count("*").alias("n"))
    return by.groupBy("system").agg(F.avg("s").alias("overall"), F.sum("p").alias("n_passed"), F.sum("n").alias("n_cases"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "s")))).alias("categories"))


def headline(systems: DataFrame, baseline: str, category: str = "temporal") -> DataFrame:
    """One row over ``by_system``: what ``compare`` gives, and the gap in one category (0 where a system lacks it)."""
    full = F.col("system") != baseline
    s = F.coalesce(F.try_element_at("categories", F.lit(category)), F.lit(0.0))
    return compare(systems, baseline, [(F.avg(F.when(full, s)) - F.avg(F.when(~full, s))).alias("category_gap")])


def table_of(systems: DataFrame) -> str:
    """The comparison as text, a row per system."""
    rows = [r.asDict() for r in systems.orderBy(F.desc("overall"), "system").collect()]
    names = sorted({c for r in rows for c in r["categories"]})
    lines = [f"{'system':<20} {'score':>6} {'passed':>9}  " + " ".join(f"{c[:8]:>8}" for c in names)]
    lines += [f"{r['system']:<20} {r['overall']:>6.4f} {r['n_passed']:>4}/{r['n_cases']:<4}  " + " ".join(f"{r['categories'].get(c, 0.0):>8.2f}" for c in names) for r in rows]
    return "\n".join(lines)


def score_map(results: DataFrame) -> DataFrame:
    """One row: the score of each category as a map."""
    return category_scores(results).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "score")))).alias("scores"))


def compare(reports: DataFrame, baseline: str, more: list[Column] | None = None) -> DataFrame:
    """One row of (n_systems, mean, spread, baseline, gap) over reports (system, overall)."""
    full = F.col("system") != baseline
    return reports.agg(
        F.count_if(full).alias("n_systems"), F.avg(F.when(full, F.col("overall"))).alias("mean"), F.stddev_pop(F.when(full, F.col("overall"))).alias("spread"),
        F.max(F.when(~full, F.col("overall"))).alias("baseline"), *(more or []),
    ).withColumn("gap", F.col("mean") - F.col("baseline"))


def dimensions(scores: DataFrame) -> DataFrame:
    """(system, correct, signal, preserved, score) means over scenarios."""
    return scores.groupBy("system").agg(*[F.avg(c).alias(c) for c in ("correct", "signal", "preserved", "score")])


def by_scenario(scores: DataFrame, scenarios: list[str]) -> DataFrame:
    return scores.groupBy("system").pivot("scenario", scenarios).agg(F.max("score"))
