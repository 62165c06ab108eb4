"""Prompts for text models as columns, and one client per partition to answer them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consolidate, detect

Client = Callable[[str], str]

CLASSIFY = """Two notes kept by an assistant may disagree. Compare them.

First note ({id_a}):
{text_a}

Second note ({id_b}):
{text_b}

Answer with one of these labels:
direct_contradiction - both speak of the same thing and cannot both be true;
temporal_supersession - one is a later state of the same fact, the other is out of date;
partial_conflict - they overlap and differ in a detail;
unrelated - anything else, also two notes that agree.

Reply with a JSON object only: {"verdict": label, "confidence": number from 0 to 1, "summary": at most 15 words}"""

DECIDE = """Two notes of an assistant are in conflict ({conflict_type}).
What was found: {description}

First note ({id_a}):
{text_a}

Second note ({id_b}):
{text_b}

Answer "merge" if one statement can hold what both say, else "flag" to leave it to a person.

Reply with a JSON object only: {"action": "merge" or "flag", "confidence": number from 0 to 1, "reasoning": at most 20 words}"""


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced by a column, null by nothing; replaced text isn't read again."""
    parts, rest = [], template
    while rest:
        at = {rest.find("{" + k + "}"): k for k in values if "{" + k + "}" in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        i = min(at)
        parts += [F.lit(rest[:i]), F.coalesce(values[at[i]], F.lit(""))]
        rest = rest[i + len(at[i]) + 2 :]
    return F.concat(*parts)


def classify_prompt() -> Column:
    """For pairs with ids and texts of both sides."""
    return filled(CLASSIFY, {"id_a": F.col("memory_a_id"), "text_a": F.col("text_a"), "id_b": F.col("memory_b_id"), "text_b": F.col("text_b")})


def decide_prompt() -> Column:
    """For open conflicts with texts of both sides; without a description a short stand-in."""
    return filled(DECIDE, {"conflict_type": F.col("conflict_type"), "description": F.coalesce("description", F.lit("no description")), "id_a": F.col("memory_a_id"), "text_a": F.col("text_a"), "id_b": F.col("memory_b_id"), "text_b": F.col("text_b")})


def asker(make: Callable[[], Client]) -> Callable[[Column], Column]:
    """A column function from prompt to reply: each partition makes one client; a call that fails gives null."""

    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()

        def one(prompt: str | None) -> str | None:
            try:
                return None if prompt is None else client(prompt)
            except Exception:  # noqa: BLE001 - a failed call is an unrelated pair or a flag, not a failed job
                return None

        for s in batches:
            yield s.map(one)

    return F.pandas_udf(ask, "string", F.PandasUDFType.SCALAR_ITER)


def with_texts(pairs: DataFrame, mem: DataFrame) -> DataFrame:
    """Pairs with the texts of both sides."""
    t = lambda s: mem.select("agent_id", F.col("memory_id").alias(f"memory_{s}_id"), F.col("text").alias(f"text_{s}"))
    return pairs.join(t("a"), ["agent_id", "memory_a_id"]).join(t("b"), ["agent_id", "memory_b_id"])


def classifier(make: Callable[[], Client], mem: DataFrame) -> detect.Classifier:
    """A classifier that asks a text model about both texts; broken replies are unrelated pairs."""
    run = detect.model_classifier(asker(make), classify_prompt)
    return lambda pairs: run(with_texts(pairs, mem)).drop("text_a", "text_b")


def planner(make: Callable[[], Client], mem: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A planner that asks a text model; broken replies are flags, unknown actions give no row."""
    run = consolidate.model_planner(asker(make), decide_prompt)
    return lambda rows: run(with_texts(rows, mem)).drop("text_a", "text_b")
