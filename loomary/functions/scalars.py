"""Scalar rules: decay, ages, tiers, risk labels, keys, strict JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .vector import clamp


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86400e6)


def decay(age: Column, half_life: float = schema.HALF_LIFE_DAYS) -> Column:
    return F.least(F.lit(1.0), F.exp(-age * F.log(F.lit(2.0)) / half_life))


def _label(x: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    out = F.when(x >= cuts[0], names[0])
    for c, n in zip(cuts[1:], names[1:], strict=False):
        out = out.when(x >= c, n)
    return out.otherwise(names[-1])


def health_risk(score: Column) -> Column:
    return _label(score, schema.HEALTH_RISK, ("low", "medium", "high", "critical"))


def eval_risk(score: Column) -> Column:
    return _label(score, schema.EVAL_RISK, ("low", "medium", "high", "critical"))


def scenario_risk(score: Column) -> Column:
    return _label(score, schema.SCENARIO_RISK, ("low", "medium", "high", "critical"))


def tier(confidence: Column) -> Column:
    return _label(confidence, (schema.AUTO_MERGE, schema.AUTO_FLAG), ("auto_merge", "auto_flag", "human_review"))


def is_expired(as_of: Column) -> Column:
    return F.coalesce(as_of > F.col("expires_at"), F.lit(False))


def is_usable(as_of: Column) -> Column:
    return F.coalesce(F.col("status") == "active", F.lit(False)) & ~is_expired(as_of)


def row_key(*cols: Column) -> Column:
    """A stable id made of a row's key parts; equal in every run."""
    return F.sha2(F.concat_ws("|", *cols), 256)


def stale_signal(found: Column, flagged: Column, recommended: Column) -> Column:
    return F.when(~found | flagged, 1.0).when(~recommended, 0.5).otherwise(0.0)


def scenario_score(correct: Column, signal: Column, preserved: Column) -> Column:
    return 0.4 * correct + 0.4 * signal + 0.2 * preserved


def namespace(name: Column) -> Column:
    return F.concat(F.lit("eval_"), F.lower(F.replace(name, F.lit("."), F.lit("_"))))


def contains(text: Column, snippet: Column) -> Column:
    return F.contains(F.lower(text), F.lower(snippet))


def json_value(doc: Column, key: str, kind: str = "string") -> Column:
    """A top-level value of a JSON document; null where the document is broken or the key is absent."""
    return F.try_variant_get(F.try_parse_json(doc), f"$['{key}']", kind)


def matches(metadata: Column, want: dict) -> Column:
    """All keys equal the wanted values; None matches an absent or null value."""
    out = F.lit(True)
    for k, v in want.items():
        if v is None:
            out = out & json_value(metadata, k).isNull()
        else:
            kind = "boolean" if isinstance(v, bool) else "double" if isinstance(v, int | float) else "string"
            out = out & json_value(metadata, k, kind).eqNullSafe(F.lit(float(v) if kind == "double" else v))
    return out


def parse_reply(reply: str | None, name: str, fallback: str, text: str) -> tuple[str, float, str]:
    """(label, confidence in [0, 1], text) of a model's JSON reply; anything else is the fallback."""
    try:
        d = json.loads(reply)
        if not isinstance(d, dict):
            return fallback, 0.0, ""
        c = float(d.get("confidence", 0.0))
        return str(d.get(name, fallback)).strip().lower(), max(0.0, min(1.0, c)), str(d.get(text) or "").strip()
    except (TypeError, ValueError):
        return fallback, 0.0, ""


def _reply_parser(name: str, fallback: str, text: str):
    """A column function that reads model replies strictly, batch-wise."""

    def parse(reply: Column) -> Column:
        def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                yield pd.DataFrame([parse_reply(x, name, fallback, text) for x in s], columns=[name, "confidence", text])

        return F.pandas_udf(read, f"struct<{name}:string,confidence:double,{text}:string>", F.PandasUDFType.SCALAR_ITER)(reply)

    return parse


parse_verdict = _reply_parser("verdict", "unrelated", "summary")
parse_action = _reply_parser("action", "flag", "reasoning")
