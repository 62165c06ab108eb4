"""Current records in one spelling: the views all reference operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import vector
from ..functions.scalars import is_usable
from ..functions.text import code, norm_id
from .versions import current_conflicts, current_memories

_PLAIN = ("memory_type", "text", "metadata", "created_at", "updated_at", "expires_at", "importance", "access_count", "last_accessed", "provenance", "first_seq", "version_seq")


def _known(c: Column, domain: tuple[str, ...]) -> Column:
    v = code(c)
    return F.when(v.isin(*domain), v).otherwise("unknown")


def memories(log: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Current memories: ids in lower case, statuses in one spelling (else ``unknown``), links normalised.

    ``embedding`` stays as it is written; ``columns`` limits what moves through the shuffle, and may
    ask for ``has_provenance`` instead of the struct.
    """
    keep = {c: F.col(c) for c in _PLAIN} | {
        "embedding": F.col("embedding").cast("array<double>"),
        "status": _known(F.col("status"), schema.STATUSES),
        "superseded_by": norm_id(F.col("superseded_by")),
        "supersedes": F.filter(F.transform(F.coalesce("supersedes", F.array().cast("array<string>")), norm_id), lambda x: x.isNotNull()),
    }
    # naming a small leaf keeps the long texts of the struct out of the scan
    extra = {"has_provenance": F.col("provenance.chunk_index").isNotNull() | F.col("provenance").isNotNull()}
    keep |= {c: v for c, v in extra.items() if columns is not None and c in columns}
    names = [c for c in keep if columns is None or c in columns]
    return current_memories(log, {c: keep[c] for c in names})


def conflicts(log: DataFrame) -> DataFrame:
    """Current conflicts with ids, types and resolutions in one spelling, and the unordered pair (lo, hi)."""
    a, b = norm_id(F.col("memory_a_id")), norm_id(F.col("memory_b_id"))
    out = current_conflicts(log, {"memory_a_id": a, "memory_b_id": b, "conflict_type": _known(F.col("conflict_type"), schema.CONFLICT_TYPES), "confidence": F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence")), "description": F.col("description"), "resolution_status": _known(F.col("resolution_status"), schema.RESOLUTIONS), "detected_at": F.col("detected_at"), "first_seq": F.col("first_seq"), "version_seq": F.col("version_seq")})
    return out.withColumns({"lo": F.least("memory_a_id", "memory_b_id"), "hi": F.greatest("memory_a_id", "memory_b_id")})


def pending(conf: DataFrame) -> DataFrame:
    """Conflicts that wait for a decision between two different memories."""
    return conf.filter("resolution_status = 'pending' and memory_a_id is not null and memory_b_id is not null and memory_a_id <> memory_b_id")


def usable(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.filter(is_usable(as_of))


def embedded(mem: DataFrame) -> DataFrame:
    """Memories whose vector has a length."""
    return mem.filter(vector.usable(F.col("embedding")))
