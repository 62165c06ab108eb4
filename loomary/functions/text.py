"""Identifiers and words as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding blanks: ASCII white space and the Unicode spaces.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column) -> Column:
    """``str.strip`` of Python: Spark's own ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(BLANKS))


def norm_id(c: Column) -> Column:
    """An id without surrounding blanks and letter case; null where nothing is left."""
    v = F.lower(strip(c))
    return F.when(v != "", v)


def code(c: Column) -> Column:
    """A code word: blanks around it and case ignored, inner blanks and hyphens as underscores."""
    return F.regexp_replace(norm_id(c), r"[\s\-]+", "_")


def words(c: Column) -> Column:
    """Longest runs of letters or digits, lower-cased; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
