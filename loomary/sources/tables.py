"""Tables by name in a folder of Parquet files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


_NAME = re.compile(r"[A-Za-z_]\w*")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of a name; names are words, so that no path can be smuggled in."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return spark.read.parquet(f"{root}/{name}.parquet")
