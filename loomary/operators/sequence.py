"""Places of rows within scopes of any size, without a window over a whole scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch


def numbered(df: DataFrame, scope: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in its scope, by ``order`` (nulls first), as column ``name``.

    Rows are cut into ranges of the whole order, so that a scope may lie in many tasks; a row's place
    is that within its range, plus the rows of the scope's earlier ranges.  Rows that are equal in
    ``order`` get places in any order.  The sorted rows are written once.
    """
    by = [*scope, *order]
    at = Scratch(df.sparkSession, "numbered")
    rows = at.save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "rows")
    ranges = rows.groupBy(*scope, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("_before", F.coalesce(earlier, F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in scope] + [F.col("r._range") == F.col("s._range")]
    joined = rows.alias("r").join(starts.alias("s"), same)
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns if c != name], (F.col("s._before") + F.col("r._row") - F.col("s._first") + 1).alias(name))
