"""Referential integrity over change logs, by signed counts.

Every key of a referenced table carries two counters: how many current rows refer to it and how
many current records exist under it (0 or 1).  A changed record sends signed deltas, ``-1`` for
what its former version said and ``+1`` for what its new version says; deltas add up in any order,
so late and repeated rows do no harm.  Keys with positive references and zero existence are the
orphan report, and a batch of changes touches only the records and keys it names.

The report never looks at references of sound keys: only keys that the counters suspect (no record,
or one first written after the oldest reference) meet their references again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..session import Scratch

KEY = ("agent_id", "key")


@dataclass(frozen=True)
class Referrer:
    """A log whose rows refer to keys: its name, record id, reference columns and time of the report."""

    table: str
    record_id: str
    fields: tuple[str, ...]
    time: str


CONFLICTS = Referrer("conflicts", "conflict_id", ("memory_a_id", "memory_b_id"), "detected_at")
MEMORIES = Referrer("memories", "memory_id", ("superseded_by",), "updated_at")

RECORDS = "table_name string, agent_id string, record_id string, version_seq bigint, live boolean, first_seq bigint, at timestamp, refs array<struct<field:string,key:string>>"
COUNTS = "agent_id string, key string, refs bigint, existing bigint, ever bigint, first_seq bigint, first_ref bigint"


def versions(log: DataFrame, of: Referrer) -> DataFrame:
    """The newest version of each record in ``log``, as RECORDS rows with its references."""
    refs = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), norm_id(F.col(f)).alias("key")) for f in of.fields]), lambda r: r["key"].isNotNull())
    live = ~F.col("op").eqNullSafe("delete")
    rows = log.select(
        F.lit(of.table).alias("table_name"), "agent_id", norm_id(F.col(of.record_id)).alias("record_id"), "version_seq",
        F.struct(F.col("version_seq"), live.alias("live"), F.col("first_seq"), F.col(of.time).cast("timestamp").alias("at"), F.when(live, refs).otherwise(F.array().cast("array<struct<field:string,key:string>>")).alias("refs")).alias("row"),
    ).filter("agent_id is not null and record_id is not null and version_seq is not null")
    newest = rows.groupBy("table_name", "agent_id", "record_id").agg(F.max_by("row", "version_seq").alias("row"))
    return newest.select("table_name", "agent_id", "record_id", "row.*")


def deltas(records: DataFrame, sign: int, referenced: str = MEMORIES.table) -> DataFrame:
    """Signed counter changes that ``records`` stand for: existence of referenced keys, and references.

    ``first_seq`` and ``first_ref`` (the oldest row that ever referred to the key) are bounds: they
    only ever fall, whatever is withdrawn.
    """
    one = F.lit(sign).cast("bigint")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    held = records.filter(F.col("table_name") == referenced).select("agent_id", F.col("record_id").alias("key"), zero.alias("refs"), F.when(F.col("live"), one).otherwise(zero).alias("existing"), one.alias("ever"), F.when(F.lit(sign > 0), F.col("first_seq")).alias("first_seq"), none.alias("first_ref"))
    named = records.select("agent_id", "version_seq", F.explode("refs").alias("r")).select("agent_id", F.col("r.key").alias("key"), one.alias("refs"), zero.alias("existing"), zero.alias("ever"), none.alias("first_seq"), F.when(F.lit(sign > 0), F.col("version_seq")).alias("first_ref"))
    return held.unionByName(named)


def add_up(*parts: DataFrame) -> DataFrame:
    """Counters per key from any number of delta or counter tables; summed before the shuffle."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"), F.sum("ever").alias("ever"), F.min("first_seq").alias("first_seq"), F.min("first_ref").alias("first_ref"))


def changes(before: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions that take effect, versions they replace) of ``changed`` over the newest ones ``before``.

    A version that is not above the stored one is a repeat or a late row and changes nothing.
    """
    key = ["table_name", "agent_id", "record_id"]
    old = before.select(*key, F.col("version_seq").alias("_had"))
    news = changed.join(old, key, "left").filter("_had is null or version_seq > _had").drop("_had")
    return news, before.join(news.select(*key), key, "left_semi")


def apply_changes(records: DataFrame, counts: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after a batch: (records, counts). ``changed`` holds newest versions as from ``versions``."""
    news, gone = changes(records, changed)
    after = records.join(news.select("table_name", "agent_id", "record_id"), ["table_name", "agent_id", "record_id"], "left_anti").unionByName(news)
    return after, add_up(counts, deltas(gone, -1), deltas(news, 1))


def orphan_keys(counts: DataFrame) -> DataFrame:
    """The current report by key: referenced, but not existing."""
    return counts.filter("refs > 0 and existing = 0")


def late_keys(counts: DataFrame) -> DataFrame:
    """Existing keys that were first written after a row that referred to them, as far as the counters tell."""
    return counts.filter("refs > 0 and existing > 0 and first_seq > first_ref")


def orphan_references(records: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per orphan reference: (table_name, field, agent_id, key, version_seq, reason, period).

    reason: missing (no such key ever), else deleted, else late (the key was first written after
    the referring row).  Null or blank ids are no references; ``period`` is null where the referring
    row has no time.  Extra columns of the logs are ignored, empty logs give no rows.  Both inputs
    are written tables with one row per record and per key, so the join's sides are plain shuffles:
    a key that a third of all rows refer to is split by AQE's skew join.
    """
    suspects = orphan_keys(counts).unionByName(late_keys(counts)).select(*KEY, "existing", "ever", "first_seq")
    refs = records.select("table_name", "agent_id", "version_seq", "at", F.explode("refs").alias("r")).select("table_name", "agent_id", "version_seq", F.col("r.field").alias("field"), F.col("r.key").alias("key"), F.date_format("at", "yyyy-MM").alias("period"))
    late = F.col("first_seq") > F.col("version_seq")
    reason = F.when(F.col("ever") == 0, "missing").when(F.col("existing") == 0, "deleted").when(late, "late")
    return refs.join(suspects, list(KEY)).withColumn("reason", reason).filter("reason is not null").select("table_name", "field", "agent_id", "key", "version_seq", "reason", "period")


def orphans(memories: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Orphan references of whole logs: the first batch of an empty state, so every record is new."""
    scratch = Scratch(memories.sparkSession, "orphans")
    records = scratch.save(versions(memories, MEMORIES).unionByName(versions(conflicts, CONFLICTS)), "records")
    return orphan_references(records, scratch.save(add_up(deltas(records, 1)), "counts"))


class ReferenceState:
    """Records and counters kept in a folder, changed batch by batch.

    A batch is a folder of its own: the record versions that took effect, and the summed deltas of
    the counters.  It counts once its mark is written, so a batch that broke off is written anew and
    one that is repeated does nothing.  Records lie in hash buckets, and a batch reads only those it
    names.  ``compact`` folds all batches into one.
    """

    BUCKETS = 32

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(path))

    def batches(self) -> list[str]:
        """Names of the batches in effect; those folded into another are none."""
        marks = {f.getPath().getName()[5:] for f in self._fs.listStatus(self._path(self.path)) if f.getPath().getName().startswith("done-")}
        folded = {m.split("@")[1] for m in marks if m.startswith("upto@")}
        last = max(folded, key=int, default=None)
        return sorted(m for m in marks if (m == f"upto@{last}") or ("@" not in m and (last is None or self._order(m) > int(last))))

    def _order(self, name: str) -> int:
        with_order = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{name}")) if f.getPath().getName().startswith("order-")]
        return int(with_order[0][6:])

    def _read(self, part: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        at = [f"{self.path}/{b}/{part}" for b in self.batches()]
        if not at:
            return self.spark.createDataFrame([], ddl)
        out = reduce(DataFrame.unionByName, [self.spark.read.schema(f"{ddl}, bucket int").parquet(x) for x in at])
        return (out if buckets is None else out.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def records(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version of each record."""
        rows = self._read("records", RECORDS, buckets)
        key = ["table_name", "agent_id", "record_id"]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), "version_seq").alias("row")).select(*key, "row.*")

    def counts(self) -> DataFrame:
        return add_up(self._read("counts", COUNTS))

    def _bucket(self, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.BUCKETS)).cast("int")

    def _write(self, name: str, records: DataFrame, counts: DataFrame) -> None:
        order = self._next()
        for part, df, key in (("records", records, ("agent_id", "record_id")), ("counts", counts, ("agent_id", "key"))):
            df.withColumn("bucket", self._bucket(*key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/{part}")
        self._fs.create(self._path(f"{self.path}/{name}/order-{order}"), True).close()
        self._fs.create(self._path(f"{self.path}/done-{name}"), True).close()

    def _next(self) -> int:
        names = [b for b in self.batches()]
        return 1 + max([int(b.split("@")[1]) if "@" in b else self._order(b) for b in names], default=0)

    def apply(self, name: str, *logs: tuple[DataFrame, Referrer]) -> None:
        """Take in a batch of log rows under a name; a batch of a known name changes nothing."""
        if self._fs.exists(self._path(f"{self.path}/done-{name}")):
            return
        scratch = Scratch(self.spark, "references")
        changed = scratch.save(reduce(DataFrame.unionByName, [versions(log, of) for log, of in logs]), "changed")
        touched = [r[0] for r in changed.select(self._bucket("agent_id", "record_id")).distinct().collect()]  # at most BUCKETS numbers
        news, gone = changes(self.records(touched), changed)
        news = scratch.save(news, "news")
        self._write(name, news, add_up(deltas(gone, -1), deltas(news, 1)))
        scratch.drop(changed)
        scratch.drop(news)

    def compact(self) -> None:
        """Fold all batches into one; the folders of the former ones may then be removed."""
        upto = self._next() - 1
        if upto and self.batches() != [f"upto@{upto}"]:
            self._write(f"upto@{upto}", self.records(), self.counts())

    def orphans(self) -> DataFrame:
        scratch = Scratch(self.spark, "orphans")
        return orphan_references(scratch.save(self.records(), "records"), scratch.save(self.counts(), "counts"))


def replayed(state: ReferenceState, memories: DataFrame, conflicts: DataFrame, batches: int) -> DataFrame:
    """Orphan references after both logs went into ``state`` in equal ranges of write numbers."""
    both = memories.select("version_seq").unionByName(conflicts.select("version_seq"))
    lo, hi = both.agg(F.min("version_seq"), F.max("version_seq")).first()
    if lo is not None:
        for i in range(batches):
            part = F.floor((F.col("version_seq") - lo) * batches / (hi - lo + 1)) == i
            state.apply(f"part-{i}", (memories.filter(part), MEMORIES), (conflicts.filter(part), CONFLICTS))
    return state.orphans()


def report(orphan_rows: DataFrame, by: tuple[Column | str, ...] = ("table_name", "field", "reason", "period")) -> DataFrame:
    """Orphan references counted per table, field, reason and month."""
    return orphan_rows.groupBy(*by).agg(F.count("*").alias("n_refs"))
