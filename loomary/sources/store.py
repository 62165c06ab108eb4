"""A memory store on Parquet: append-only versions, latest view, one directory per tenant bucket.

Every write appends versions with rising numbers; a delete appends a tombstone.  The newest version
of a key is its state, whatever order files are read in, so a repeated append does no harm.  Tenants
are hashed to buckets, which are partition directories below that of each write: a point lookup reads
one bucket, and a write reads those of the tenants it writes.  Numbers are dealt in blocks, each claimed by creating a file
that must not exist, so no two writers share one.  ``compact`` rewrites the log to the newest
versions.
"""

from __future__ import annotations

import threading

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.scalars import matches
from ..functions.text import norm_id
from ..operators import consolidate, detect, health, lineage, provenance, search
from ..operators.records import pending
from ..operators.versions import latest
from ..session import Scratch

BUCKETS = 64
#: Write numbers of one block.
NUMBERS = 1 << 20

_claims = threading.Lock()


class StoreError(Exception):
    """Any error of the store."""


class NotFound(StoreError, KeyError):
    """The record to change isn't there (or belongs to another tenant)."""


class InvalidRecords(StoreError, ValueError):
    """A batch breaks validity rules; it isn't written."""


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


class _Log:
    """One versioned table."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str):
        self.spark, self.path, self.ddl, self.key = spark, path, ddl, key
        self.schema = _struct(ddl)

    def bucket(self, agent: Column) -> Column:
        return F.pmod(F.xxhash64(agent), F.lit(BUCKETS)).cast("int")

    def rows(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("write", T.LongType()), T.StructField("bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(full).parquet(self.path).drop("write")
        except AnalysisException:
            return self.spark.createDataFrame([], full).drop("write")

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of the tenants in ``df``: at most BUCKETS numbers."""
        return sorted(r[0] for r in df.select(self.bucket(F.col("agent_id"))).distinct().collect() if r[0] is not None)

    def state(self, agent_id: str | None = None, deleted: bool = False, buckets: list[int] | None = None) -> DataFrame:
        rows = self.rows()
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else rows
        if agent_id is not None:
            rows = rows.filter((F.col("bucket") == self.bucket(F.lit(agent_id))) & (F.col("agent_id") == agent_id))
        keep = {f.name: F.col(f.name) for f in self.schema.fields if f.name not in ("agent_id", self.key, "version_seq")} | {"version_seq": F.col("version_seq")}
        now = latest(rows, {"agent_id": F.col("agent_id"), self.key: norm_id(F.col(self.key))}, keep=keep)
        return now if deleted else now.filter(~F.col("op").eqNullSafe("delete"))

    def last(self) -> int:
        return self.rows().agg(F.coalesce(F.max("version_seq"), F.lit(0))).first()[0]

    def append(self, df: DataFrame, op: str) -> None:
        """Add versions of ``df``'s rows; a key's first number stays the one of its first version.

        The rows are written once before they are numbered, so each gets the next number of the
        claimed blocks, in the order of the frame.
        """
        scratch = Scratch(self.spark, "append")
        rows = scratch.save(df.withColumn(self.key, norm_id(F.col(self.key))).withColumn("_n", F.monotonically_increasing_id()), "rows")
        part, place = F.shiftright("_n", 33).cast("int"), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())  # one number per task
        total = sum(n for _, n in sizes)
        if not total:
            return
        start, offsets, upto = self._claim(total), [], 0
        for p, n in sizes:
            offsets.append((p, upto))
            upto += n
        numbers = F.broadcast(self.spark.createDataFrame(offsets, "_p int, _upto bigint"))
        rows = rows.withColumns({"_p": part, "_place": place}).join(numbers, "_p").withColumn("version_seq", F.lit(start) + F.col("_upto") + F.col("_place")).drop("_p", "_place", "_upto", "_n")
        known = self.state(deleted=True, buckets=self.touched(rows)).select("agent_id", self.key, F.col("first_seq").alias("_first"))
        rows = rows.drop("first_seq", "op").join(known, ["agent_id", self.key], "left")
        rows = rows.withColumns({"first_seq": F.coalesce("_first", "version_seq"), "op": F.lit(op), "bucket": self.bucket(F.col("agent_id"))})
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in rows.columns}
        out = rows.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], "bucket")
        out.write.partitionBy("bucket").parquet(f"{self.path}/write={start}")  # a folder of its own: two jobs can't commit into one
        scratch.clear()

    def _claim(self, n: int) -> int:
        """The first of ``n`` numbers that no other writer has: free blocks in a row, each a new file."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.path}-numbers")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        need = -(-n // NUMBERS)
        with _claims:  # writers of one process take turns; those of several meet at the files
            fs.mkdirs(at)
            taken = [int(f.getPath().getName()) for f in fs.listStatus(at)]
            first = 1 + (max(taken) if taken else self.last() // NUMBERS)
            got = first
            while got < first + need:
                try:
                    fs.create(path(f"{self.path}-numbers/{got}"), False).close()
                except Py4JJavaError as e:  # another writer was faster: start behind it
                    if "AlreadyExists" not in e.java_exception.getClass().getName():
                        raise
                    first = got + 1
                got += 1
        return first * NUMBERS + 1

    def compact(self, to: str) -> None:
        """The newest versions alone, sorted for skipping, as a new log at ``to``."""
        now = self.state().withColumn("bucket", self.bucket(F.col("agent_id")))
        now.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], "bucket").repartition("bucket").sortWithinPartitions("agent_id", "created_at" if "created_at" in now.columns else "detected_at").write.partitionBy("bucket").parquet(f"{to}/write=0")


class MemoryStore:
    """Memories and conflicts of all tenants, with the operations of a memory engine.

    ``as_of`` fixes the present for expiry and freshness (a column; default: the time of the query).
    """

    backend_name = "spark"

    def __init__(self, spark: SparkSession, path: str, vector_size: int | None = None, as_of: Column | None = None, similarity: float = schema.CLUSTER_SIMILARITY, classifier: detect.Classifier | None = None, planner=None, health_config: health.HealthConfig | None = None):
        if vector_size is not None and vector_size <= 0:
            raise ValueError("vector_size must be positive")
        self.spark, self.vector_size = spark, vector_size
        self.as_of = as_of if as_of is not None else F.current_timestamp()
        self.similarity, self.classifier, self.planner = similarity, classifier, planner
        self.health_config = health_config or health.HealthConfig(similarity=similarity)
        self.memories = _Log(spark, f"{path}/memories", schema.MEMORIES, "memory_id")
        self.conflicts = _Log(spark, f"{path}/conflicts", schema.CONFLICTS, "conflict_id")
        self._scratch: list[Scratch] = []
        if vector_size is not None:
            self._same_size(path, vector_size)

    def _same_size(self, path: str, size: int) -> None:
        """A store is opened with the vector size it was made with."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/vector-size")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        made = [int(f.getPath().getName()) for f in fs.listStatus(at)]
        if made and made != [size]:
            raise ValueError(f"the store holds vectors of {made[0]} numbers, not {size}")
        if not made:
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/vector-size/{size}"))

    def __repr__(self) -> str:
        return f"MemoryStore({self.memories.path.rsplit('/', 1)[0]!r})"

    def __enter__(self) -> MemoryStore:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Remove the intermediate tables of this store's queries; may be called again."""
        while self._scratch:
            self._scratch.pop().clear()

    def _hold(self, df: DataFrame, name: str) -> DataFrame:
        self._scratch.append(Scratch(self.spark, name))
        return self._scratch[-1].save(df, "rows")

    # -- writing

    def frame(self, rows: list[dict]) -> DataFrame:
        """Memories from plain values, with defaults filled in."""
        base = {"memory_type": "custom", "status": "active", "importance": schema.DEFAULT_IMPORTANCE, "access_count": 0, "supersedes": [], "metadata": "{}"}
        full = [{f.name: (base | r).get(f.name) for f in self.memories.schema.fields} for r in rows]
        df = self.spark.createDataFrame(full, self.memories.schema)
        now = F.current_timestamp()
        made = F.coalesce("created_at", now)
        return df.withColumns({"memory_id": F.coalesce("memory_id", F.uuid()), "created_at": made, "updated_at": F.coalesce("updated_at", made)})

    def check(self, df: DataFrame) -> None:
        schema.check_instants(df)
        rules = schema.memory_rules() | {f"provenance_{k}": v for k, v in schema.provenance_rules().items()}
        if self.vector_size is not None:
            rules["vector_size"] = F.coalesce(F.size("embedding") == self.vector_size, F.lit(True))
        broken = [r["rule"] for r in schema.violations(df, rules).collect() if r["n_rows"]]
        if broken:
            raise InvalidRecords(", ".join(broken))

    def store_batch(self, df: DataFrame) -> None:
        """Insert or replace; within a batch the row written last wins. No detection."""
        self.check(df)
        self.memories.append(df, "insert")

    def store(self, row: dict) -> DataFrame | None:
        """One memory; with a classifier also the conflicts it raises, which are stored and returned."""
        df = self.frame([row])
        self.store_batch(df)
        if self.classifier is None:
            return None
        mem = self.mem(row["agent_id"])
        new = mem.filter(F.col("memory_id") == str(row.get("memory_id", "")).strip().lower())
        found = detect.on_store(new, mem, self.classifier, self.similarity)
        self._keep_conflicts(found)
        return found

    def update(self, df: DataFrame) -> None:
        """Replace existing memories; any that isn't there is an error and nothing is written."""
        self._must_be_there(self.memories, df, "memory")
        self.check(df)
        self.memories.append(df, "update")

    def _must_be_there(self, log: _Log, df: DataFrame, what: str) -> None:
        known = log.state(buckets=log.touched(df)).select("agent_id", log.key)
        if not df.select("agent_id", norm_id(F.col(log.key)).alias(log.key)).join(known, ["agent_id", log.key], "left_anti").isEmpty():
            raise NotFound(what)

    def update_fields(self, agent_id: str, memory_id: str, **fields) -> None:
        """Change some fields of one memory and its ``updated_at``."""
        df = self.fetch(agent_id, memory_id)
        kinds = dict(df.dtypes)
        sets = {k: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]) for k, v in fields.items()}
        self.update(df.withColumns(sets | ({"updated_at": F.current_timestamp()} if "updated_at" not in sets else {})))

    def touch(self, agent_id: str, memory_id: str) -> None:
        """Count one access; nothing else changes."""
        self.update(self.fetch(agent_id, memory_id).withColumns({"access_count": F.col("access_count") + 1, "last_accessed": F.current_timestamp()}))

    def attach_provenance(self, agent_id: str, memory_id: str, value: Column) -> None:
        df = self.fetch(agent_id, memory_id)
        if not df.filter("provenance is not null").isEmpty():
            raise ValueError("provenance is set once")
        self.update(df.withColumn("provenance", value.cast(schema.PROVENANCE)))

    def delete_batch(self, agent_id: str, ids: list[str]) -> int:
        """Delete; the number of memories that were there."""
        gone = self.fetch_batch(agent_id, ids)
        n = gone.count()
        if n:
            self.memories.append(gone, "delete")
        return n

    def delete(self, agent_id: str, memory_id: str) -> bool:
        return self.delete_batch(agent_id, [memory_id]) > 0

    # -- reading

    def mem(self, agent_id: str | None = None) -> DataFrame:
        return self.memories.state(agent_id)

    def conf(self, agent_id: str | None = None) -> DataFrame:
        c = self.conflicts.state(agent_id)
        return c.withColumns({"lo": F.least("memory_a_id", "memory_b_id"), "hi": F.greatest("memory_a_id", "memory_b_id")})

    def fetch(self, agent_id: str, memory_id: str) -> DataFrame:
        """The memory as a frame of one row, or none."""
        return self.mem(agent_id).filter(F.col("memory_id") == memory_id.strip().lower())

    def fetch_batch(self, agent_id: str, ids: list[str]) -> DataFrame:
        want = [(i.strip().lower(),) for i in ids]
        return self.mem(agent_id).join(self.spark.createDataFrame(want, "memory_id string"), "memory_id", "left_semi").select(*self.mem(agent_id).columns)

    def exists(self, agent_id: str, memory_id: str) -> bool:
        return not self.fetch(agent_id, memory_id).isEmpty()

    def count(self, agent_id: str, status: str | None = None) -> int:
        m = self.mem(agent_id)
        return (m.filter(F.col("status") == status) if status else m).count()

    def list_all(self, agent_id: str, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Memories in order of creation, then of first write."""
        m = self.mem(agent_id)
        m = (m.filter(F.col("status") == status) if status else m).orderBy("created_at", "first_seq").offset(offset)
        return m if limit is None else m.limit(limit)

    def search(self, agent_id: str, query: list[float], top_k: int = 10, score_threshold: float | None = None, filters: dict | None = None, strict_status: bool = False, metric: str = "cosine") -> DataFrame:
        """Nearest memories with conflict flags and recommendation."""
        hits = search.search_one(self.mem(agent_id), agent_id, query, top_k, score_threshold, filters, metric).select("agent_id", F.lit(0).cast("bigint").alias("probe"), "memory_id", "score", "rank")
        return search.enrich(hits, self.mem(agent_id), self.conf(agent_id), strict_status).orderBy("rank")

    def where(self, agent_id: str, filters: dict) -> DataFrame:
        return self.mem(agent_id).filter(matches(F.col("metadata"), filters))

    # -- conflicts

    def _keep_conflicts(self, found: DataFrame) -> None:
        self.conflicts.append(found.withColumn("detected_at", F.current_timestamp()), "insert")

    def store_conflict(self, row: dict) -> None:
        full = {f.name: row.get(f.name) for f in self.conflicts.schema.fields}
        df = self.spark.createDataFrame([full], self.conflicts.schema).withColumns({"resolution_status": F.coalesce("resolution_status", F.lit("pending")), "detected_at": F.coalesce("detected_at", F.current_timestamp()), "conflict_id": F.coalesce("conflict_id", F.uuid())})
        self._valid_conflicts(df)
        self.conflicts.append(df, "insert")

    def fetch_conflict(self, agent_id: str, conflict_id: str) -> DataFrame:
        return self.conflicts.state(agent_id).filter(F.col("conflict_id") == conflict_id.strip().lower())

    def list_conflicts(self, agent_id: str, status: str | None = None) -> DataFrame:
        c = self.conflicts.state(agent_id)
        return (c.filter(F.col("resolution_status") == status) if status else c).orderBy("detected_at", "first_seq")

    def pending_review(self, agent_id: str) -> DataFrame:
        return self.list_conflicts(agent_id, "pending")

    def update_conflict(self, df: DataFrame) -> None:
        """Replace existing conflicts; one that isn't there, or breaks a rule, is an error and nothing is written."""
        self._must_be_there(self.conflicts, df, "conflict")
        self._valid_conflicts(df)
        self.conflicts.append(df, "update")

    def _valid_conflicts(self, df: DataFrame) -> None:
        broken = [r["rule"] for r in schema.violations(df, schema.conflict_rules()).collect() if r["n_rows"]]
        if broken:
            raise InvalidRecords(", ".join(broken))

    def resolve_conflict(self, agent_id: str, conflict_id: str, status: str, notes: str | None = None) -> None:
        """Close an open conflict; ``pending`` is no resolution."""
        if status == "pending" or status not in schema.RESOLUTIONS:
            raise ValueError("not a resolution")
        c = self.fetch_conflict(agent_id, conflict_id)
        if c.isEmpty():
            raise NotFound("conflict")
        self.update_conflict(c.withColumns({"resolution_status": F.lit(status), "resolved_at": F.current_timestamp(), "resolution_notes": F.lit(notes).cast("string")}))

    def delete_conflict(self, agent_id: str, conflict_id: str) -> bool:
        c = self.fetch_conflict(agent_id, conflict_id)
        if c.isEmpty():
            return False
        self.conflicts.append(c, "delete")
        return True

    # -- analysis

    def _narrow(self, agent_id: str | None) -> DataFrame:
        """Memories without their long columns, written once for plans that read them several times."""
        return self._hold(self.mem(agent_id).withColumn("has_provenance", F.col("provenance").isNotNull()).drop("metadata", "provenance"), "memories")

    def scan_contradictions(self, agent_id: str | None = None) -> DataFrame:
        """Detect, store and return the conflicts not known yet."""
        found = detect.scan(self._narrow(agent_id), self.conf(agent_id), self.as_of, self.classifier or detect.rule_classifier, self.similarity)
        n = self.conflicts.last()
        self._keep_conflicts(found)
        return self.conflicts.state(agent_id).filter(F.col("version_seq") > n)

    def health(self, agent_id: str | None = None) -> DataFrame:
        return health.health(self._narrow(agent_id), self.conf(agent_id), self.as_of, self.health_config)

    def plan(self, agent_id: str | None = None) -> DataFrame:
        return consolidate.plan(self.spark, self.mem(agent_id), self.conf(agent_id), self.planner or consolidate.rule_planner)

    def consolidate(self, agent_id: str | None = None, dry_run: bool = False, respect_tier: bool = False) -> DataFrame:
        """Plan, check, write all effects as new versions, and return the stamped actions."""
        actions = self.plan(agent_id)
        if dry_run:
            return consolidate.executed(actions, F.current_timestamp(), dry_run=True)
        mem, conf = self.mem(agent_id), self.conf(agent_id)
        bad = consolidate.preflight(actions, mem, conf)
        if not bad.isEmpty():
            raise NotFound("; ".join(f"{r['action_id']}: {r['problem']}" for r in bad.limit(20).collect()))
        hold = Scratch(self.spark, "effects")
        changed, merged = consolidate.effects(actions, mem, respect_tier)
        new = ["status", "superseded_by", "supersedes", "importance"]
        changed = hold.save(mem.drop(*new).join(changed, ["agent_id", "memory_id"]), "changed")
        now = F.current_timestamp()
        prov = F.struct(F.lit(None).cast("string").alias("record_id"), F.col("memory_id"), F.lit("system").alias("source_type"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("ingested_by"), F.lit(None).cast("string").alias("raw_content"), F.lit(None).cast("int").alias("chunk_index"), F.col("supersedes").alias("derived_from"), now.alias("ingested_at"))
        merged = hold.save(merged.withColumns({"memory_type": F.lit("custom"), "metadata": F.lit("{}"), "access_count": F.lit(0), "created_at": now, "updated_at": now, "provenance": prov}), "merged")
        closed = hold.save(consolidate.resolved(actions, conf), "closed")
        notes = conf.drop("lo", "hi").join(closed.select("agent_id", "conflict_id", F.col("resolution_status").alias("_s"), F.col("resolution_notes").alias("_n")), ["agent_id", "conflict_id"])
        notes = hold.save(notes.withColumns({"resolution_status": F.col("_s"), "resolution_notes": F.coalesce("_n", "resolution_notes"), "resolved_at": F.when(F.col("_s") != "pending", now).otherwise(F.col("resolved_at"))}).drop("_s", "_n"), "notes")
        for log, df, op in ((self.memories, changed, "update"), (self.memories, merged, "insert"), (self.conflicts, notes, "update")):
            if not df.isEmpty():
                log.append(df, op)
        return consolidate.executed(actions, now)

    def lineage(self, agent_id: str, memory_id: str) -> list[str]:
        """Ids from the oldest ancestor to the newest successor; empty if there is no such memory."""
        rows = lineage.lineage(self.spark, self.mem(agent_id)).filter(F.col("memory_id") == memory_id.strip().lower()).collect()
        return list(rows[0]["chain"]) if rows else []

    def provenance_for(self, agent_id: str, memory_id: str) -> DataFrame:
        return self.fetch(agent_id, memory_id).filter("provenance is not null").select("provenance.*")

    def export_provenance(self, agent_id: str, memory_id: str) -> DataFrame:
        return provenance.manifest(self.fetch(agent_id, memory_id))

    def export_provenance_json(self, agent_id: str, memory_id: str) -> str | None:
        rows = provenance.export_json(self.fetch(agent_id, memory_id)).collect()
        return rows[0]["document"] if rows else None

    def open_conflicts(self, agent_id: str | None = None) -> DataFrame:
        return pending(self.conf(agent_id))
