"""Sessions and durable intermediate tables.

Iterative operators cut their lineage by writing Parquet into the folder that all executors share
(``spark.checkpoint.dir``).  A lost executor then costs only the tasks it ran; the tables also give
Catalyst real sizes, so a small round is joined by broadcast and a large one by shuffle.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loomary", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only on a single machine whose session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomary-")
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_scopes: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes at its end all intermediate tables made within it; results must be written before.

    For applications that live long: without a scope the tables stay until the application ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for s in _scopes.pop():
            s.clear()


class Scratch:
    """Intermediate tables of one operator call.

    ``save`` writes and reads back; ``drop`` removes a table that no later step reads.  What is
    left at the end of a ``scratch_scope``, or of the application, is removed then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._serial = 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._serial += 1
        at = f"{self.root}/{name}-{self._serial}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (at := getattr(df, "_scratch_path", None)):
            self._fs.delete(self._path(at), True)


def hold(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, for plans that read it several times."""
    return Scratch(df.sparkSession, name).save(df, "rows")


def any_rows(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) > 0
