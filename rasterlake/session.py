"""Session helpers: the shared scratch folder and stage tables written to it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir`` when the cluster names one, else the folder
    given to ``setCheckpointDir``.  A temporary local folder is made only for a
    local master, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Rows of a table that joins may broadcast on their own account, in bytes.
MEASURED = "10MB"


def broadcast_by_measure(spark: SparkSession) -> None:
    """Lets joins broadcast a table only when an exchange has measured its rows.

    Before that Spark goes by the bytes of Parquet files, and pixels take one or two
    bytes each there: tables of millions of rows would be sent through the driver.
    Broadcasts that are asked for stay.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED)


ROWS_PER_TASK = 100_000
#: Spark's setting to remove shuffle files when a query has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that share ``rows`` short rows, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def materialize(df: DataFrame, name: str = "stage", tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    ``tasks`` joins partitions to so many at most, where a bound of the rows is
    known (see ``tasks_for``): else small results become many tiny files.

    The exchanges of the write are removed with it, as nothing reads them again.

    This cuts the lineage (a lost executor costs no recomputation of earlier
    stages) and drops the known partitioning, so later joins exchange both
    sides and adaptive execution may split skewed keys.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    if _STAGES.get() is not None:
        _STAGES.get().tables.append(out)
    return out


class Stages:
    """The stage tables written in a ``with stages()`` block."""

    def __init__(self, outer: Stages | None) -> None:
        self.outer, self.tables = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves one to the block around, if there is any."""
        self.tables = [t for t in self.tables if t is not df]
        if self.outer is not None:
            self.outer.tables.append(df)
        return df

    def release(self, *dfs: DataFrame) -> None:
        """Deletes some before the block ends."""
        self.tables = [t for t in self.tables if not any(t is df for df in dfs)]
        release(*dfs)


_STAGES: ContextVar[Stages | None] = ContextVar("stages", default=None)


@contextmanager
def stages() -> Iterator[Stages]:
    """Deletes the stage tables that are written in its block when that ends, but for those kept."""
    own = Stages(_STAGES.get())
    token = _STAGES.set(own)
    try:
        yield own
        release(*own.tables)
    finally:
        _STAGES.reset(token)


def release(*stages: DataFrame) -> None:
    """Delete stage tables that ``materialize`` wrote and nothing reads again.

    What was made from them must be written by now: a lost executor's work is
    done again from the files that it read.
    """
    for df in stages:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_rasterlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "rasterlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._rasterlake_shipped = True
