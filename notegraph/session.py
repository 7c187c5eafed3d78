"""The session's shared folder, tables written once, and getting this package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .errors import NoteError

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the session's Python workers, once for each application.

    Needless where the package is installed on all nodes, and harmless there.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="notegraph-"), "notegraph.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent).as_posix())
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the session is local, as in tests, a temporary folder is
    made and kept for the session; on a cluster the setting is needed.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("notegraph.sharedDir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise NoteError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="notegraph-shared-")
        spark.conf.set("notegraph.sharedDir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/notegraph/{spark.sparkContext.applicationId}"


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches of texts hold ``rows`` rows, unless the session sets another number.

    Spark's default of 10,000 rows makes batches of tens of MB where rows are texts, in
    the JVM's off-heap memory and in the Python worker at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


#: Rows for each file of a written table whose number of rows is known.
ROWS_A_FILE = 200_000


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, computes the plan once
    (``checkpoint()`` computes it twice) and gives the optimiser real sizes.  ``rows``, if
    about known, keeps a small table from being cut into as many files as there are
    shuffle partitions; it never adds partitions.
    """
    path = f"{own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _held(df.sparkSession).append(path)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What ``keep`` and ``materialise`` hold for each application, in order: DataFrames and paths.
_HELD: dict[str, list[DataFrame | str]] = {}


def _held(spark: SparkSession) -> list[DataFrame | str]:
    return _HELD.setdefault(spark.sparkContext.applicationId, [])


def keep(df: DataFrame) -> DataFrame:
    """``df``, kept on the executors' disks once it is computed.

    For wide results of one pass that a few later steps read: nothing goes through the
    shared folder, and parts that go with a lost executor are computed again from their
    input.  Where a lineage grows step by step, or must not be run twice, ``materialise``.
    """
    _held(df.sparkSession).append(df.persist(StorageLevel.DISK_ONLY))
    return df


def mark(spark: SparkSession) -> int:
    """Now, for ``clear``."""
    return len(_held(spark))


def clear(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Drop what ``keep`` and ``materialise`` hold, if wanted only what came between two marks.

    Results that are not yet computed need what they were built on.
    """
    held, context = _held(spark), spark.sparkContext
    paths = [own_folder(spark)] if since == 0 and until is None else []
    for x in held[since:until]:
        if isinstance(x, DataFrame):
            x.unpersist()
        else:
            paths.append(x)
    for path in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    del held[since:until]
