"""Tables that several jobs read: written once to the folder all machines share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: Applications whose folder goes when the driver's process ends.
_SWEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset: a folder of our own if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="trawl-shared-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    """This application's folder; it is deleted when the driver ends, since results read from it until then."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/trawl/{app}"
    if app not in _SWEPT:
        _SWEPT.add(app)
        atexit.register(forget, spark, path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared tables."""
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_tables(spark: SparkSession) -> None:
    """Deletes all shared tables that this application has written: for when its results are written."""
    forget(spark, _folder(spark))


#: Rows of an Arrow batch: texts may be long, and batches of both sides of each Python worker are held outside the heap.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session says how large they are to be."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


#: Parquet's vectored reads take a row group's columns as one range and keep a buffer outside the heap as large as that for each reading thread.
VECTORED_KEY = "parquet.hadoop.vectored.io.enabled"
#: Bytes of a row group: what a task holds of a table, inside the heap and outside, while it writes or reads it.
GROUP_KEY, GROUP_BYTES = "parquet.block.size", 16 << 20


def bounded_reads(spark: SparkSession) -> None:
    """Parquet read in pieces of bounded size, unless the session says how."""
    if spark.conf.get(VECTORED_KEY, None) is None:
        spark.conf.set(VECTORED_KEY, "false")


#: Characters of a plan's text that Spark keeps, on the driver, for each of the last thousand queries: plans of many rounds have hundreds of thousands.
PLAN_KEY, PLAN_CHARACTERS = "spark.sql.maxPlanStringLength", 20_000


def short_plans(spark: SparkSession) -> None:
    """Bounded texts of plans, unless the session says how long they may be."""
    if spark.conf.get(PLAN_KEY, None) in (None, str((1 << 31) - 16)):
        spark.conf.set(PLAN_KEY, PLAN_CHARACTERS)


def tidy(spark: SparkSession) -> None:
    """Lets the driver collect its garbage where its heap has grown over half of what it may have: plans and results of
    steps that are over, and only then Spark removes their shuffle files and broadcasts."""
    jvm = spark.sparkContext._jvm
    memory = jvm.java.lang.Runtime.getRuntime()
    if 2 * memory.totalMemory() > memory.maxMemory():
        jvm.java.lang.System.gc()


def materialise(df: DataFrame, tag: str, codec: str = "zstd", share: int = 1) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which also cuts its lineage.

    ``share`` over 1 is for tables that are small beside the input: a file for so many
    shuffle partitions, so that rounds over them do not leave thousands of tiny files.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    bounded_reads(spark)
    short_plans(spark)
    path = new_path(spark, tag)
    if share > 1:
        df = df.coalesce(max(1, width(spark) // share))
    df.write.option("compression", codec).option(GROUP_KEY, GROUP_BYTES).parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    bounded_reads(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct(**types: str) -> T.StructType:
    """A schema from names and simple types (integer, long, double, boolean, string, binary)."""
    out = T.StructType()
    for name, kind in types.items():
        out.add(name, kind)
    return out


def width(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release() -> None:
    """Gives memory that a finished step has freed back to the system: worker processes live on and would keep it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
