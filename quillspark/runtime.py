"""Session helpers: table loading, durable intermediate tables, code shipping and bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 64 << 20
#: Spark's setting that deletes the shuffle files of a job when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test-data directory; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's spark.checkpoint.dir. Only a session whose executors run in the
    driver (tests) may leave that unset; it gets a temporary folder, removed at exit."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not in_driver(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(sc, "_quillspark_dir", None)
        if where is None:
            where = tempfile.mkdtemp(prefix="quillspark-")
            sc._quillspark_dir = where
            atexit.register(shutil.rmtree, where, True)
    return where.rstrip("/")


def in_driver(master: str) -> bool:
    """Whether a master runs its executors inside the driver; local-cluster does not."""
    return master == "local" or master.startswith("local[")


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/quillspark-tables/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back, which cuts lineage durably and frees
    the shuffle files of the job. The table stays until :func:`release`, or until :func:`clear` at the end of the application's work: results read from it lazily."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Call it when no result is read any more."""
    delete(spark, tables_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of any file system that Spark knows; one that is not there is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions import there."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="quillspark-code-")
    atexit.register(shutil.rmtree, tmp, True)
    target = os.path.join(tmp, "quillspark-code.zip")  # served to the executors by the driver
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("quillspark", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._quillspark_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than the session has cores, dealt out to all of them before work that is heavy
    per row. A scan of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_enough(rows: int, row_bytes: int) -> bool:
    """The check made before every broadcast of counted data."""
    return rows * row_bytes <= BROADCAST_BYTES


def join_bounded(left: DataFrame, right: DataFrame, on, how: str, rows: int, row_bytes: int) -> DataFrame:
    """Join that broadcasts ``right`` when its counted size is under the bound and shuffles both sides otherwise."""
    return left.join(F.broadcast(right) if small_enough(rows, row_bytes) else right, on, how)
