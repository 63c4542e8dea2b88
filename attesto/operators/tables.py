"""Tables in the cluster's shared folder, which cut lineages and outlive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []
_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside the cluster's shared checkpoint folder.

    The folder is spark.checkpoint.dir of the session. Where that is unset, a temporary
    folder is taken if all runs on this machine, as in tests; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="attesto-")
    path = f"{root}/attesto-{spark.sparkContext.applicationId}"
    if not any(p == path for _, p in _made):
        _made.append((spark, path))
    return path


#: Bytes a core up to which a table is small enough to be dealt out before costly work on its texts.
SMALL_SHARE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is small: a file of one row group would be one core's work. A large one is as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def put(spark: SparkSession, path: str, content: str | bytes) -> str:
    """Writes a small file of the driver's to any path that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def renamed(spark: SparkSession, path: str, to: str) -> str:
    """Moves a file or folder within one file system; the folder above the new place is made if need be."""
    a, b = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"{path} can't be moved to {to}")
    return to


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before; a local folder goes all the same
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _open:
        paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(keep: int = 0) -> Iterator[None]:
    """Deletes the tables written within, but for the last keep ones; whoever reads them must be done by then."""
    paths: list[tuple[SparkSession, str]] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.pop()
        for spark, path in paths[: len(paths) - keep]:
            delete(spark, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if a count finds at most so many rows, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
