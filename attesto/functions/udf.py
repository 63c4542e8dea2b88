"""Arrow-batched UDFs that can be declared before there is a session, and the package for Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:  # workers that need no pandas don't load it
    import pandas as pd

_shipped: set[str] = set()


def reachable(spark: SparkSession) -> None:
    """Ships this package to the Python workers, once an application.

    Spark's own file server carries it, so workers need neither the driver's disk nor its sys.path.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="attesto-package-")  # the driver serves the file while the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def series_udf(ddl: str) -> Callable:
    """Decorates a function of pandas Series; the UDF is made when it is first applied to columns."""

    def wrap(f: Callable[..., pd.Series]) -> Callable[..., Column]:
        def apply(*columns) -> Column:
            session = SparkSession.getActiveSession()
            if session is not None:
                reachable(session)
                _bounded(session)
            return F.pandas_udf(f, ddl)(*columns)

        apply.__name__, apply.__doc__ = f.__name__, f.__doc__
        return apply

    return wrap


#: Bytes of an Arrow batch, where a session has Spark's own 64 MB: a worker and its executor hold a few batches each.
BATCH, SPARKS_BATCH = "8m", ("64m", "64MB", "67108864", "67108864b")


def _bounded(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", SPARKS_BATCH[0]) in SPARKS_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def in_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow() by workers that can import this package, in batches of BATCH bytes."""
    spark = df.sparkSession
    reachable(spark)
    _bounded(spark)
    return df.mapInArrow(f, schema)
