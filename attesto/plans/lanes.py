"""Scheduled batch lanes: each reads what is new since the corpus' day and reports how it went."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import delete, exists, renamed

Lane = Callable[[SparkSession, str], DataFrame | None]


def since(manifest: dict | None, default: str = "2024-01-01") -> str:
    """The day from which a corpus lacks documents."""
    return str((manifest or {}).get("created_at", default))[:10]


def refresh(spark: SparkSession, lanes: dict[str, Lane], day: str, path: str, run: str | None = None, keys: dict[str, list[str]] | None = None) -> list[dict]:
    """Puts each lane's rows below path, as lane=<name>/run=<run>; a lane that fails leaves the others and its own last rows alone.

    A run is named by the day it starts from, unless a name is given. Its rows are written beside and moved to their
    place when they are whole, so a lane that runs again replaces what this run left before, and readers never see half
    of it. With keys of a lane, rows that repeat a key, or have one that an earlier run brought, are not new and are left
    out. A lane that returns None is skipped; one without rows is ok.

    The report has lane, run, status (ok, skipped or failed), rows (the new ones that were written) and error.
    """
    run, report = run or day, []
    for name, lane in lanes.items():
        at = f"{path}/lane={name}"
        said = {"lane": name, "run": run, "status": "ok", "rows": 0, "error": None}
        try:
            rows = lane(spark, day)
            if rows is None:
                report.append(said | {"status": "skipped"})
                continue
            key = (keys or {}).get(name)
            if key:
                rows = rows.dropDuplicates(key)
                if exists(spark, at):
                    own = F.col("run") == run
                    rows = rows.join(spark.read.schema(f"{_ddl(rows, key)}, run string").parquet(at).where(~own).select(*key).distinct(), key, "left_anti")
            made = f"{path}/_made/{uuid.uuid4().hex}"
            rows.write.parquet(made)
            said["rows"] = spark.read.schema(rows.schema).parquet(made).count()
            delete(spark, f"{at}/run={run}")
            renamed(spark, made, f"{at}/run={run}")
            report.append(said)
        except Exception as error:  # a lane's failure is its report
            report.append(said | {"status": "failed", "rows": 0, "error": str(error).split("\n")[0][:300]})
    return report


def _ddl(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def lane_rows(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """All rows of a lane with their run; none if it never ran."""
    at = f"{path}/lane={name}"
    return spark.read.schema(f"{schema}, run string").parquet(at) if exists(spark, at) else spark.createDataFrame([], f"{schema}, run string")


def rows_artifact(rows: DataFrame, path: str, said: str | None = None) -> str:
    """Writes rows, and beside them a summary of when, how many, and what is said of them."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    n = rows.sparkSession.read.parquet(f"{path}/rows").agg(F.count("*").alias("n"))
    summary = n.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mmXXX").alias("generated_at"), "n", F.lit(said).cast("string").alias("said"))
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary")
    return path


def outcomes_artifact(found: DataFrame, path: str) -> str:
    """Outcomes of promises, with the number of each status."""
    statuses = sorted((r.status, r["count"]) for r in found.groupBy("status").count().collect())
    return rows_artifact(found, path, ",".join(f"{k}={n}" for k, n in statuses))


def grid_artifact(hits: DataFrame, misses: DataFrame, sources: list[str], path: str) -> str:
    """Queue rows that have a jurisdiction, with their sources and how many have none."""
    return rows_artifact(hits.withColumn("sources", F.array(*(F.lit(x) for x in sources))), path, f"misses={misses.count()}")
