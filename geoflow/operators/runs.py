"""Snapshots of long runs: a folder with one partition for each step, and a manifest of the steps that are whole."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished(spark: SparkSession, folder: str, wanted: list[int]) -> list[int]:
    """The steps that are whole, up to the first of ``wanted`` that is not."""
    try:
        done = {r.step for r in spark.read.schema("rows long, step int").parquet(f"{folder}/_whole").select("step").collect()}
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        done = set()
    found = []
    for step in wanted:
        if step not in done:
            break
        found.append(step)
    return found


def finish(rows: DataFrame, folder: str, step: int) -> None:
    """Writes a step's rows in place of what is there, then names it in the manifest."""
    rows.write.mode("overwrite").parquet(f"{folder}/step={step}")
    snapshot(rows.sparkSession, folder, step).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/_whole/step={step}")


def snapshot(spark: SparkSession, folder: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/step={step}")


def snapshots(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """The rows of all whole steps of ``wanted``, with their step."""
    paths = [f"{folder}/step={s}" for s in finished(spark, folder, wanted)]
    return spark.read.option("basePath", folder).parquet(*paths)
