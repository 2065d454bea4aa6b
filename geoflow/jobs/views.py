"""Point clouds, meshes and fields as views over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import table
from ..sources.samples import grid_faces


def pts_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of all embeddings as one cloud."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit(0).cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def pts_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one cloud for each label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def field_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth component as a field."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), F.get("embedding", F.lit(3)).cast("double").alias("value"))


def field_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on points of even id only, for joins with missing values."""
    return field_embed(spark, sf_dir).filter("point_id % 2 = 0")


def _grid(spark: SparkSession, rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    side = math.isqrt(n)
    here = rows.filter(F.col("id") < side * side)
    points = here.select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("point_id"), (F.col("id") % side * 10 / F.lit(float(side))).alias("x"), (F.expr(f"id div {side}") * 10 / F.lit(float(side))).alias("y"), "z")
    cells = here.filter((F.col("id") % side < side - 1) & (F.col("id") < side * (side - 1)))
    cells = cells.select(F.lit(0).cast("long").alias("mesh_id"), (F.expr(f"id div {side}") * (side - 1) + F.col("id") % side).alias("cell"))
    return points, grid_faces(cells, side)


def mesh_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A height field over the parts' keys."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("z"))
    return _grid(spark, rows, rows.count())


def mesh_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A height field over the orders' keys."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("z"))
    return _grid(spark, rows, rows.count())


def multivectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two multivectors of three axes for each order line."""
    names = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    parts = [F.col(n).cast("double") for n in names] + [F.col(n).cast("double") / 2 for n in names]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*parts).alias("a"))
    return rows.withColumn("b", F.reverse("a"))
