"""Sampled surfaces and height-field meshes; values depend on ids and the seed alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import uniform


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "point_id").withColumn("cloud_id", F.lit(0).cast("long"))


def _angles(ids: DataFrame, seed: int) -> DataFrame:
    return ids.withColumns({a: uniform("point_id", F.lit(seed), F.lit(a)) for a in ("u", "v")})


def torus(spark: SparkSession, n: int, big: float = 2.0, small: float = 1.0, seed: int = 0) -> DataFrame:
    return torus_at(_ids(spark, n), big, small, seed)


def torus_at(ids: DataFrame, big: float = 2.0, small: float = 1.0, seed: int = 0) -> DataFrame:
    """A point of the torus for each (cloud_id, point_id); the draw depends on point_id and the seed."""
    u, v = F.col("u") * 2 * math.pi, F.col("v") * 2 * math.pi
    around = big + small * F.cos(v)
    return _angles(ids, seed).select("cloud_id", "point_id", (around * F.cos(u)).alias("x"), (around * F.sin(u)).alias("y"), (small * F.sin(v)).alias("z"))


def sphere(spark: SparkSession, n: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    return sphere_at(_ids(spark, n), radius, seed)


def sphere_at(ids: DataFrame, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """A point of the sphere for each (cloud_id, point_id)."""
    turn, down = F.col("u") * 2 * math.pi, F.acos(2 * F.col("v") - 1)
    return _angles(ids, seed).select("cloud_id", "point_id", (radius * F.sin(down) * F.cos(turn)).alias("x"), (radius * F.sin(down) * F.sin(turn)).alias("y"), (radius * F.cos(down)).alias("z"))


def grid_faces(cells: DataFrame, side: int) -> DataFrame:
    """Two faces for each cell (mesh_id, cell) of a grid of side * side vertices numbered row by row."""
    i0 = F.expr(f"cell div {side - 1}") * side + F.col("cell") % (side - 1)
    corner = lambda d: (i0 + d).cast("long")
    faces = F.array(*[F.struct(*[corner(d).alias(f"v{k}") for k, d in enumerate(f)]) for f in ((0, 1, side), (1, side + 1, side))])
    rows = cells.select("mesh_id", "cell", F.posexplode(faces).alias("half", "f"))
    return rows.select("mesh_id", (2 * F.col("cell") + F.col("half")).alias("face_id"), "f.*")
