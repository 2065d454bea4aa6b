"""Normalization, scalar fields, colours and glyphs of point clouds (cloud_id, point_id, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dealt

AXES = ("x", "y", "z")


def normalize(points: DataFrame) -> DataFrame:
    """Centre each cloud's box at the origin and scale its longest side to 2; a side of 1e-9 or less is not scaled."""
    box = points.groupBy("cloud_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    extent = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES])
    box = box.select("cloud_id", *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2).alias(f"c_{a}") for a in AXES], F.when(extent > 1e-9, 2 / extent).otherwise(1.0).alias("scale"))
    return points.join(box, "cloud_id").select("cloud_id", "point_id", *[((F.col(a) - F.col(f"c_{a}")) * F.col("scale")).alias(a) for a in AXES])


def heat_colour(t: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue bytes: blue through white to red over 0 to 1."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    low = t < 0.5
    fall = 1 - 2 * (t - 0.5)
    return tuple((c * 255).cast("int") for c in (F.when(low, 2 * t).otherwise(1.0), F.when(low, 2 * t).otherwise(fall), F.when(low, 1.0).otherwise(fall)))


def field_bounds(field: DataFrame, sigma_clip: float = 2.0) -> DataFrame:
    """(cloud_id, lo, hi): mean less and plus ``sigma_clip`` population deviations of the finite values; 0, 0 without any."""
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    found = field.groupBy("cloud_id").agg(F.avg(finite).alias("m"), F.stddev_pop(finite).alias("s"))
    return found.select("cloud_id", *[F.coalesce(F.col("m") + k * sigma_clip * F.col("s"), F.lit(0.0)).alias(n) for k, n in ((-1, "lo"), (1, "hi"))])


def coloured(points: DataFrame, field: DataFrame, sigma_clip: float = 2.0) -> DataFrame:
    """Points with value (0 where the field has none), t and colour bytes."""
    rows = points.join(dealt(field), ["cloud_id", "point_id"], "left").join(field_bounds(field, sigma_clip), "cloud_id", "left")
    rows = rows.withColumn("value", F.coalesce("value", F.lit(0.0))).fillna(0.0, ["lo", "hi"])
    rows = rows.withColumn("t", (F.col("value") - F.col("lo")) / F.greatest(F.lit(1e-12), F.col("hi") - F.col("lo")))
    return rows.withColumns(dict(zip(("red", "green", "blue"), heat_colour(F.col("t")), strict=True))).drop("lo", "hi")


def height(points: DataFrame) -> DataFrame:
    return points.select("cloud_id", "point_id", F.col("y").alias("value"))


def impulse(points: DataFrame, size: float = 1000.0) -> DataFrame:
    """``size`` at the point of largest y (the first on ties), 0 elsewhere."""
    top = points.groupBy("cloud_id").agg(F.max_by("point_id", F.struct("y", -F.col("point_id"))).alias("top"))
    return points.join(top, "cloud_id").select("cloud_id", "point_id", F.when(F.col("point_id") == F.col("top"), size).otherwise(0.0).alias("value"))


def strided(points: DataFrame, most: int) -> DataFrame:
    """Every n-th point, so that about ``most`` are left."""
    n = points.groupBy("cloud_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / most)).alias("step"))
    return points.join(n, "cloud_id").filter(F.col("point_id") % F.col("step") == 0).drop("step")


#: A tetrahedron's corners in units of the radius, and its faces.
CORNERS = ((0.0, 1.5, 0.0), (-1.0, -1.0, 1.0), (1.0, -1.0, 1.0), (0.0, -1.0, -1.0))
FACES = ((0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 3, 2))


def glyph_vertices(points: DataFrame, radius: float = 0.01) -> DataFrame:
    """Four corners for each point, numbered from 4 * point_id."""
    corners = F.array(*[F.struct(*[(F.col(a) + c * radius).alias(a) for a, c in zip(AXES, corner, strict=True)]) for corner in CORNERS])
    rows = points.select("cloud_id", "point_id", F.posexplode(corners).alias("corner", "at"))
    return rows.select("cloud_id", (4 * F.col("point_id") + F.col("corner")).alias("vertex_id"), "at.*")


def glyph_faces(points: DataFrame) -> DataFrame:
    faces = F.array(*[F.struct(*[(4 * F.col("point_id") + v).alias(f"v{i}") for i, v in enumerate(face)]) for face in FACES])
    rows = points.select("cloud_id", "point_id", F.posexplode(faces).alias("side", "face"))
    return rows.select(F.col("cloud_id").alias("mesh_id"), (4 * F.col("point_id") + F.col("side")).alias("face_id"), "face.*")


def validity(clouds: DataFrame, points: DataFrame, faces: DataFrame) -> DataFrame:
    """(cloud_id, n_points, n_faces, valid_points, valid_surface) for each cloud of ``clouds``."""
    n_points = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_points"))
    n_faces = faces.groupBy(F.col("mesh_id").alias("cloud_id")).agg(F.count(F.lit(1)).alias("n_faces"))
    rows = clouds.select("cloud_id").join(n_points, "cloud_id", "left").join(n_faces, "cloud_id", "left").fillna(0, ["n_points", "n_faces"])
    return rows.withColumns({"valid_points": F.col("n_points") > 0, "valid_surface": (F.col("n_points") > 0) & (F.col("n_faces") > 0)})
