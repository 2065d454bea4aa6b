"""Queries of readers and writers: tables are written as text to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import gapless_rank
from ..functions.tables import shared_folder
from ..operators import fields
from ..sources import samples, sinks, text
from . import views


#: Places of faces in an OBJ file begin here, after those of all vertices.
FACES_FROM = 1 << 62


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"


def written(rows: DataFrame, at: str, line: Column) -> str:
    """The folder to which ``line`` of each row was written in the order of the number ``at``. Text is made of rows in order: none is shuffled."""
    path = new_path(rows.sparkSession)
    rows.repartitionByRange(at).sortWithinPartitions(at).select(line.alias("line")).write.text(path)
    return path


def cloud(rows: DataFrame) -> DataFrame:
    """``file`` of a writer's folder turned into the cloud's id."""
    return rows.withColumn("cloud_id", F.regexp_extract("file", "cloud_id=([0-9]+)$", 1).cast("long")).drop("file")


def shown(df: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    return df.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) for c in df.columns if c not in keys])


def numbered(points: DataFrame) -> DataFrame:
    """Points of a cloud numbered from 0, as files know them; clouds here are those of a label."""
    ranked = gapless_rank(points, ["cloud_id"], [F.col("point_id")], "__nth")
    return ranked.select(*[F.col("__nth").alias(c) if c == "point_id" else F.col(c) for c in points.columns])


def obj_file(spark: SparkSession, sf_dir: str) -> str:
    """OBJ text of the orders' mesh with remarks, empty lines, a bad coordinate at some vertices, and bad faces."""
    points, faces = views.mesh_orders(spark, sf_dir)
    p, f = F.col("at"), F.col("at") - FACES_FROM
    y = F.when(p % 97 == 5, F.lit("none")).otherwise(F.col("y").cast("string"))
    vertex = F.concat_ws(" ", F.lit("v"), F.col("x").cast("string"), y, F.col("z").cast("string"))
    before = F.when(p % 100 == 0, F.lit("# vertices\n\nvn 0 0 1\n")).otherwise(F.lit(""))
    corner = [(F.col(f"v{i}") + 1).cast("string") for i in range(3)]
    face = F.concat_ws(" ", F.lit("f"), *[F.concat(c, F.lit("/1/"), c) for c in corner])
    face = F.when(f % 50 == 7, F.concat_ws(" ", F.lit("f"), *corner, corner[0])).when(f % 50 == 9, F.concat_ws(" ", F.lit("f"), corner[0], F.lit("x"), corner[2])).otherwise(face)
    rows = points.select(F.col("point_id").alias("at"), "x", "y", "z").unionByName(faces.select((F.col("face_id") + FACES_FROM).alias("at"), "v0", "v1", "v2"), allowMissingColumns=True)
    return written(rows, "at", F.when(p < FACES_FROM, F.concat(before, vertex)).otherwise(face))


def s1_obj_vertices(spark, sf_dir):
    return shown(text.read_obj_vertices(spark, obj_file(spark, sf_dir), parts=True).drop("file"), "point_id", digits=8)


def s2_obj_faces(spark, sf_dir):
    """Sound faces, and bad lines under number -1."""
    sound, bad = text.read_obj_faces(spark, obj_file(spark, sf_dir), parts=True)
    none = [F.lit(-1).cast("long").alias(f"v{i}") for i in range(3)]
    return sound.select("face_id", "v0", "v1", "v2", F.lit("").alias("line")).union(bad.select(F.lit(-1).cast("long"), *none, "line"))


def s3_points_csv(spark, sf_dir):
    """Points between headers, empty lines, words and further columns."""
    p = F.col("point_id")
    body = F.concat_ws(",", *[F.col(c).cast("string") for c in "xyz"])
    line = F.concat(F.when(p % 10 == 0, F.lit("x,y,z\n\nno,numbers,here\n1.5,2.5\n")).otherwise(F.lit("")), F.when(p % 3 == 0, F.concat(body, F.lit(",7.0,more"))).otherwise(F.regexp_replace(body, ",", " , ")))
    path = written(views.pts_embed(spark, sf_dir), "point_id", line)
    return shown(text.read_points_csv(spark, path, parts=True).drop("file"), "point_id", digits=8)


def s6_numeric_csv(spark, sf_dir):
    """How many cells of each column are no numbers, and the sum of the others."""
    rows = views.pts_label(spark, sf_dir).withColumn("y", F.when(F.col("point_id") % 5 == 0, F.lit("none")).otherwise(F.col("y").cast("string"))).withColumn("z", F.when(F.col("point_id") % 7 != 0, F.col("z").cast("string")))
    path = new_path(spark)
    rows.select("point_id", "x", "y", "z").write.option("header", True).csv(path)
    found = text.read_numeric_csv(spark, path)
    long = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("point_id", "x", "y", "z")])).alias("s")).select("s.*")
    return shown(long.groupBy("name").agg(F.count_if(F.isnan("v")).alias("missing"), F.sum(F.when(~F.isnan("v"), F.col("v"))).alias("total")), "name", "missing")


def sample_ids(spark, sf_dir):
    return views.mesh_orders(spark, sf_dir)[0].select("cloud_id", "point_id")


def s7_torus(spark, sf_dir):
    """Squared distance of each sampled point from the torus' core circle."""
    x, y, z = (F.col(c) for c in "xyz")
    around = F.sqrt(x * x + y * y)
    return samples.torus_at(sample_ids(spark, sf_dir)).select("point_id", (F.round((around - 2) ** 2 + z * z, 8) + 0.0).alias("square"))


def s8_sphere(spark, sf_dir):
    """Squared distance of each sampled point from the centre."""
    x, y, z = (F.col(c) for c in "xyz")
    return samples.sphere_at(sample_ids(spark, sf_dir), 1.5).select("point_id", (F.round(x * x + y * y + z * z, 8) + 0.0).alias("square"))


def spread(points: DataFrame) -> DataFrame:
    """For each octant whether it holds an eighth of the points, give or take five standard deviations."""
    octant = sum((F.when(F.col(c) > 0, 1 << i).otherwise(0) for i, c in enumerate("xyz")), F.lit(0)).cast("long")
    counts = points.groupBy(octant.alias("octant")).agg(F.count(F.lit(1)).alias("n"))
    share = F.sum("n").over(Window.partitionBy(F.lit(1))) / 8  # of eight rows
    return counts.select("octant", (F.abs(F.col("n") - share) <= 5 * F.sqrt(share)).alias("even"))


def s7_torus_spread(spark, sf_dir):
    return spread(samples.torus_at(sample_ids(spark, sf_dir)))


def s8_sphere_spread(spark, sf_dir):
    return spread(samples.sphere_at(sample_ids(spark, sf_dir), 1.5))


def angle(points: DataFrame, a: str, b: str) -> DataFrame:
    return points.select("cloud_id", "point_id", F.atan2(a, b).alias("value"))


def k1_csv_files(spark, sf_dir):
    """Places, two angles and two vector fields of each point, from a file of angles and one of fields."""
    points = numbered(views.pts_label(spark, sf_dir))
    turned = [points.select("cloud_id", "point_id", *[F.col(c).alias(f"v{d}") for c, d in zip(order, "xyz", strict=True)]) for order in ("yzx", "zxy")]
    one, two = new_path(spark), new_path(spark)
    sinks.write_circular_csv(points, [angle(points, "y", "x"), angle(points, "z", "y")], one)
    sinks.write_ambient_csv(points, turned, two)
    near, far = (csv_columns(spark, p) for p in (one, two))
    names = [f"form{i}_{c}" for i in range(2) for c in "xyz"]
    angles = near.select("cloud_id", "nth", *[F.get("cells", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "theta_0", "theta_1"))])
    rows = angles.join(far.select("cloud_id", "nth", *[F.get("cells", F.lit(3 + i)).cast("double").alias(c) for i, c in enumerate(names)]), ["cloud_id", "nth"])
    return shown(rows.withColumnRenamed("nth", "point_id"), "cloud_id", "point_id")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloud_id, mode, lambda, y): the points of a label in order of their ids as modes."""
    points = numbered(views.pts_label(spark, sf_dir))
    return points.select("cloud_id", F.col("point_id").cast("int").alias("mode"), (F.col("x") / 100).alias("lambda"), "y")


def k1_spectrum_csv(spark, sf_dir):
    path = new_path(spark)
    sinks.write_spectrum_csv(spectra(spark, sf_dir), path)
    cell = lambda i: F.get("cells", F.lit(i))
    return shown(csv_columns(spark, path).select("cloud_id", "nth", cell(0).cast("long").alias("mode"), cell(1).cast("double").alias("lambda")), "cloud_id", "nth", "mode", digits=7)


def k1_coefficients_csv(spark, sf_dir):
    """Two forms' coefficients side by side, of which the second has 20 at most: the rest is missing."""
    rows, path = spectra(spark, sf_dir), new_path(spark)
    column = lambda v, keep: rows.filter(keep).groupBy("cloud_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("mode", F.col(v).alias("v")))), lambda e: e["v"]).alias("coefficients"))
    sinks.write_coefficients_csv([column("lambda", F.lit(True)), column("y", F.col("mode") < 20)], path)
    cell = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit("nan"))
    found = csv_columns(spark, path).select("cloud_id", cell(0).cast("long").alias("coeff_index"), cell(1).cast("double").alias("form0"), cell(2).cast("double").alias("form1"))
    return shown(found, "cloud_id", "coeff_index", digits=7)


def k1_modes_csv(spark, sf_dir):
    rows, path = spectra(spark, sf_dir), new_path(spark)
    sinks.write_modes_csv(rows.select("cloud_id", F.concat(F.lit("theta_"), F.col("mode").cast("string")).alias("name"), "mode", "lambda", F.col("y").alias("re"), (F.col("lambda") * 2).alias("im")), path)
    cell = lambda i: F.get("cells", F.lit(i))
    numbers = [cell(i).cast("double").alias(c) for i, c in enumerate(("lambda", "eigenvalue_real", "eigenvalue_imag"), 2)]
    return shown(csv_columns(spark, path).select("cloud_id", cell(0).alias("name"), cell(1).cast("long").alias("mode"), *numbers), "cloud_id", "name", "mode", digits=7)


def csv_columns(spark: SparkSession, path: str) -> DataFrame:
    """(cloud_id, nth, cells) of a writer's CSV files: lines after the header, numbered from 0."""
    lines = text.with_ids(text.numbered_lines(spark, path), "nth", parts=True)
    return cloud(lines.filter("nth > 0").select("file", (F.col("nth") - 1).alias("nth"), F.split("line", ",").alias("cells")))


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fields.coloured(views.pts_label(spark, sf_dir), views.field_sparse(spark, sf_dir))
    return numbered(points.select("cloud_id", "point_id", "x", "y", "z", "red", "green", "blue"))


def k2_coloured_ply(spark, sf_dir):
    path = new_path(spark)
    sinks.write_coloured_ply(coloured(spark, sf_dir), path)
    return shown(cloud(text.read_ply(spark, path, ("x", "y", "z", "red", "green", "blue"), parts=True)), "cloud_id", "point_id")


def k3_heat_obj(spark, sf_dir):
    """Coloured vertices of clouds without faces."""
    path = new_path(spark)
    sinks.write_heat_obj(coloured(spark, sf_dir), None, path)
    return shown(cloud(text.read_obj_colours(spark, path, parts=True)), "cloud_id", "point_id")


def k3_heat_obj_faces(spark, sf_dir):
    """Faces of a coloured mesh."""
    points, faces = views.mesh_part(spark, sf_dir)
    heat = fields.coloured(points, fields.height(points))
    path = new_path(spark)
    sinks.write_heat_obj(heat, faces, path)
    return cloud(text.read_obj_faces(spark, path, parts=True)[0]).select("face_id", "v0", "v1", "v2")


def k4_solid_ply(spark, sf_dir):
    path = new_path(spark)
    sinks.write_solid_ply(coloured(spark, sf_dir), path)
    return shown(cloud(text.read_ply(spark, path, ("x", "y", "z", "red", "green", "blue"), parts=True)), "cloud_id", "point_id")


def k5_vector_ply(spark, sf_dir):
    points = numbered(views.pts_label(spark, sf_dir))
    path = new_path(spark)
    sinks.write_vector_ply(points, points.select("cloud_id", "point_id", F.col("y").alias("vx"), F.col("z").alias("vy"), F.col("x").alias("vz")), path)
    return shown(cloud(text.read_ply(spark, path, ("x", "y", "z", "nx", "ny", "nz"), parts=True)), "cloud_id", "point_id")


QUERIES = (
    s1_obj_vertices, s2_obj_faces, s3_points_csv, s6_numeric_csv, s7_torus, s8_sphere, k1_csv_files, k2_coloured_ply, k3_heat_obj, k3_heat_obj_faces,
    k4_solid_ply, k5_vector_ply, k1_spectrum_csv, k1_coefficients_csv, k1_modes_csv, s7_torus_spread, s8_sphere_spread,
)
