"""Writers of point tables as PLY and CSV text.

Each cloud becomes a folder ``cloud_id=<id>`` whose part files, one after the other by name, are the file: rows are
range-partitioned by cloud and place, so that a large cloud is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators.fields import glyph_faces, glyph_vertices


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("cloud_id", "at").sortWithinPartitions("cloud_id", "at").select("cloud_id", "line").write.partitionBy("cloud_id").text(path)


def _body(points: DataFrame, columns: list[str], between: str, order: str = "point_id") -> DataFrame:
    return points.select("cloud_id", F.col(order).cast("long").alias("at"), F.concat_ws(between, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]).alias("line"))


def write_ply(points: DataFrame, columns: dict[str, str], path: str) -> None:
    """ASCII PLY of each cloud; ``columns`` gives names and PLY types in order. Point ids are at least 0; null: nan."""
    names = "\n".join(f"property {kind} {name}" for name, kind in columns.items())
    n = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    head = n.select("cloud_id", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n"), F.lit(f"\n{names}\nend_header")).alias("line"))
    _write_lines(head.union(_body(points, list(columns), " ")), path)


def write_coloured_ply(points: DataFrame, path: str) -> None:
    """Places and colours: x, y, z, red, green, blue."""
    write_ply(points, {**dict.fromkeys("xyz", "float"), **dict.fromkeys(("red", "green", "blue"), "uchar")}, path)


def write_vector_ply(points: DataFrame, vectors: DataFrame, path: str) -> None:
    """Places and vectors (vx, vy, vz), named nx, ny, nz in the file."""
    named = vectors.select("cloud_id", "point_id", *[F.col(f"v{c}").alias(f"n{c}") for c in "xyz"])
    write_ply(points.join(named, ["cloud_id", "point_id"]), dict.fromkeys(("x", "y", "z", "nx", "ny", "nz"), "float"), path)


def write_csv(rows: DataFrame, order: str, columns: list[str], path: str) -> None:
    """Comma-separated ``columns`` of each cloud in ``order`` (numbers of at least 0), under a header; null: nan."""
    head = rows.select("cloud_id").distinct().select("cloud_id", F.lit(-1).cast("long").alias("at"), F.lit(",".join(columns)).alias("line"))
    _write_lines(head.union(_body(rows, columns, ",", order)), path)


def write_points_csv(points: DataFrame, columns: list[str], path: str) -> None:
    """Columns of points in order of their ids."""
    write_csv(points, "point_id", columns, path)


def write_spectrum_csv(spectra: DataFrame, path: str) -> None:
    """mode, lambda."""
    write_csv(spectra, "mode", ["mode", "lambda"], path)


def write_coefficients_csv(forms: list[DataFrame], path: str) -> None:
    """coeff_index, form0, form1, ...: coefficients (cloud_id, coefficients) side by side; a shorter one ends in nan."""
    rows = None
    for i, form in enumerate(forms):
        long = form.select("cloud_id", F.posexplode("coefficients").alias("coeff_index", f"form{i}"))
        rows = long if rows is None else rows.join(long, ["cloud_id", "coeff_index"], "full")
    write_csv(rows, "coeff_index", ["coeff_index", *[f"form{i}" for i in range(len(forms))]], path)


def write_ambient_csv(points: DataFrame, fields: list[DataFrame], path: str) -> None:
    """x, y, z, form0_x, form0_y, form0_z, ...: places with vector fields (vx, vy, vz)."""
    names = []
    for i, field in enumerate(fields):
        names += [f"form{i}_{c}" for c in "xyz"]
        points = points.join(field.select("cloud_id", "point_id", *[v.alias(f"form{i}_{c}") for v, c in zip(vec.vec("v"), "xyz", strict=True)]), ["cloud_id", "point_id"])
    write_csv(points, "point_id", ["x", "y", "z", *names], path)


def write_circular_csv(points: DataFrame, angles: list[DataFrame], path: str) -> None:
    """x, y, z, theta_0, theta_1, ...: places with angles (value)."""
    for i, angle in enumerate(angles):
        points = points.join(angle.select("cloud_id", "point_id", F.col("value").alias(f"theta_{i}")), ["cloud_id", "point_id"])
    write_csv(points, "point_id", ["x", "y", "z", *[f"theta_{i}" for i in range(len(angles))]], path)


def write_modes_csv(modes: DataFrame, path: str) -> None:
    """name, mode, lambda, eigenvalue_real, eigenvalue_imag of circular modes (cloud_id, name, mode, lambda, re, im) by mode."""
    rows = modes.select("cloud_id", "name", "mode", "lambda", F.col("re").alias("eigenvalue_real"), F.col("im").alias("eigenvalue_imag"))
    write_csv(rows, "mode", ["name", "mode", "lambda", "eigenvalue_real", "eigenvalue_imag"], path)


def write_heat_obj(points: DataFrame, faces: DataFrame | None, path: str) -> None:
    """OBJ of coloured points (red, green, blue bytes) and their faces, or without faces ``p`` lines of 1,000 points.

    Where the number of points is a multiple of 1,000 a bare ``p`` line ends the file.
    """
    at = lambda section, place: F.struct(F.lit(section).alias("section"), place.cast("long").alias("place")).alias("at")
    numbers = [F.col(c).cast("string") for c in "xyz"] + [(F.col(c) / 255).cast("string") for c in ("red", "green", "blue")]
    lines = points.select("cloud_id", at(0, F.col("point_id")), F.concat_ws(" ", F.lit("v"), *numbers).alias("line"))
    if faces is not None:
        corners = [(F.col(f"v{i}") + 1).cast("string") for i in range(3)]
        more = faces.select(F.col("mesh_id").alias("cloud_id"), at(1, F.col("face_id")), F.concat_ws(" ", F.lit("f"), *corners).alias("line"))
    else:
        rows = points.select("cloud_id", F.floor(F.col("point_id") / 1000).alias("part"), (F.col("point_id") + 1).alias("number"))
        rows = rows.groupBy("cloud_id", "part").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
        last = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 1000 = 0")
        rows = rows.union(last.select("cloud_id", (F.col("n") / 1000).cast("long"), F.array().cast("array<long>")))
        more = rows.select("cloud_id", at(1, F.col("part")), F.concat_ws(" ", F.lit("p"), F.col("numbers").cast("array<string>")).alias("line"))
    _write_lines(lines.union(more), path)


def write_solid_ply(points: DataFrame, path: str, radius: float = 0.01) -> None:
    """ASCII PLY in which each coloured point is a tetrahedron of four vertices and four faces."""
    at = lambda section, place: F.struct(F.lit(section).alias("section"), place.cast("long").alias("place")).alias("at")
    colours = points.select("cloud_id", "point_id", "red", "green", "blue")
    corners = glyph_vertices(points, radius).withColumn("point_id", F.expr("vertex_id div 4")).join(colours, ["cloud_id", "point_id"])
    shown = corners.select("cloud_id", at(1, F.col("vertex_id")), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "z", "red", "green", "blue")]).alias("line"))
    sides = glyph_faces(points).select(F.col("mesh_id").alias("cloud_id"), at(2, F.col("face_id")), F.concat_ws(" ", F.lit("3"), *[F.col(f"v{i}").cast("string") for i in range(3)]).alias("line"))
    names = "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    n = points.groupBy("cloud_id").agg((4 * F.count(F.lit(1))).alias("n"))
    text = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n"), F.lit(f"\n{names}element face "), F.col("n"), F.lit("\nproperty list uchar int vertex_index\nend_header"))
    _write_lines(n.select("cloud_id", at(0, F.lit(0)), text.alias("line")).union(shown).union(sides), path)
