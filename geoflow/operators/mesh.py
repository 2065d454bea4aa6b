"""Mesh relations, curvature and smoothing flow. Vertices: (cloud_id, point_id, x, y, z); faces: (mesh_id, face_id, v0, v1, v2)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from ..functions.ranking import gapless_rank
from ..functions.tables import dealt, partitions, pin, stored
from ..sources.sinks import write_heat_obj
from . import blocks, fields, runs

#: Vertices of one range of ids.
RANGE_VERTICES = 250_000


def vertices_of(points: DataFrame) -> DataFrame:
    return points.select(F.col("cloud_id").alias("mesh_id"), F.col("point_id").alias("vertex_id"))


def incidence(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, face_id, corner); corners that are no vertex are left out."""
    return corners(faces).join(dealt(vertices_of(points)), ["mesh_id", "vertex_id"], "left_semi").select("mesh_id", "vertex_id", "face_id", "corner")


def corners(faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, face_id, corner) of all faces, whether the corner is a vertex or not."""
    return faces.select("mesh_id", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex_id")).select("mesh_id", "vertex_id", "face_id", "corner")


def one_ring(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, src, dst): distinct other corners of a vertex's faces."""
    sides = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("v0", "v1"), ("v1", "v0"), ("v0", "v2"), ("v2", "v0"), ("v1", "v2"), ("v2", "v1"))]
    rows = faces.select("mesh_id", F.explode(F.array(*sides)).alias("s")).select("mesh_id", "s.*").filter("src <> dst").distinct()
    known = vertices_of(points)
    for end in ("src", "dst"):
        rows = rows.join(dealt(known.withColumnRenamed("vertex_id", end)), ["mesh_id", end], "left_semi")
    return rows.select("mesh_id", "src", "dst")


def csr_offsets(relation: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(mesh_id, vertex_id, degree, first): entries of each vertex, and of all vertices before it; entries of no vertex are left out.

    Vertices are counted by one aggregation and dealt into ranges of ids whose totals are summed first, so that one huge mesh is no single task.
    There are as many ranges as keep ``RANGE_VERTICES`` in each: Spark sizes tasks by packed bytes, and ids in order take next to none.
    """
    known = vertices_of(points)
    ranges = max(partitions(points.sparkSession), math.ceil(known.count() / RANGE_VERTICES))
    one = lambda rows, **n: rows.select("mesh_id", "vertex_id", *[F.lit(v).cast("long").alias(c) for c, v in n.items()])
    rows = one(known, vertex=1, entry=0).union(one(relation.select("mesh_id", F.col(key).alias("vertex_id")), vertex=0, entry=1))
    rows = rows.groupBy("mesh_id", "vertex_id").agg(F.sum("vertex").alias("n"), F.sum("entry").alias("entries")).filter("n > 0")
    rows = rows.select("mesh_id", "vertex_id", (F.col("n") * F.col("entries")).alias("degree"))  # as a join of both would count
    rows = pin(rows.repartitionByRange(ranges, "mesh_id", "vertex_id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("mesh_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("mesh_id", "part").agg(F.sum("degree").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    here = Window.partitionBy("mesh_id", "part").orderBy("vertex_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition(ranges, "mesh_id", "part").withColumn("inside", F.coalesce(F.sum("degree").over(here), F.lit(0)))
    return rows.join(totals, ["mesh_id", "part"]).select("mesh_id", "vertex_id", "degree", (F.col("earlier") + F.col("inside")).alias("first"))


def with_corners(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the places of their corners as structs p0, p1, p2: one join on the vertex, then one group by face."""
    rows = faces.select("mesh_id", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "point_id"))
    places = points.select(F.col("cloud_id").alias("mesh_id"), "point_id", F.struct("x", "y", "z").alias("p"))
    at = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{n}{k}") for k in range(3) for n, c in (("v", "point_id"), ("p", "p"))]
    return rows.join(dealt(places), ["mesh_id", "point_id"]).groupBy("mesh_id", "face_id").agg(*at).filter("p0 is not null and p1 is not null and p2 is not null")


def _at(k: int) -> vec.Vec:
    return vec.vec(f"p{k}.")


def face_normals(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, xy, yz, zx): the bivector spanned by two sides; its norm is twice the area."""
    b = vec.wedge(vec.sub(_at(1), _at(0)), vec.sub(_at(2), _at(0)))
    return with_corners(points, faces).select("mesh_id", "face_id", *[c.alias(n) for c, n in zip(b, ("xy", "yz", "zx"), strict=True)])


def curvature(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, point_id, h, k): mean and Gaussian curvature of each vertex; 0 without faces.

    k is 2 pi less the corner angles, over a third of the area around; h is the part along the unit normal of
    the way to the mean of the neighbours' corners.
    """
    rows = with_corners(points, faces)
    corners = F.array(*[F.struct(F.col(f"v{i}").alias("v"), *[F.col(f"p{j}").alias(n) for j, n in ((i, "p"), ((i + 1) % 3, "a"), ((i + 2) % 3, "b"))]) for i in range(3)])
    rows = rows.select("mesh_id", F.explode(corners).alias("c")).select("mesh_id", F.col("c.v").alias("point_id"), "c.p", "c.a", "c.b")
    u, w = vec.sub(vec.vec("a."), vec.vec("p.")), vec.sub(vec.vec("b."), vec.vec("p."))
    area = vec.norm(vec.wedge(u, w))
    normal = vec.wedge(u, w)
    sums = rows.groupBy("mesh_id", "point_id").agg(
        F.sum(F.atan2(area, vec.dot(u, w))).alias("angles"), F.sum(area / 6).alias("area"), F.count(F.lit(1)).alias("n"), F.first("p").alias("p"),
        *[F.sum(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(f"s{c}") for c in "xyz"], *[F.sum(c).alias(f"n{n}") for c, n in zip((normal[1], normal[2], normal[0]), "xyz", strict=True)],
    )
    n = vec.vec("n")
    length2 = vec.dot(n, n)
    way = tuple(F.col(f"s{c}") / (2 * F.col("n")) - F.col(f"p.{c}") for c in "xyz")
    h = F.when(length2 > 1e-12, vec.dot(way, n) / F.sqrt(length2)).otherwise(0.0)
    k = F.when(F.col("area") > 1e-12, (2 * math.pi - F.col("angles")) / F.col("area")).otherwise(0.0)
    found = sums.select("mesh_id", "point_id", h.alias("h"), k.alias("k"))
    return vertices_of(points).toDF("mesh_id", "point_id").join(dealt(found), ["mesh_id", "point_id"], "left").fillna(0.0, ["h", "k"])


def flow_step(points: DataFrame, ring: DataFrame, dt: float = 0.5) -> DataFrame:
    """Moves each vertex by ``dt`` of the way to the mean of its ring; those without a ring stay."""
    ends = points.select(F.col("cloud_id").alias("mesh_id"), F.col("point_id").alias("dst"), "x", "y", "z")
    means = ring.join(dealt(ends), ["mesh_id", "dst"]).groupBy(F.col("mesh_id").alias("cloud_id"), F.col("src").alias("point_id")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    rows = points.join(dealt(means), ["cloud_id", "point_id"], "left")
    return rows.select("cloud_id", "point_id", *[F.coalesce(F.col(c) + dt * (F.col(f"m{c}") - F.col(c)), F.col(c)).alias(c) for c in "xyz"])


def _laid_out(points: DataFrame, faces: DataFrame) -> blocks.Blocks:
    """The means over rings as an operator by blocks; a vertex without a ring is its own mean."""
    ring = stored(one_ring(points, faces).select(F.col("mesh_id").alias("cloud_id"), "src", "dst"))
    degree = ring.groupBy("cloud_id", "src").agg((1 / F.count(F.lit(1))).alias("w"))
    alone = points.select("cloud_id", F.col("point_id").alias("src")).join(dealt(degree), ["cloud_id", "src"], "left_anti")
    edges = ring.join(dealt(degree), ["cloud_id", "src"]).union(alone.select("cloud_id", "src", F.col("src").alias("dst"), F.lit(1.0)).toDF("cloud_id", "src", "dst", "w"))
    return blocks.layout(edges, blocks.along_curve(points))


def _toward(dt: float) -> blocks.Combine:
    def combine(moved: np.ndarray, v: np.ndarray, prev: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        return v + dt * (moved - v), v, extra

    return combine


def _begun(plan: blocks.Blocks, points: DataFrame) -> DataFrame:
    return blocks.start(plan, points.select("cloud_id", "point_id", F.array("x", "y", "z").alias("v")))


def _places(plan: blocks.Blocks, state: DataFrame) -> DataFrame:
    return blocks.unpacked(plan, state).select("cloud_id", "point_id", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def flow(points: DataFrame, faces: DataFrame, frames: int, dt: float = 0.5) -> DataFrame:
    """``frames`` steps in one plan; the rings are packed into blocks once and stay there."""
    if frames <= 0:
        return points.select("cloud_id", "point_id", "x", "y", "z")
    plan = _laid_out(points, faces)
    found = stored(_places(plan, blocks.walk(plan, _begun(plan, points), [_toward(dt)] * frames)))
    plan.drop()
    return found


def flow_to(folder: str, points: DataFrame, faces: DataFrame, frames: int, dt: float = 0.5, export: bool = True, stop_after: int | None = None) -> DataFrame:
    """(cloud_id, point_id, x, y, z, h, k, step) of all frames: curvature at each frame, then one step of the flow.

    Frame f is a partition of ``folder``, and, with ``export``, a coloured OBJ of the mean curvature in ``folder``/_obj/frame=<f>.
    A run that was broken off goes on from its last whole frame. ``stop_after`` ends a run early, after that frame.
    """
    spark, wanted = points.sparkSession, list(range(frames))
    done, plan = runs.finished(spark, folder, wanted), None
    for frame in wanted:
        if frame in done or stop_after is not None and frame > stop_after:
            continue
        at = points.select("cloud_id", "point_id", "x", "y", "z")
        if frame:
            plan = plan or _laid_out(points, faces)
            at = stored(_places(plan, blocks.walk(plan, _begun(plan, runs.snapshot(spark, folder, frame - 1)), [_toward(dt)])))
        bent = stored(at.join(dealt(curvature(at, faces).withColumnRenamed("mesh_id", "cloud_id")), ["cloud_id", "point_id"]))
        if export:
            coloured = fields.coloured(at, bent.select("cloud_id", "point_id", F.col("h").alias("value")))
            write_heat_obj(coloured, faces, f"{folder}/_obj/frame={frame}")
        runs.finish(bent, folder, frame)
    if plan:
        plan.drop()
    return runs.snapshots(spark, folder, wanted)


def dense_vertex_ids(rows: DataFrame, mesh: str, order: str) -> DataFrame:
    """Vertex ids 0, 1, ... in each mesh along ``order``."""
    return gapless_rank(rows, [mesh], [F.col(order)], "vertex_id")
