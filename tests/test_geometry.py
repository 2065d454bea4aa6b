import numpy as np
import pytest

from geoflow.functions.ranking import gapless_rank
from geoflow.functions.tables import short_methods
from geoflow.functions.vec import product_signs
from geoflow.jobs import queries
from geoflow.operators import diffusion, fields, knn, markov, mesh
from geoflow.sources.samples import sphere, torus
from geoflow.sources.text import read_obj, read_points_csv
from pyspark.sql import functions as F

POINTS = "cloud_id long, point_id long, x double, y double, z double"


def product(a, b, signature):
    out = np.zeros(len(a))
    for i, j, k, s in product_signs(signature):
        out[k] += s * a[i] * b[j]
    return out


@pytest.mark.parametrize("signature", [(3, 0, 0), (1, 3, 0), (3, 0, 1), (2, 0, 0)])
def test_geometric_product_is_associative(signature):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 1 << sum(signature)))
    assert np.allclose(product(product(a, b, signature), c, signature), product(a, product(b, c, signature), signature))


def test_square_mesh(spark):
    points = spark.createDataFrame([(0, i, float(i % 2), float(i // 2), 0.0) for i in range(4)], POINTS)
    faces = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3), (0, 2, 0, 2, 9)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    ring = {(r.src, r.dst) for r in mesh.one_ring(points, faces).collect()}
    assert {d for s, d in ring if s == 0} == {1, 2, 3}
    assert mesh.incidence(points, faces).filter("vertex_id = 0").count() == 3
    assert mesh.incidence(points, faces).filter("vertex_id = 9").count() == 0


def test_knn_and_graph_of_a_torus(spark):
    points = torus(spark, 300, seed=3)
    found = knn.knn(points, 8).toPandas().sort_values(["src", "rank"])
    at = points.toPandas().sort_values("point_id")[["x", "y", "z"]].to_numpy()
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    assert np.allclose(found["dist"].to_numpy().reshape(300, 8), np.sort(d, axis=1)[:, :8])
    graph = markov.build(points, knn.knn(points, 8))
    sums = graph.markov.groupBy("src").agg(F.sum("w").alias("s"), F.min("w").alias("least")).toPandas()
    assert np.allclose(sums["s"], 1) and (sums["least"] >= 0).all()
    assert graph.nodes.agg(F.sum("mu")).first()[0] == pytest.approx(1)
    heat = diffusion.run(graph.markov, fields.impulse(points), 5)
    assert heat.filter("step = 5").agg(F.max("value")).first()[0] <= 1000


def test_sphere_and_empty_cloud(spark):
    r = sphere(spark, 200, 2.0).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).toPandas()
    assert np.allclose(r, 2)
    empty = spark.createDataFrame([], POINTS)
    assert knn.knn(empty, 4).count() == 0 and fields.normalize(empty).count() == 0


def test_identical_points_have_exact_neighbours(spark):
    points = spark.createDataFrame([(0, i, 1.0, 1.0, 1.0) for i in range(6)], POINTS)
    found = knn.knn(points, 4).filter("src = 5").orderBy("rank").collect()
    assert [r.dst for r in found] == [0, 1, 2, 3] and {r.dist for r in found} == {0.0}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n\nbad,1,2\n4,5,6,7\n")
    rows = read_points_csv(spark, str(tmp_path / "a.csv")).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.z) for r in rows] == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
    (tmp_path / "a.obj").write_text("# c\nv 0 0 0\nv 1 x 2\nv 0 1 0\nf 1/1 2/2 3/3\nf 1 2 3 1\nf a b c\n")
    points, faces, bad = read_obj(spark, str(tmp_path / "a.obj"))
    assert points.count() == 3 and bad.count() == 2
    assert points.filter("point_id = 1").first()[2:] == (1.0, 0.0, 0.0)
    assert [tuple(r)[2:] for r in faces.collect()] == [(0, 1, 2)]


def test_gapless_rank_of_one_large_group(spark):
    rows = spark.range(1000).select(F.lit("a").alias("g"), "id")
    found = gapless_rank(rows, ["g"], [F.col("id").desc()], "n").toPandas()
    assert (found["n"] == 999 - found["id"]).all()


def test_no_table_of_vertices_or_faces_is_broadcast(spark, tmp_path):
    points = spark.createDataFrame([(0, i, float(i % 2), float(i // 2), 0.0) for i in range(4)], POINTS)
    faces = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    points.write.parquet(f"{tmp_path}/points")
    faces.write.parquet(f"{tmp_path}/faces")
    points, faces = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/faces")  # files are small enough to be broadcast
    ring = mesh.one_ring(points, faces)
    for made in (mesh.curvature(points, faces), mesh.incidence(points, faces), mesh.face_normals(points, faces), ring, mesh.flow_step(points, ring)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_products_run_in_methods_that_the_jvm_compiles(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    rows = queries.queries()["p9_geometric_product"](spark, "/root/testdata/sf0.001")
    made = rows._jdf.queryExecution().debug().codegenToSeq()
    assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) > 8000  # as one method it would stay interpreted
    assert int(spark.conf.get(name)) <= 8000
    spark.conf.set(name, "4000")
    short_methods(spark)
    assert spark.conf.get(name) == "4000"
    spark.conf.unset(name)


def test_steps_of_a_chain_make_no_symmetric_kernel(spark, monkeypatch):
    made = []
    for name in ("symmetric", "measure", "immersion"):
        monkeypatch.setattr(markov, name, lambda *a, f=getattr(markov, name), n=name: made.append(n) or f(*a))
    points = torus(spark, 60, seed=3)
    graph = markov.build(points, knn.knn(points, 8))
    assert diffusion.step(graph.markov, fields.height(points)).count() == 60 and not made
    assert graph.nodes.count() == 60 and graph.nodes is graph.nodes and sorted(made) == ["immersion", "measure", "symmetric"]


def test_offsets_in_ranges_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(mesh, "RANGE_VERTICES", 50)
    points = spark.range(500).select(F.lit(0).cast("long").alias("cloud_id"), (2 * F.col("id")).alias("point_id"))
    faces = spark.range(900).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("face_id"), F.col("id").alias("v0"), (F.col("id") + 1).alias("v1"), F.lit(7).cast("long").alias("v2"))
    for relation in (mesh.corners(faces), mesh.incidence(points, faces)):
        found = mesh.csr_offsets(relation, points, "vertex_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ", 10), REPARTITION_BY_NUM" in plan
        rows = sorted(tuple(r) for r in found.select("vertex_id", "degree", "first").collect())
        degree = [(1 if v == 0 or v == 900 else 2) if v <= 900 else 0 for v in range(0, 1000, 2)]
        assert rows == [(2 * i, d, sum(degree[:i])) for i, d in enumerate(degree)]
