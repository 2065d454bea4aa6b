"""Steps by blocks: answers, plans in which edges stay, runs that are resumed, form matrices without stored covariances."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoflow.operators import blocks, diffusion, fields, forms, knn, markov, mesh, products
from geoflow.sources.samples import grid_faces, torus

KEEP = lambda moved, v, prev, extra: (moved, v, extra)


@pytest.fixture(scope="module")
def chain(spark):
    rng, n = np.random.default_rng(0), 300
    rows = [(c, i, int(j), float(rng.random()) / 8) for c in (0, 5) for i in range(n) for j in np.unique(rng.integers(max(0, i - 60), min(n, i + 60), 7)) if i % 50]
    w = np.zeros((2, n, n))
    for c, i, j, x in rows:
        w[c // 5, i, j] = x
    order = spark.range(n).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("cloud_id"), F.col("id").alias("point_id"), F.col("id").alias("at"))
    return w, blocks.layout(spark.createDataFrame(rows, "cloud_id long, src long, dst long, w double"), order, 64)


def begun(spark, plan, v):
    rows = [(5 * c, i, x.tolist()) for c in range(2) for i, x in enumerate(v[c]) if i != 7]
    return blocks.start(plan, spark.createDataFrame(rows, "cloud_id long, point_id long, v array<double>"))


def test_steps_equal_matrix_powers(spark, chain):
    w, plan = chain
    v = np.random.default_rng(1).random((2, 300, 2))
    v[:, 7] = 0  # a point without a value
    for k in (0, 1, 4):
        found = blocks.unpacked(plan, blocks.walk(plan, begun(spark, plan, v), [KEEP] * k)).collect()
        assert len(found) == 600
        for r in found:
            assert np.allclose(r.v, (np.linalg.matrix_power(w[r.cloud_id // 5], k) @ v[r.cloud_id // 5])[r.point_id], atol=1e-12)


def test_edges_are_neither_exchanged_nor_sorted(spark, chain):
    """In the plan of three steps all that lies over a scan of the edges are filters, projections and the join."""
    _, plan = chain
    v = np.ones((2, 300, 1))
    lines = blocks.walk(plan, begun(spark, plan, v), [KEEP] * 3)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+-]*", line)[0])
    scans = [i for i, line in enumerate(lines) if "bucketed_" in line]
    assert len(scans) == 4 and not any("Sort" in line for line in lines)
    for i in scans:
        assert "Bucketed: true" in lines[i]
        above, at = [], depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert above and "ShuffledHashJoin" in above[-1] and not any("Exchange" in line for line in above)


def test_heat_run_is_resumed_from_its_last_whole_snapshot(spark, tmp_path):
    points = torus(spark, 200, seed=2)
    chain_, begin = markov.build(points, knn.knn(points, 12)).markov, fields.impulse(points)
    whole = {(r.step, r.point_id): r.value for r in diffusion.run(chain_, begin, 12, 5, points).collect()}
    assert {s for s, _ in whole} == {0, 5, 10, 12}
    plain = begin
    for _ in range(5):
        plain = diffusion.step(chain_, plain)
    assert all(abs(r.value - whole[5, r.point_id]) < 1e-9 for r in plain.collect())
    folder = str(tmp_path / "heat")
    assert {r.step for r in diffusion.run_to(folder, chain_, begin, 12, 5, points, stop_after=5).select("step").distinct().collect()} == {0, 5}
    # A snapshot that was begun but not finished is written again; a whole one is not.
    spark.createDataFrame([(0, 1, -1.0)], "cloud_id long, point_id long, value double").write.parquet(f"{folder}/step=10")
    found = {(r.step, r.point_id): r.value for r in diffusion.run_to(folder, chain_, begin.limit(0), 12, 5, points).collect()}
    assert found.keys() == whole.keys() and all(abs(found[k] - whole[k]) < 1e-9 for k in whole)


def test_flow_run_with_curvature_and_export_is_resumed(spark, tmp_path):
    side = 6
    points = spark.range(side * side).select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("point_id"), (F.col("id") % side).cast("double").alias("x"), F.expr(f"id div {side}").cast("double").alias("y"), F.sin("id").alias("z"))
    points = points.union(spark.createDataFrame([(0, 99, 9.0, 9.0, 9.0)], points.schema))  # a vertex without faces stays
    cells = spark.range((side - 1) ** 2).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("cell"))
    faces, folder = grid_faces(cells, side), str(tmp_path / "flow")
    assert mesh.flow_to(folder, points, faces, 3, stop_after=0).select("step").distinct().count() == 1
    found = {(r.step, r.point_id): r for r in mesh.flow_to(folder, points, faces, 3).collect()}
    assert len(found) == 3 * 37
    at = points
    for frame in range(3):
        bent = {r.point_id: r for r in mesh.curvature(at, faces).collect()}
        for r in at.collect():
            one = found[frame, r.point_id]
            assert np.allclose([one.x, one.y, one.z, one.h, one.k], [r.x, r.y, r.z, bent[r.point_id].h, bent[r.point_id].k], atol=1e-9)
        assert spark.read.text(f"{folder}/_obj/frame={frame}").filter("value like 'v %'").count() == 37
        at = mesh.flow_step(at, mesh.one_ring(at, faces))
    flowed = {r.point_id: (r.x, r.y, r.z) for r in mesh.flow(points, faces, 2).collect()}
    assert all(np.allclose(flowed[p], [found[2, p].x, found[2, p].y, found[2, p].z]) for p in flowed)


def test_assembled_matrices_equal_those_of_stored_covariances(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_POINTS", 64)
    monkeypatch.setattr(forms, "POINTS", 50)
    points = torus(spark, 250, seed=4)
    g = markov.build(points, knn.knn(points, 16))
    basis = points.select("cloud_id", "point_id", F.array(F.lit(1.0), "x", "y", "z", F.col("x") * F.col("y")).alias("phi"))
    gammas = forms.gamma_rows(g.markov, g.nodes, basis)
    made = forms.assembly(g.markov, g.nodes, basis)
    want = {(r.name, r.row, r.col): r.value for r in forms.form_matrices(gammas, 4).collect()}
    found = {(r.name, r.row, r.col): r.value for r in made.matrices(4).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    alpha = spark.createDataFrame([(0, np.random.default_rng(3).normal(size=15).tolist())], "cloud_id long, coefficients array<double>")
    one, two = products.circular_mode(gammas, alpha, 0.1).first(), products.circular_mode_of(made, alpha, 0.1).first()
    assert (one is None) == (two is None)
    if one:
        assert (one.re, one.im) == pytest.approx((two.re, two.im), rel=1e-6)
