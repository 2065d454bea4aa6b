import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoflow.operators import compare, forms, hodge, knn, markov, products, spectral
from geoflow.sources.samples import torus
from geoflow.sources.sinks import write_heat_obj, write_solid_ply
from geoflow.sources.text import read_numeric_csv, read_obj_colours, read_ply

NODES = "cloud_id long, point_id long, row_sum double, mu double, ix double, iy double, iz double"
BASIS = "cloud_id long, point_id long, phi array<double>"
FORM = "cloud_id long, point_id long, form array<double>"
COEFFICIENTS = "cloud_id long, coefficients array<double>"


@pytest.fixture(scope="module")
def kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    s = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = [(3, i, j, float(s[i, j])) for i in range(60) for j in range(60)]
    total = s.sum(axis=1)
    nodes = [(3, i, float(t), float(t / total.sum()), *map(float, x[i])) for i, t in enumerate(total)]
    return s, total, spark.createDataFrame(rows, "cloud_id long, src long, dst long, s double"), spark.createDataFrame(nodes, NODES)


def test_eigenbasis_equals_a_dense_solver(spark, kernel):
    s, total, symk, nodes = kernel
    basis, values = spectral.eigenbasis(symk, nodes, 5, rounds=2)
    want = np.linalg.eigvalsh(s / np.sqrt(np.outer(total, total)))
    want = np.sort(want[np.argsort(-np.abs(want))[:5]])[::-1]
    got = [r["lambda"] for r in values.orderBy("mode").collect()]
    assert np.allclose(got, want, atol=1e-7)
    phi = np.array([r.phi for r in basis.orderBy("point_id").collect()])
    mu = total / total.sum()
    assert np.allclose(phi[:, 0], 1, atol=1e-6) and np.allclose(phi.T @ (phi * mu[:, None]), np.eye(5), atol=1e-6)
    assert np.allclose((s / total[:, None]) @ phi, phi * np.array(got), atol=1e-5)
    assert all(phi[np.argmax(np.abs(phi[:, i])), i] > 0 for i in range(5))
    assert spectral.eigenfunction(basis, 1).count() == 60 and spectral.eigenfunction(basis, 9).count() == 0


def test_eigenbasis_in_many_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK_POINTS", 64)
    points = torus(spark, 400, seed=3)
    g = markov.build(points, knn.knn(points, 24))
    basis, values = spectral.eigenbasis(g.symk, g.nodes, 8, degree=6)
    m = np.zeros((400, 400))
    for r in g.symk.collect():
        m[r.src, r.dst] = r.s
    total = m.sum(axis=1)
    want = np.linalg.eigvalsh(m / np.sqrt(np.outer(total, total)))
    want = np.sort(want[np.argsort(-np.abs(want))[:8]])[::-1]
    got = np.array([r["lambda"] for r in values.orderBy("mode").collect()])
    phi = np.array([r.phi for r in basis.orderBy("point_id").collect()])
    assert np.allclose(got, want, atol=1e-7) and np.allclose(phi.T @ (phi * (total / total.sum())[:, None]), np.eye(8), atol=1e-6)
    assert np.allclose((m / total[:, None]) @ phi, phi * got, atol=1e-5)


def test_eigenbasis_of_a_point_and_of_nothing(spark):
    symk = spark.createDataFrame([(0, 0, 0, 1.0)], "cloud_id long, src long, dst long, s double")
    nodes = spark.createDataFrame([(0, 0, 1.0, 1.0, 0.0, 0.0, 0.0)], NODES)
    assert spectral.eigenbasis(symk, nodes, 3, rounds=1)[0].first().phi == pytest.approx([1.0])
    assert spectral.eigenbasis(symk.limit(0), nodes.limit(0), 3, rounds=1)[0].count() == 0


def test_condition(spark):
    rows = [(0, "g1", i, j, [[4.0, 0.0], [0.0, 0.5]][i][j]) for i in range(2) for j in range(2)]
    assert spectral.condition(spark.createDataFrame(rows, forms.MATRIX)).first().condition == pytest.approx(8)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    u, mu = np.hstack([np.ones((40, 1)), rng.normal(size=(40, 3))]), rng.random(40)
    basis = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(u)], BASIS)
    nodes = spark.createDataFrame([(1, i, float(m)) for i, m in enumerate(mu)], "cloud_id long, point_id long, mu double")
    return rng, u, mu, basis, nodes


def test_projection_undoes_evaluation(spark, cloud):
    rng, u, mu, basis, nodes = cloud
    c = rng.normal(size=12)
    one = spark.createDataFrame([(1, c.tolist())], COEFFICIENTS)
    assert np.allclose(products.project(hodge.pointwise(basis, one, 3), basis, nodes).first().coefficients, c)


def test_wedge(spark, cloud):
    rng, u, mu, basis, nodes = cloud
    a, b, two = (rng.normal(size=12) for _ in range(3))
    df = {n: spark.createDataFrame([(1, v.tolist())], COEFFICIENTS) for n, v in (("a", a), ("b", b), ("two", two))}
    wedge = lambda x, k, y, m: np.array(products.wedge(df[x], k, df[y], m, basis, nodes).first().coefficients)
    ab = wedge("a", 1, "b", 1)
    p, q = u @ a.reshape(4, 3), u @ b.reshape(4, 3)
    at = np.stack([p[:, i] * q[:, j] - p[:, j] * q[:, i] for i, j in ((0, 1), (0, 2), (1, 2))], axis=1)
    w = np.sqrt(mu)[:, None]
    assert np.allclose(ab, np.linalg.lstsq(w * u, w * at)[0].ravel())
    assert np.allclose(ab, -wedge("b", 1, "a", 1)) and np.allclose(wedge("a", 1, "a", 1), 0)
    assert np.allclose(wedge("a", 1, "two", 2), wedge("two", 2, "a", 1))
    assert np.array_equal(wedge("two", 2, "two", 2), np.zeros(4))
    assert products.wedge(df["a"].limit(0), 1, df["b"], 1, basis, nodes).count() == 0
    m = np.zeros((12, 12))
    for r in products.wedge_operator(df["a"], 1, 1, basis, nodes).collect():
        m[r.row, r.col] = r.value
    assert np.allclose(m @ b, ab)
    assert products.padded(df["a"], 6).first().coefficients == a.tolist() + [0.0] * 6


def test_circular_coordinates(spark, cloud):
    rng, u, mu, _, _ = cloud
    half = rng.normal(size=(40, 7, 7))
    g = half @ half.transpose(0, 2, 1) / 50
    rows = [(1, i, float(mu[i]), u[i].tolist(), g[i].ravel().tolist()) for i in range(40)]
    gammas = spark.createDataFrame(rows, "cloud_id long, point_id long, mu double, phi array<double>, g array<double>")
    a = rng.normal(size=12) * 20
    modes = products.circular_mode(gammas, spark.createDataFrame([(1, a.tolist())], COEFFICIENTS), 0.5)
    q = u @ a.reshape(4, 3)
    x = np.einsum("p,pi,pat,pa->it", mu, u, g[:, :3, 3:], q)
    want = np.linalg.eigvals(np.linalg.solve((u * mu[:, None]).T @ u, x - 0.5 * np.einsum("p,pij->ij", mu, g[:, 3:, 3:])))
    want = sorted((v for v in want if v.imag > 1e-6), key=abs)
    got = modes.collect()
    assert len(got) == bool(want)
    if want:
        assert got[0].re + 1j * got[0].im == pytest.approx(want[0])
    angles = products.circular_coordinates(gammas.select("cloud_id", "point_id", "phi"), modes)
    assert angles.filter("value >= 0 and value < 2 * pi()").count() == 40
    assert products.circular_coordinates(gammas.select("cloud_id", "point_id", "phi"), modes.limit(0)).filter("value = 0").count() == 40


def test_bands_of_equal_eigenvalues():
    values = np.array([2 + 1j, 1j, -1j, 1 + 2j, 0.5])
    assert products.in_bands(values) == [4, 2, 1, 3, 0]


def test_up_energy_of_two_forms():
    rng = np.random.default_rng(3)
    half = rng.normal(size=(5, 5, 5))
    g = half @ half.transpose(0, 2, 1)
    g[0] = 0  # a singular point adds nothing
    mu = rng.random(5)
    out = forms._up_two(mu, g[:, :3, :3], g[:, :3, 3:], g[:, 3:, 3:])
    want = np.zeros_like(out)
    for p in range(1, 5):
        for j, r in enumerate(forms.PAIRS):
            for k, c in enumerate(forms.PAIRS):
                d = g[p][np.ix_(r, c)]
                for i in range(2):
                    for m in range(2):
                        whole = g[p][3 + i, 3 + m] - g[p][list(c), 3 + i] @ np.linalg.solve(d, g[p][list(r), 3 + m])
                        want[i, j, m, k] += mu[p] * np.linalg.det(d) * whole
    assert np.allclose(out, want)


def test_subspaces_and_scores(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 2))
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    table = lambda m: spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(m)], FORM)
    same = compare.subspace_agreement(table(a), table(a @ turn)).first()
    assert same.angle < 1e-3 and same.procrustes < 1e-6
    b = rng.normal(size=(30, 3))
    other = compare.subspace_agreement(table(a), table(b)).first()
    cosines = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    assert other.angle == pytest.approx(np.degrees(np.arccos(cosines)).max())
    assert compare.subspace_agreement(table(a), table(0 * a)).first().angle == 90
    metrics = spark.createDataFrame([(9.0, 0.1, 0.9, 0.0), (18.0, None, 0.8, 0.0)], "angle double, procrustes double, correlation double, p95 double")
    assert compare.composite_score(metrics, compare.ONE_FORM_SHARES).first().score == pytest.approx(0.35 * 0.2 + 0.35 + 0.15 * 0.2)


def test_readers(spark, tmp_path):
    header = "ply\nformat ascii 1.0\ncomment made here\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_index\nend_header\n"
    (tmp_path / "a.ply").write_text(header + "1 2 3 4\n5 6\n7 8 9 10\n3 0 1 2\n")
    got = read_ply(spark, f"{tmp_path}/a.ply", ("x", "z", "red", "nx")).orderBy("point_id").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1.0, 3.0, 4.0, None), (1, 7.0, 9.0, 10.0, None)]
    (tmp_path / "b.obj").write_text("v 1 2 3 255 0 51\nf 1 2 3\nv 4 5 6 0 255 0\n")
    (tmp_path / "c.obj").write_text("v 1 2 3 0.5 0 2\nv 4 5 6\n")
    got = read_obj_colours(spark, f"{tmp_path}/b.obj").orderBy("point_id").collect()
    assert [(r.red, r.green, r.blue) for r in got] == [(1.0, 0.0, 0.2), (0.0, 1.0, 0.0)]
    assert [r.red for r in read_obj_colours(spark, f"{tmp_path}/c.obj").collect()] == [None, None]
    (tmp_path / "d.csv").write_text("a,b\n1,x\n,2.5\n")
    got = read_numeric_csv(spark, f"{tmp_path}/d.csv").collect()
    assert got[0].a == 1 and np.isnan(got[0].b) and np.isnan(got[1].a) and got[1].b == 2.5


def test_writers(spark, tmp_path):
    points = spark.range(1000).select(F.lit(0).cast("long").alias("cloud_id"), F.col("id").alias("point_id"), *[F.col("id").cast("double").alias(c) for c in "xyz"], *[F.lit(51).alias(c) for c in ("red", "green", "blue")])
    faces = spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    lines = lambda name: "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{name}/cloud_id=0/part-*"))).splitlines()
    write_heat_obj(points, faces, f"{tmp_path}/faces")
    assert lines("faces")[1] == "v 1.0 1.0 1.0 0.2 0.2 0.2" and lines("faces")[-1] == "f 1 2 3"
    write_heat_obj(points, None, f"{tmp_path}/points")
    assert lines("points")[-1] == "p" and lines("points")[-2].split() == ["p", *map(str, range(1, 1001))] and len(lines("points")) == 1002
    write_solid_ply(points, f"{tmp_path}/solid")
    got = lines("solid")
    assert got[2] == "element vertex 4000" and "element face 4000" in got and len(got) == got.index("end_header") + 1 + 8000
    (tmp_path / "whole.ply").write_text("\n".join(got))
    assert read_ply(spark, f"{tmp_path}/whole.ply").count() == 4000


def test_neighbours_reach_python_as_flat_numbers(spark, monkeypatch):
    points = torus(spark, 200, seed=3)
    g = markov.build(points, knn.knn(points, 8))
    basis = points.select("cloud_id", "point_id", F.array(F.lit(1.0), "x").alias("phi"))
    made = forms.gamma_rows(g.markov, g.nodes, basis)
    plan = made._jdf.queryExecution().executedPlan().toString()
    call = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "around" not in call  # an array of structs becomes an object for each edge
    got = {r.point_id: np.array(r.g).reshape(5, 5) for r in made.collect()}
    f = {r.point_id: np.array([r.ix, r.iy, r.iz, *r.phi]) for r in g.nodes.join(basis, ["cloud_id", "point_id"]).collect()}
    bw = {r.point_id: r.bw for r in g.nodes.collect()}
    want = {i: [] for i in f}
    for r in g.markov.collect():
        want[r.src].append((r.w, f[r.dst] - f[r.src]))
    for i, near in want.items():
        w, d = np.array([x for x, _ in near]), np.stack([x for _, x in near])
        assert np.allclose(got[i], (d.T @ (d * w[:, None]) - np.outer(w @ d, w @ d)) / (2 * max(bw[i], 1e-8)), atol=1e-9)


def test_rounds_start_from_smooth_independent_vectors(spark):
    at = torus(spark, 500, seed=3).withColumns({f"i{c}": F.col(c) for c in "xyz"}).withColumn("row_sum", F.lit(1.0))
    rows = spectral.begun(at, 20).orderBy("point_id").collect()
    v = np.array([r.v for r in rows])
    place = np.array([tuple(r) for r in at.orderBy("point_id").select("x", "y", "z").collect()])
    d = ((place[:, None] - place[None]) ** 2).sum(axis=2) + 1e9 * np.eye(500)
    near = d.argmin(axis=1)
    assert np.allclose(v[:, 0], 1) and np.linalg.matrix_rank(v, tol=1e-4) == 20
    assert all(np.corrcoef(x, x[near])[0, 1] > 0.8 for x in v.T[1:])  # white noise: about 0


def test_one_round_from_combined_waves_is_nearer_than_from_waves(spark):
    points = torus(spark, 1500, small=0.8, seed=3)
    g = markov.build(points, knn.knn(points, 16))
    width = 24
    plan = spectral.packed.layout(spectral.normalized(g.symk, g.nodes), spectral.packed.along_curve(g.nodes, ("ix", "iy", "iz")), 512)
    places = spectral.packed.start(plan, spectral.placed(g.nodes))
    states = [spectral.packed.start(plan, spectral.begun(g.nodes, width)), spectral.combined(places, spectral.ritz_of_waves(plan, places, width), width)]
    plain, led = (spectral.krylov_round(plan, s, width, 16, 4)[1].first().residual for s in states)
    assert led < plain / 2 and led < 1e-2


def test_cycles_of_mixed_forms_and_slow_turns():
    """Functions cos u, sin u, cos v, sin v; the forms of both angles mixed, and a little of u's turn in what is left of it in v's form."""
    turn = lambda at, by: sum(by * s * np.outer(np.eye(4)[i], np.eye(4)[j]) for i, j, s in ((at, at + 1, 1), (at + 1, at, -1)))
    flows = np.stack([turn(0, 0.41), turn(2, 1.03) + turn(0, 0.02)])
    e, g = np.diag([0.27, 0.27, 1.13, 1.13]), np.eye(4)
    values = np.linalg.eigvals(flows[1] - e)
    first = min((x for x in values if x.imag > 1e-6), key=abs)
    assert first.imag == pytest.approx(0.02)  # the one that circular_mode takes for v's form goes round u
    for by in (0.0, 0.3, 0.8, 1.5):
        c, s = np.cos(by), np.sin(by)
        found = products.turned_to_cycles(np.einsum("ij,jkl->ikl", np.array([[c, s], [-s, c]]), flows), e, g)
        assert len(found) == 2 and abs(found[0][0] @ found[1][0]) < 1e-6
        for (_, value, z), at, most in zip(found, (0, 2), (0.41, 1.03), strict=True):
            assert abs(value.imag - most) < 0.01 and np.linalg.norm(z[at : at + 2]) > 0.999 * np.linalg.norm(z)
    assert products.turned_to_cycles(np.zeros((2, 4, 4)), e, g) == []
