import glob

import numpy as np
from pyspark.sql import functions as F

from geoflow.operators import compare, hodge
from geoflow.operators.forms import MATRIX
from geoflow.sources.sinks import write_points_csv, write_vector_ply
from geoflow.sources.text import read_points_csv


def table(spark, **named):
    rows = [(7, name, i, j, float(m[i, j])) for name, m in named.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, MATRIX)


def dense(df):
    rows = df.collect()
    out = np.zeros((max(r.row for r in rows) + 1, max(r.col for r in rows) + 1))
    for r in rows:
        out[r.row, r.col] = r.value
    return out


def test_laplacians_and_spectrum(spark):
    rng = np.random.default_rng(2)
    d, e, half = rng.normal(size=(6, 2)), rng.normal(size=(6, 6)), rng.normal(size=(6, 6))
    e, mass, g0 = e @ e.T, half @ half.T + np.eye(6), np.diag([2.0, 0.0])
    found = table(spark, d0=d, e1=e, g0=g0, g1=mass)
    assert np.allclose(dense(hodge.hodge_laplacian(found)), d @ d.T + e)
    assert np.allclose(dense(hodge.codifferential(found, 1)), np.diag([0.5, 0.0]) @ d.T)
    assert np.allclose(dense(hodge.down_laplacian(found, 1)), d @ np.diag([0.5, 0.0]) @ d.T)
    assert not dense(hodge.down_laplacian(found, 0)).any() and hodge.codifferential(found, 0).count() == 0
    spectra = hodge.spectrum(found.filter("name = 'e1'"), found.filter("name = 'g1'"))
    got = spectra.orderBy("mode").collect()
    for r in got:
        v = np.array(r.coefficients)
        assert np.allclose(e @ v, r["lambda"] * mass @ v)
    assert [r["lambda"] for r in got] == sorted(r["lambda"] for r in got) and len(got) == 6
    assert compare.spectrum_error(spectra, spectra).first().error == 0
    assert hodge.spectrum(found.filter("name = 'none'"), found.filter("name = 'g1'")).count() == 0


def test_harmonic_modes_fall_back_to_the_first(spark):
    rows = [(0, 0, 1e-5), (0, 1, 0.5), (0, 2, -1e-4), (1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.3), (1, 3, 0.4)]
    got = hodge.harmonic_modes(spark.createDataFrame(rows, "cloud_id long, mode int, lambda double")).collect()
    assert {(r.cloud_id, r.mode) for r in got} == {(0, 0), (0, 2), (1, 0), (1, 1), (1, 2)}


def test_forms_at_points(spark):
    basis = spark.createDataFrame([(0, 5, [1.0, 2.0])], "cloud_id long, point_id long, phi array<double>")
    coefficients = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 10.0, 20.0, 30.0])], "cloud_id long, coefficients array<double>")
    form = hodge.pointwise(basis, coefficients, 3)
    assert form.first().form == [21.0, 42.0, 63.0]
    assert hodge.pointwise(basis, coefficients, 1).count() == 0
    assert hodge.dual_vectors(form).first()[2:] == (63.0, -42.0, 21.0)
    g = np.arange(9.0).reshape(3, 3)
    names = [f"g_{a}_i{b}" for a in "xyz" for b in "xyz"]
    gammas = spark.createDataFrame([(0, 5, *g.ravel().tolist())], "cloud_id long, point_id long, " + ", ".join(f"{n} double" for n in names))
    assert np.allclose(hodge.ambient_vectors(form, gammas).first()[2:], g @ [21, 42, 63])
    w = np.array([[0, 21, 42], [-21, 0, 63], [-42, -63, 0]])
    a = g @ w @ g.T
    assert np.allclose(hodge.ambient_duals(form, gammas).first()[2:], (a[1, 2], -a[0, 2], a[0, 1]))
    points = spark.createDataFrame([(0, 5, -1.0, -1.0, -1.0)], "cloud_id long, point_id long, x double, y double, z double")
    assert hodge.facing_outward(hodge.ambient_vectors(form, gammas), points).first().vx < 0


def test_sinks_keep_the_order_of_points(spark, tmp_path):
    points = spark.range(500).select((F.col("id") % 2).alias("cloud_id"), (F.lit(500) - F.col("id")).alias("point_id"), *[(F.col("id") * 1.5).alias(c) for c in "xyz"])
    vectors = points.select("cloud_id", "point_id", *[F.col(c).alias(f"v{c}") for c in "xyz"])
    write_vector_ply(points, vectors, f"{tmp_path}/ply")
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/ply/cloud_id=0/part-*"))).splitlines()
    assert text[:3] == ["ply", "format ascii 1.0", "element vertex 250"] and text[9] == "end_header"
    assert [float(line.split()[0]) for line in text[10:]] == [1.5 * i for i in range(498, -1, -2)]
    write_points_csv(points, ["x", "y", "z"], f"{tmp_path}/csv")
    assert read_points_csv(spark, f"{tmp_path}/csv/cloud_id=1/part-*").count() == 250
