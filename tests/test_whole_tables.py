"""Queries over whole tables against pandas, and the cases that filtered inputs used to exercise on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest

from geoflow.jobs import queries
from geoflow.operators import compare, mesh

SF = "/root/testdata/sf0.001"
POINTS, FACES = "cloud_id long, point_id long, x double, y double, z double", "mesh_id long, face_id long, v0 long, v1 long, v2 long"


@pytest.fixture(scope="module")
def vectors():
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    return pd.DataFrame({"label": rows["label"], "y": [float(v[1]) for v in rows["embedding"]], "value": [float(v[3]) for v in rows["embedding"]]})


def test_field_bounds_of_all_points(spark, vectors):
    found = {r.cloud_id: (r.lo, r.hi) for r in queries.queries()["p3_field_bounds"](spark, SF).collect()}
    assert set(found) == set(vectors["label"])
    for label, v in vectors.groupby("label")["value"]:
        assert np.allclose(found[label], (v.mean() - 2 * v.std(ddof=0), v.mean() + 2 * v.std(ddof=0)), atol=1e-5)


def test_incidence_of_all_vertices(spark):
    side = math.isqrt(len(pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"])))
    want = {}
    for row in range(side - 1):
        for col in range(side - 1):
            i, cell = row * side + col, row * (side - 1) + col
            for face, corners in ((2 * cell, (i, i + 1, i + side)), (2 * cell + 1, (i + 1, i + side + 1, i + side))):
                for v in corners:
                    want.setdefault(v, []).append(face)
    found = {r.vertex_id: r.faces for r in queries.queries()["m1_incidence"](spark, SF).collect()}
    assert len(want) == side * side and found == {v: ",".join(map(str, sorted(f))) for v, f in want.items()}


def test_agreement_of_all_points(spark, vectors):
    found = {r.cloud_id: r for r in queries.queries()["q1_point_agreement"](spark, SF).collect()}
    for label, y in vectors.groupby("label")["y"]:
        r = found[label]
        assert (r.n, r.unmatched) == (len(y), 0) and np.allclose((r.rmse, r.most), (np.sqrt((y**2).mean() / 300), y.abs().max() / 10), atol=1e-5)


def test_corner_out_of_range_and_unmatched_points(spark):
    points = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(3)], POINTS)
    faces = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 1, 2, 7)], FACES)
    assert sorted((r.vertex_id, r.face_id) for r in mesh.incidence(points, faces).collect()) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)]
    other = spark.createDataFrame([(0, i, float(i) + 1, 0.0, 0.0) for i in (1, 2, 3)], POINTS)
    r = compare.point_agreement(points, other).first()
    assert (r.n, r.unmatched, r.most) == (2, 2, 1.0)
