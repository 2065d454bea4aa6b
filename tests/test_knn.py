import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geoflow.operators import knn


def brute(at: np.ndarray, k: int) -> np.ndarray:
    d = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def table(spark, *clouds: np.ndarray):
    rows = pd.concat([pd.DataFrame({"cloud_id": c, "point_id": range(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}) for c, at in enumerate(clouds)])
    return spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")


def test_crowds_outliers_and_copies_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "ASKING", 64)
    monkeypatch.setattr(knn, "LEAF_POINTS", 128)
    monkeypatch.setattr(knn, "COPIES", 100)
    rng = np.random.default_rng(5)
    crowd, far = rng.normal(size=(1500, 3)) * 1e-3, rng.uniform(-1, 1, size=(12, 3)) * 1000
    copies = np.repeat([[3.0, 4.0, 5.0], [-0.0, 0.0, 0.0]], (450, 5), axis=0)
    one = np.concatenate([crowd, far, copies])[rng.permutation(1967)]
    clouds = (one, np.zeros((7, 3)), rng.normal(size=(3, 3)) + 1e6)
    found = knn.knn(table(spark, *clouds), 8).toPandas().sort_values(["cloud_id", "src", "rank"])
    for cloud, at in enumerate(clouds):
        want = brute(at, min(8, len(at)))
        got = found[found.cloud_id == cloud]
        assert np.array_equal(got["dst"].to_numpy().reshape(want.shape), want) and np.array_equal(got["rank"], np.tile(np.arange(want.shape[1]), len(at)))
        assert np.allclose(got["dist"], np.linalg.norm(at[want.ravel()] - np.repeat(at, want.shape[1], axis=0), axis=1), atol=1e-9)


def test_a_cluster_below_any_grid_is_split_and_answered(spark):
    """20,000 points in a cluster of a hundred-millionth of the cloud's width, ten far outliers: exact, and no leaf over the bound."""
    rng = np.random.default_rng(6)
    far = rng.uniform(-1, 1, size=(10, 3)) * 1e3
    at = np.concatenate([rng.normal(size=(20_000, 3)) * 1e-5, far])
    points = table(spark, at)
    placed, cells = knn.split_tree(points.withColumn("nth", F.lit(0)), knn.LEAF_POINTS)
    sizes = placed.groupBy("cell").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= knn.LEAF_POINTS and sizes[1] == len(at)
    found = knn.knn(points, 8).filter("src % 97 = 0 or src >= 20000").toPandas().sort_values(["src", "rank"])
    asked = [i for i in range(len(at)) if i % 97 == 0 or i >= 20_000]
    d = ((at[asked][:, None] - at[None]) ** 2).sum(axis=2)
    assert np.array_equal(found["dst"].to_numpy().reshape(-1, 8), np.argsort(d, axis=1, kind="stable")[:, :8])


def test_best_breaks_ties_by_id():
    at = np.array([[0.0, 0, 0], [1, 0, 0], [-1, 0, 0], [0, 1, 0], [2, 0, 0]])
    (row, ids, d2), = knn.best(at[:1], at, np.array([3, 5, 7, 8, 9]), 3)
    assert row.tolist() == [0, 0, 0] and ids.tolist() == [3, 5, 7] and d2.tolist() == [0, 1, 1]
