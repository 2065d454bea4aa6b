"""Small dense steps on matrix tables (cloud_id, name, row, col, value), and forms evaluated at points.

A cloud's matrices have as many entries as the squared number of modes allows, whatever the number of points, so
that one task can hold those of one cloud. Whatever runs over points stays a DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .forms import MATRIX

#: Eigenvalues at most this share are not inverted; eigenvalues up to TOLERANCE count as 0.
RCOND, TOLERANCE, MODES = 1e-5, 1e-3, 3


def pseudo_inverse(m: np.ndarray, rcond: float = RCOND) -> np.ndarray:
    """Of a symmetric matrix: eigenvalues above max(rcond * largest magnitude, rcond) are inverted, others dropped."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    kept = values > max(rcond * np.abs(values).max(initial=0), rcond)
    return (vectors[:, kept] / values[kept]) @ vectors[:, kept].T


def dense(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    out = {}
    for name, part in rows.groupby("name"):
        m = np.zeros((part["row"].max() + 1, part["col"].max() + 1))
        m[part["row"], part["col"]] = part["value"]
        out[name] = m
    return out


def _per_cloud(matrices: DataFrame, names: list[str], made: str, step: Callable[..., np.ndarray]) -> DataFrame:
    """One matrix ``made`` from the ``names`` of each cloud that has them all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = dense(rows)
        m = step(*[found[n] for n in names]) if len(found) == len(set(names)) else np.zeros((0, 0))
        r, c = np.indices(m.shape)
        return pd.DataFrame({"cloud_id": rows["cloud_id"].iat[0], "name": made, "row": r.ravel(), "col": c.ravel(), "value": m.ravel()})

    return matrices.filter(F.col("name").isin(names)).select("cloud_id", "name", "row", "col", "value").groupBy("cloud_id").applyInPandas(run, MATRIX)


def codifferential(matrices: DataFrame, k: int) -> DataFrame:
    """Matrix ``c<k>`` of each cloud: pinv(g<k-1>) times the transpose of d<k-1>; none for k <= 0."""
    if k <= 0:
        return matrices.select("cloud_id", "name", "row", "col", "value").limit(0)
    return _per_cloud(matrices, [f"g{k - 1}", f"d{k - 1}"], f"c{k}", lambda g, d: pseudo_inverse(g) @ d.T)


def down_laplacian(matrices: DataFrame, k: int) -> DataFrame:
    """Matrix ``down<k>``: d<k-1> pinv(g<k-1>) d<k-1>'; all 0 for k <= 0."""
    if k <= 0:
        return _per_cloud(matrices, ["g0"], f"down{k}", np.zeros_like)
    return _per_cloud(matrices, [f"g{k - 1}", f"d{k - 1}"], f"down{k}", lambda g, d: d @ pseudo_inverse(g) @ d.T)


def added(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Sum of two matrix tables of one name each; entries that one lacks are 0 there."""
    both = a.select("cloud_id", "row", "col", "value").union(b.select("cloud_id", "row", "col", "value"))
    return both.groupBy("cloud_id", "row", "col").agg(F.sum("value").alias("value")).select("cloud_id", F.lit(name).alias("name"), "row", "col", "value")


def hodge_laplacian(matrices: DataFrame) -> DataFrame:
    """Matrix ``hodge1``: d0 d0' + e1, for a basis that is orthonormal in the points' measure."""
    d = matrices.filter("name = 'd0'").select("cloud_id", "row", "col", "value")
    other = d.select("cloud_id", F.col("row").alias("r2"), "col", F.col("value").alias("v2"))
    square = d.join(other, ["cloud_id", "col"]).groupBy("cloud_id", "row", "r2").agg(F.sum(F.col("value") * F.col("v2")).alias("value"))
    return added(square.withColumnRenamed("r2", "col"), matrices.filter("name = 'e1'"), "hodge1")


def _whitened(laplacian: np.ndarray, mass: np.ndarray, rcond: float) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((mass + mass.T) / 2)
    kept = values > rcond
    half = vectors[:, kept] / np.sqrt(values[kept])
    inner = half.T @ laplacian @ half
    lam, own = np.linalg.eigh((inner + inner.T) / 2)
    return lam, half @ own


def spectrum(laplacian: DataFrame, mass: DataFrame, rcond: float = RCOND) -> DataFrame:
    """(cloud_id, mode, lambda, coefficients): generalized eigenpairs, ascending; mass eigenvalues up to ``rcond`` are dropped."""
    both = laplacian.withColumn("name", F.lit("l")).union(mass.select(*laplacian.columns).withColumn("name", F.lit("m")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = dense(rows)
        if len(found) < 2 or found["l"].shape != found["m"].shape:
            return pd.DataFrame(columns=["cloud_id", "mode", "lambda", "coefficients"], dtype=object)
        lam, vectors = _whitened(found["l"], found["m"], rcond)
        return pd.DataFrame({"cloud_id": rows["cloud_id"].iat[0], "mode": np.arange(len(lam)), "lambda": lam, "coefficients": list(vectors.T)})

    return both.groupBy("cloud_id").applyInPandas(run, "cloud_id long, mode int, lambda double, coefficients array<double>")


def inner(mass: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(cloud_id, value): the product a' M b of two forms (cloud_id, coefficients)."""
    rows = mass.select("cloud_id", "row", "col", "value").join(a.select("cloud_id", F.col("coefficients").alias("a")), "cloud_id").join(b.select("cloud_id", F.col("coefficients").alias("b")), "cloud_id")
    return rows.groupBy("cloud_id").agg(F.sum(F.col("value") * F.get("a", F.col("row")) * F.get("b", F.col("col"))).alias("value"))


def residuals(laplacian: DataFrame, mass: DataFrame, spectra: DataFrame) -> DataFrame:
    """(cloud_id, mode, lambda, residual, norm_error): how far each pair is from L c = lambda M c, where M can be inverted, and c' M c from 1.

    The residual is taken in the space of c that ``spectrum`` searches, so that what M drops counts for nothing.
    """
    both = laplacian.withColumn("name", F.lit("l")).union(mass.select(*laplacian.columns).withColumn("name", F.lit("m")))

    def run(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        found = dense(rows) if len(rows) else {}
        pairs = pairs.sort_values("mode")
        if len(found) < 2 or not len(pairs):
            return pd.DataFrame(columns=["cloud_id", "mode", "lambda", "residual", "norm_error"], dtype=object)
        c, lam = np.stack(pairs["coefficients"].to_numpy()).T, pairs["lambda"].to_numpy()
        away = found["l"] @ c - found["m"] @ c * lam
        inside = c.T @ away  # c spans the space that is searched
        norm = np.einsum("ij,ij->j", c, found["m"] @ c)
        return pd.DataFrame({"cloud_id": pairs["cloud_id"], "mode": pairs["mode"], "lambda": lam, "residual": np.abs(inside).max(axis=0), "norm_error": np.abs(norm - 1)})

    kind = "cloud_id long, mode int, lambda double, residual double, norm_error double"
    return both.groupBy("cloud_id").cogroup(spectra.select(*[F.col(c).alias(c) for c in ("cloud_id", "mode", "lambda", "coefficients")]).groupBy("cloud_id")).applyInPandas(run, kind)


def harmonic_modes(spectra: DataFrame, tolerance: float = TOLERANCE, most: int = MODES) -> DataFrame:
    """The first ``most`` modes of each cloud with an eigenvalue of magnitude up to ``tolerance``; the first ones if none has."""
    near = (F.abs("lambda") <= tolerance).cast("int")
    rows = spectra.withColumn("__near", near).withColumn("__any", F.max("__near").over(Window.partitionBy("cloud_id"))).filter("__near = __any")
    nth = F.row_number().over(Window.partitionBy("cloud_id").orderBy("mode"))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__near", "__any", "__nth")


def coefficients_of(matrices: DataFrame, name: str, col: int) -> DataFrame:
    """(cloud_id, coefficients): one column of a matrix as an array."""
    rows = matrices.filter((F.col("name") == name) & (F.col("col") == col))
    return rows.groupBy("cloud_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda e: e["value"]).alias("coefficients"))


def pointwise(basis: DataFrame, coefficients: DataFrame, components: int) -> DataFrame:
    """(cloud_id, point_id, form): the form of each cloud's ``coefficients`` (mode * components + component) at its points.

    Clouds whose coefficients do not fit their basis have no rows.
    """
    rows = basis.join(coefficients.select("cloud_id", "coefficients"), "cloud_id").filter(F.size("coefficients") == F.size("phi") * components)

    def at(c: int) -> Column:
        return F.aggregate(F.transform("phi", lambda u, i: u * F.get("coefficients", i * components + c)), F.lit(0.0), lambda s, t: s + t)

    return rows.select("cloud_id", "point_id", F.array(*[at(c) for c in range(components)]).alias("form"))


def dual_vectors(forms: DataFrame) -> DataFrame:
    """(cloud_id, point_id, vx, vy, vz) of 2-forms with components 01, 02, 12."""
    w = [F.get("form", F.lit(i)) for i in range(3)]
    return forms.select("cloud_id", "point_id", w[2].alias("vx"), (-w[1]).alias("vy"), w[0].alias("vz"))


def ambient_vectors(forms: DataFrame, gammas: DataFrame) -> DataFrame:
    """(cloud_id, point_id, vx, vy, vz) of 1-forms; ``gammas`` holds g_<a>_i<b> of data and immersion axes."""
    v = [sum((F.col(f"g_{a}_i{b}") * F.get("form", F.lit(i)) for i, b in enumerate("xyz")), F.lit(0.0)).alias(f"v{a}") for a in "xyz"]
    return forms.join(gammas, ["cloud_id", "point_id"]).select("cloud_id", "point_id", *v)


def ambient_duals(forms: DataFrame, gammas: DataFrame) -> DataFrame:
    """(cloud_id, point_id, vx, vy, vz) of 2-forms: the dual of gamma W gamma', W antisymmetric from 01, 02, 12."""
    w = {(0, 1): F.get("form", F.lit(0)), (0, 2): F.get("form", F.lit(1)), (1, 2): F.get("form", F.lit(2))}
    g = lambda a, b: F.col(f"g_{'xyz'[a]}_i{'xyz'[b]}")
    turned = lambda a, b: sum((e * (g(a, i) * g(b, j) - g(a, j) * g(b, i)) for (i, j), e in w.items()), F.lit(0.0))
    return forms.join(gammas, ["cloud_id", "point_id"]).select("cloud_id", "point_id", turned(1, 2).alias("vx"), (-turned(0, 2)).alias("vy"), turned(0, 1).alias("vz"))


def facing_outward(field: DataFrame, points: DataFrame) -> DataFrame:
    """``field`` (vx, vy, vz), turned round in clouds where the mean of place times vector is below 0."""
    both = field.join(points.select("cloud_id", "point_id", "x", "y", "z"), ["cloud_id", "point_id"])
    score = both.groupBy("cloud_id").agg(F.avg(F.col("x") * F.col("vx") + F.col("y") * F.col("vy") + F.col("z") * F.col("vz")).alias("__score"))
    sign = F.when(F.col("__score") < 0, -1.0).otherwise(1.0)
    return field.join(score, "cloud_id", "left").select("cloud_id", "point_id", *[(sign * F.col(c)).alias(c) for c in ("vx", "vy", "vz")])
