"""Matrices of differential forms, summed over points: Gram, weak derivative and energy, for a basis given as a table.

Basis: (cloud_id, point_id, phi array<double>). Matrices come out as (cloud_id, name, row, col, value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import batches_by_bytes
from . import blocks

MATRIX = "cloud_id long, name string, row int, col int, value double"
#: Points whose covariances are held at a time.
POINTS = 256
#: The ordered index pairs of 2-forms in three dimensions.
PAIRS = ((0, 1), (0, 2), (1, 2))


def gamma_rows(markov: DataFrame, nodes: DataFrame, basis: DataFrame, mean_centres: bool = True) -> DataFrame:
    """(cloud_id, point_id, mu, phi, g): covariance of (ix, iy, iz, phi...) over each point's neighbours, row-major.

    Each source gathers its neighbours' vectors once; the covariances of all pairs come from that one gathering.
    """
    wide = nodes.join(basis, ["cloud_id", "point_id"]).select("cloud_id", "point_id", "mu", "bw", "phi", F.concat(F.array("ix", "iy", "iz"), "phi").alias("f"))
    ends = wide.select("cloud_id", F.col("point_id").alias("dst"), F.col("f").alias("there"))
    batches_by_bytes(markov.sparkSession)
    rows = markov.join(ends, ["cloud_id", "dst"]).groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.collect_list(F.struct("w", "there")).alias("around"))
    # Flat numbers reach Python as arrays; structs would become an object for each edge, many times as large.
    rows = rows.select("cloud_id", "point_id", F.transform("around", lambda r: r["w"]).alias("w"), F.flatten(F.transform("around", lambda r: r["there"])).alias("there"))

    @F.pandas_udf("array<double>")
    def covariance(w: pd.Series, there: pd.Series, own: pd.Series, bw: pd.Series) -> pd.Series:
        return pd.Series([_covariance(*row, mean_centres) for row in zip(w, there, own, bw, strict=True)])

    return rows.join(wide, ["cloud_id", "point_id"]).select("cloud_id", "point_id", "mu", "phi", covariance("w", "there", "f", "bw").alias("g"))


def _covariance(w: np.ndarray, there: np.ndarray, own: np.ndarray, bw: float, mean_centres: bool) -> np.ndarray:
    d = there.reshape(len(w), -1) - own[None, :]
    g = d.T @ (d * w[:, None])
    if mean_centres:
        m = w @ d
        g -= np.outer(m, m)
    return (g / (2 * max(bw, 1e-8))).ravel()


def minors(g: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """k-by-k minors of a batch of 3-by-3 metrics, and their index sets."""
    sets = [(), (0,), (1,), (2,), *PAIRS, (0, 1, 2)]
    sets = [s for s in sets if len(s) == k]
    if k == 0:
        return np.ones((len(g), 1, 1)), sets
    return np.stack([np.stack([np.linalg.det(g[:, a][:, :, b]) for b in sets], axis=1) for a in sets], axis=1), sets


def form_matrices(gammas: DataFrame, n1: int) -> DataFrame:
    """Gram matrices g0 to g3, weak derivatives d0 to d2 and up energies e0 to e2, in one pass over ``gamma_rows``.

    ``n1`` is the number of modes used. Index of a k-form entry: mode * C(3, k) + component. Each task adds up its own
    points and sends one partial matrix set for each cloud; memory is that of the matrices and one batch.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        for rows in batches:
            for cloud, part in rows.groupby("cloud_id"):
                for i in range(0, len(part), POINTS):
                    some = part.iloc[i : i + POINTS]
                    mu, u, g = some["mu"].to_numpy(), np.stack(some["phi"].to_numpy()), np.stack(some["g"].to_numpy())
                    size = u.shape[1] + 3
                    for name, m in _one_batch(mu, u, g.reshape(-1, size, size), n1):
                        sums[cloud, name] = sums.get((cloud, name), 0) + m
        for (cloud, name), m in sums.items():
            r, c = np.indices(m.shape)
            yield pd.DataFrame({"cloud_id": cloud, "name": name, "row": r.ravel(), "col": c.ravel(), "value": m.ravel()})

    return gammas.mapInPandas(partial, MATRIX).groupBy("cloud_id", "name", "row", "col").agg(F.sum("value").alias("value"))


@dataclass
class Assembly:
    """A basis at the points beside the chain, laid out by blocks: from it sums over all points' covariances are made, none of which leaves its block."""

    plan: blocks.Blocks
    state: DataFrame
    mean_centres: bool = True

    def sums(self, look: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], dict[str, np.ndarray]], extra: DataFrame | None = None) -> DataFrame:
        """Matrices (cloud_id, name, row, col, value): what ``look`` makes of (mu, phi, covariances, extra) of some points, added up.

        ``extra`` (cloud_id, extra binary) is given to each block of its cloud; clouds without one have no sums.
        """
        centred = self.mean_centres
        state = self.state if extra is None else self.state.drop("extra").join(extra, "cloud_id")
        return blocks.visit(self.plan, state, lambda near: (look(*part, near.extra) for part in _covariances(near, centred)))

    def matrices(self, n1: int) -> DataFrame:
        """What ``form_matrices`` gives of ``gamma_rows``, covariance and contraction in one pass."""
        return self.sums(lambda mu, u, g, _: dict(_one_batch(mu, u, g, n1)))


def assembly(markov: DataFrame, nodes: DataFrame, basis: DataFrame, mean_centres: bool = True) -> Assembly:
    """Lays out chain and basis; each further sum over points costs one message from block to block."""
    plan = blocks.layout(markov, blocks.along_curve(nodes, ("ix", "iy", "iz")))
    field = nodes.join(basis, ["cloud_id", "point_id"]).select("cloud_id", "point_id", F.concat(F.array("mu", "bw", "ix", "iy", "iz"), "phi").alias("v"))
    return Assembly(plan, blocks.start(plan, field), mean_centres)


def _covariances(near: blocks.Near, mean_centres: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """mu, phi and the covariances of (ix, iy, iz, phi...) around each point, for ``POINTS`` points at a time."""
    starts = near.starts()
    ends = np.append(starts[1:], len(near.src))
    for k in range(0, len(starts), POINTS):
        own = near.v[near.src[starts[k : k + POINTS]]]
        g = np.empty((len(own), near.v.shape[1] - 2, near.v.shape[1] - 2))
        for p, (a, b) in enumerate(zip(starts[k : k + POINTS], ends[k : k + POINTS], strict=True)):
            d, w = near.ends[near.dst[a:b], 2:] - own[p, 2:], near.w[a:b]
            g[p] = d.T @ (d * w[:, None])
            if mean_centres:
                m = w @ d
                g[p] -= np.outer(m, m)
            g[p] /= 2 * max(own[p, 1], 1e-8)
        yield own[:, 0], own[:, 5:], g


def _one_batch(mu: np.ndarray, u: np.ndarray, g: np.ndarray, n1: int) -> Iterator[tuple[str, np.ndarray]]:
    u = u[:, :n1]
    metric, mixed, inner = g[:, :3, :3], g[:, :3, 3 : 3 + n1], g[:, 3 : 3 + n1, 3 : 3 + n1]
    flat = lambda m: m.reshape(m.shape[0] * m.shape[1], -1)
    for k in range(4):
        minor, sets = minors(metric, k)
        yield f"g{k}", flat(np.einsum("p,pi,pl,pab->ialb", mu, u, u, minor, optimize=True))
        if k < 3:
            bigger = [s for s in ((0,), (1,), (2,), *PAIRS, (0, 1, 2)) if len(s) == k + 1]
            d = np.zeros((len(mu), n1, len(bigger), n1, len(sets)))
            for j, s in enumerate(bigger):
                for r, axis in enumerate(s):
                    rest = sets.index(s[:r] + s[r + 1 :])
                    d[:, :, j] += (-1) ** r * np.einsum("p,pi,pl,pb->pilb", mu, u, mixed[:, axis], minor[:, rest], optimize=True)
            yield f"d{k}", flat(d.sum(axis=0))
    yield "e0", np.einsum("p,pij->ij", mu, inner)
    curl = np.einsum("p,pil,pjk->ijlk", mu, inner, metric, optimize=True) - np.einsum("p,pki,pjl->ijlk", mu, mixed, mixed, optimize=True)
    yield "e1", flat(curl)
    yield "e2", flat(_up_two(mu, metric, mixed, inner))


def _up_two(mu: np.ndarray, metric: np.ndarray, mixed: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Up energy of 2-forms: det D times (inner less the part that D explains), D the metric on rows J and columns K."""
    n1 = inner.shape[1]
    out = np.zeros((n1, len(PAIRS), n1, len(PAIRS)))
    for j, rows in enumerate(PAIRS):
        for k, cols in enumerate(PAIRS):
            d = metric[:, rows][:, :, cols]
            det = np.linalg.det(d)
            inverse, sound = np.empty_like(d), np.abs(det) > 1e-8
            inverse[sound] = np.linalg.inv(d[sound])
            for p in np.flatnonzero(~sound):  # singular values over 1e-8 are inverted
                u, s, v = np.linalg.svd(d[p])
                inverse[p] = (v.T * np.where(s > 1e-8, 1 / np.maximum(s, 1e-8), 0)) @ u.T
            explained = np.einsum("pki,pkj,pjl->pil", mixed[:, cols], inverse, mixed[:, rows], optimize=True)
            out[:, j, :, k] = np.einsum("p,pil->il", mu * det, inner - explained)
    return out
