"""Density-adaptive kernels, Markov chain and stationary measure of a k-nearest-neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import gapless_rank
from ..functions.tables import scratch, stored

#: Scales at which a kernel is tried: powers of 2 from -10, a quarter apart.
SCALES = 2.0 ** (np.arange(80) / 4 - 10)


@dataclass
class Graph:
    """A chain and what goes with it; ``symk`` and ``nodes`` are made, once, when they are first asked for: steps of the chain need neither."""

    knn: DataFrame
    markov: DataFrame
    params: DataFrame
    points: DataFrame
    times: DataFrame

    @cached_property
    def symk(self) -> DataFrame:
        return stored(symmetric(self.markov))

    @cached_property
    def nodes(self) -> DataFrame:
        found = measure(self.symk).join(self.times, ["cloud_id", "point_id"])
        return stored(found.join(immersion(self.markov, self.points), ["cloud_id", "point_id"]))


def local_bandwidth(knn: DataFrame, knn_bw: int = 8) -> DataFrame:
    """(cloud_id, point_id, bw): root mean square distance of ranks 1 to knn_bw - 1; 1 with a single neighbour."""
    k = knn.groupBy("cloud_id").agg((F.max("rank") + 1).alias("k"))
    end = F.greatest(F.lit(2), F.least(F.lit(knn_bw), F.col("k")))
    rows = knn.join(k, "cloud_id")
    found = rows.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.sum(F.when((F.col("rank") >= 1) & (F.col("rank") < end), F.col("dist") * F.col("dist")).otherwise(0.0)).alias("s"), F.max("k").alias("k"))
    return found.select("cloud_id", "point_id", F.when(F.col("k") <= 1, 1.0).otherwise(F.greatest(F.sqrt(F.col("s") / (end - 1)), F.lit(1e-8))).alias("bw"))


def scaled(knn: DataFrame, nodes: DataFrame) -> DataFrame:
    """knn with v: squared distance over both ends' bandwidths."""
    own, other = nodes.select("cloud_id", F.col("point_id").alias("src"), F.col("bw").alias("bi")), nodes.select("cloud_id", F.col("point_id").alias("dst"), F.col("bw").alias("bj"))
    rows = knn.join(other, ["cloud_id", "dst"]).join(own, ["cloud_id", "src"])
    return rows.withColumn("v", F.col("dist") * F.col("dist") / (F.greatest("bj", F.lit(1e-8)) * F.greatest("bi", F.lit(1e-8))))


def scale_sums(entries: DataFrame) -> DataFrame:
    """(cloud_id, e, s, n): sum of exp(-v / scale) for each scale and cloud, added up inside each task first."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        sizes: dict[int, int] = {}
        for rows in batches:
            for cloud, v in rows.groupby("cloud_id")["v"]:
                x = v.to_numpy()
                for i in range(0, len(x), 4096):
                    sums[cloud] = sums.get(cloud, 0) + np.exp(-x[i : i + 4096, None] / SCALES).sum(axis=0)
                sizes[cloud] = sizes.get(cloud, 0) + len(x)
        for cloud, s in sums.items():
            yield pd.DataFrame({"cloud_id": cloud, "e": np.arange(80), "s": s, "n": sizes[cloud]})

    return entries.select("cloud_id", "v").mapInPandas(partial, "cloud_id long, e int, s double, n long").groupBy("cloud_id", "e").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def tune_kernel(entries: DataFrame) -> DataFrame:
    """(cloud_id, eps, dim): the scale where the kernel sum grows fastest (the first such), and twice that slope."""
    log = F.log(F.greatest(F.col("s") / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-30)))
    step = math.log(2) / 4
    slope = (F.lead(log).over(Window.partitionBy("cloud_id").orderBy("e")) - log) / step
    rows = scale_sums(entries).withColumn("slope", slope).filter("e < 79")
    best = rows.groupBy("cloud_id").agg(F.max(F.struct("slope", -F.col("e"))).alias("b"))
    return best.select("cloud_id", F.pow(F.lit(2.0), -F.col("b.col2") / 4.0 - 10).alias("eps"), (2 * F.col("b.slope")).alias("dim"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """(cloud_id, median): element n div 2 of the sorted values, by ranks that no single task has to hold."""
    ranked = gapless_rank(rows.select("cloud_id", "point_id", value), ["cloud_id"], [F.col(value), F.col("point_id")], "__nth")
    n = ranked.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(n, "cloud_id").filter("__nth = __n div 2").select("cloud_id", F.greatest(F.col(value), F.lit(1e-8)).alias("median"))


def _sum_exp(entries: DataFrame, params: DataFrame) -> DataFrame:
    return entries.join(params, "cloud_id").groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.sum(F.exp(-F.col("v") / F.col("eps"))).alias("s"))


def density_a(entries: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    """(cloud_id, point_id, q): kernel density on the first bandwidths."""
    n = nodes.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _sum_exp(entries, params).join(nodes, ["cloud_id", "point_id"]).join(params, "cloud_id").join(n, "cloud_id")
    volume = F.greatest(F.pow(math.pi * F.col("eps"), F.col("dim") / 2), F.lit(1e-12))
    return rows.select("cloud_id", "point_id", F.greatest(F.lit(1e-12), F.col("s") / volume / (F.col("n") * F.pow("bw", "dim"))).alias("q"))


def bandwidth_b(density: DataFrame, beta: float = -0.5) -> DataFrame:
    """(cloud_id, point_id, bw): q ** beta over its upper median."""
    rows = density.select("cloud_id", "point_id", F.pow("q", F.lit(beta)).alias("w"))
    return rows.join(upper_median(rows, "w"), "cloud_id").select("cloud_id", "point_id", (F.col("w") / F.col("median")).alias("bw"))


def density_b(entries: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    rows = _sum_exp(entries, params).join(nodes, ["cloud_id", "point_id"]).join(params, "cloud_id")
    return rows.select("cloud_id", "point_id", F.greatest(F.lit(1e-12), F.col("s") / F.pow("bw", "dim")).alias("q"))


def alpha(dim: Column, beta: float, c: float) -> Column:
    return 1 - c / 2 + beta * (dim / 2 + 1)


def transition(entries: DataFrame, density: DataFrame, params: DataFrame, beta: float, c: float) -> DataFrame:
    """(cloud_id, src, rank, dst, w): rows sum to 1; a row without weight stays at itself, or at rank 0 if it is not its own neighbour."""
    a = alpha(F.col("dim"), beta, c)
    rows = entries.join(density.select("cloud_id", F.col("point_id").alias("dst"), F.col("q").alias("qj")), ["cloud_id", "dst"])
    rows = rows.join(density.select("cloud_id", F.col("point_id").alias("src"), F.col("q").alias("qi")), ["cloud_id", "src"]).join(params, "cloud_id")
    rows = rows.withColumn("w", F.exp(-F.col("v") / F.col("eps")) * F.pow("qi", -a) * F.pow("qj", -a))
    row = Window.partitionBy("cloud_id", "src")
    rows = rows.withColumn("total", F.sum("w").over(row)).withColumn("home", F.min(F.when(F.col("dst") == F.col("src"), -1).otherwise(F.col("rank"))).over(row))
    at_home = F.when(F.col("home") == -1, F.col("dst") == F.col("src")).otherwise(F.col("rank") == 0)
    return rows.select("cloud_id", "src", "rank", "dst", F.when(F.col("total") > 1e-30, F.col("w") / F.col("total")).otherwise(at_home.cast("double")).alias("w"))


def symmetric(markov: DataFrame) -> DataFrame:
    """(cloud_id, src, dst, s): half the sum of the chain and its transpose."""
    both = markov.select("cloud_id", "src", "dst", "w").union(markov.select("cloud_id", "dst", "src", "w"))
    return both.groupBy("cloud_id", "src", "dst").agg((F.sum("w") / 2).alias("s"))


def measure(symk: DataFrame) -> DataFrame:
    """(cloud_id, point_id, row_sum, mu)."""
    rows = symk.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.greatest(F.sum("s"), F.lit(1e-12)).alias("row_sum"))
    total = rows.groupBy("cloud_id").agg(F.sum("row_sum").alias("t"), F.count(F.lit(1)).alias("n"))
    return rows.join(total, "cloud_id").select("cloud_id", "point_id", "row_sum", F.when(F.col("t") > 1e-12, F.col("row_sum") / F.col("t")).otherwise(1.0 / F.col("n")).alias("mu"))


def immersion(markov: DataFrame, points: DataFrame) -> DataFrame:
    """(cloud_id, point_id, ix, iy, iz): mean place after one step."""
    ends = points.select("cloud_id", F.col("point_id").alias("dst"), "x", "y", "z")
    return markov.join(ends, ["cloud_id", "dst"]).groupBy("cloud_id", F.col("src").alias("point_id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"i{c}") for c in "xyz"])


def build(points: DataFrame, knn: DataFrame, knn_bw: int = 8, beta: float = -0.5, c: float = 0.0) -> Graph:
    """The whole graph of a cloud of points and its neighbours; empty tables give empty results."""
    with scratch(points.sparkSession) as kept:
        found = _built(points, stored(knn), knn_bw, beta, c)
        kept += [found.knn, found.markov, found.params, found.times]
    return found


def _built(points: DataFrame, knn: DataFrame, knn_bw: int, beta: float, c: float) -> Graph:
    bw_a = stored(local_bandwidth(knn, knn_bw))
    in_a = scaled(knn, bw_a)
    par_a = stored(tune_kernel(in_a))
    bw_b = stored(bandwidth_b(density_a(in_a, bw_a, par_a), beta))
    in_b = stored(scaled(knn, bw_b).select("cloud_id", "src", "rank", "dst", "dist", "v"))
    par_b = stored(tune_kernel(in_b))
    markov = stored(transition(in_b, density_b(in_b, bw_b, par_b), par_b, beta, c))
    time = (F.greatest("eps", F.lit(1e-12)) * F.col("bw") * F.col("bw") / 4).alias("bw")
    times = bw_b.join(par_b, "cloud_id").select("cloud_id", "point_id", time)
    params = par_a.toDF("cloud_id", "eps_a", "dim_a").join(par_b.toDF("cloud_id", "eps_b", "dim_b"), "cloud_id").withColumn("alpha", alpha(F.col("dim_b"), beta, c))
    return Graph(knn, markov, params, points, times)
