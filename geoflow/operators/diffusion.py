"""Heat steps and local covariance on a Markov edge table (cloud_id, src, dst, w)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import gapless_rank
from ..functions.tables import stored
from . import blocks, runs


def step(markov: DataFrame, field: DataFrame) -> DataFrame:
    """(cloud_id, point_id, value): mean of the field after one step."""
    ends = field.select("cloud_id", F.col("point_id").alias("dst"), "value")
    return markov.join(ends, ["cloud_id", "dst"]).groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _means(moved: np.ndarray, v: np.ndarray, prev: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    return moved, v, extra


def _laid_out(markov: DataFrame, field: DataFrame, places: DataFrame | None) -> blocks.Blocks:
    """The chain by blocks of points: near ones where ``places`` (cloud_id, point_id, x, y, z) are given, else of near ids."""
    if places is not None:
        return blocks.layout(markov, blocks.along_curve(places))
    ids = field.select("cloud_id", "point_id").union(markov.select("cloud_id", "src")).distinct()
    return blocks.layout(markov, gapless_rank(ids, ["cloud_id"], [F.col("point_id")], "at"))


def _begun(plan: blocks.Blocks, field: DataFrame) -> DataFrame:
    return blocks.start(plan, field.select("cloud_id", "point_id", F.array("value").alias("v")))


def _values(plan: blocks.Blocks, state: DataFrame) -> DataFrame:
    return blocks.unpacked(plan, state).select("cloud_id", "point_id", F.get("v", F.lit(0)).alias("value"))


def steps(markov: DataFrame, field: DataFrame, count: int, places: DataFrame | None = None) -> DataFrame:
    """(cloud_id, point_id, value): the field after ``count`` steps; for 0 or less the field itself. Points without a value have 0.

    The edges are packed into blocks once and stay there; all steps are one plan.
    """
    if count <= 0:
        return field.select("cloud_id", "point_id", "value")
    plan = _laid_out(markov, field, places)
    found = stored(_values(plan, blocks.walk(plan, _begun(plan, field), [_means] * count)))
    plan.drop()
    return found


def run(markov: DataFrame, field: DataFrame, count: int, every: int = 5, places: DataFrame | None = None) -> DataFrame:
    """(cloud_id, step, point_id, value): snapshots at 0, after every ``every`` steps and after the last one."""
    out = field.select("cloud_id", F.lit(0).alias("step"), "point_id", "value")
    if count <= 0:
        return out
    plan = _laid_out(markov, field, places)
    state = _begun(plan, field)
    for k in range(0, count, every):
        now = min(k + every, count)
        state = stored(blocks.walk(plan, state, [_means] * (now - k)))
        out = out.union(stored(_values(plan, state)).select("cloud_id", F.lit(now).alias("step"), "point_id", "value"))
    plan.drop()
    return out


def run_to(folder: str, markov: DataFrame, field: DataFrame, count: int, every: int = 5, places: DataFrame | None = None, stop_after: int | None = None) -> DataFrame:
    """Like ``run``, with each snapshot written to ``folder`` as a partition of its step.

    A run that was broken off goes on from its last whole snapshot: a step's files are replaced whole, and a step counts only once
    the manifest names it. ``field`` must be the same as before. ``stop_after`` ends a run early, after that step.
    """
    spark = markov.sparkSession
    wanted = sorted({*range(0, count + 1, every), count})
    done = runs.finished(spark, folder, wanted)
    if not done:
        runs.finish(field.select("cloud_id", "point_id", "value"), folder, 0)
        done = [0]
    plan = None
    for before, now in zip(wanted, wanted[1:], strict=False):
        if now in done or stop_after is not None and now > stop_after:
            continue
        plan = plan or _laid_out(markov, field, places)
        state = _begun(plan, runs.snapshot(spark, folder, before))
        runs.finish(_values(plan, blocks.walk(plan, state, [_means] * (now - before))), folder, now)
    if plan:
        plan.drop()
    return runs.snapshots(spark, folder, wanted)


def carre_du_champ(markov: DataFrame, nodes: DataFrame, fields: DataFrame, pairs: list[tuple[str, str]], mean_centres: bool = True) -> DataFrame:
    """(cloud_id, point_id, g_<f>_<h>, ...): weighted local covariance of field columns over twice the diffusion time.

    Values are taken relative to the point's own, which avoids cancellation; one join on each end, one aggregation.
    """
    names = sorted({n for p in pairs for n in p})
    own = fields.select("cloud_id", F.col("point_id").alias("src"), *[F.col(n).alias(f"o_{n}") for n in names])
    ends = fields.select("cloud_id", F.col("point_id").alias("dst"), *names)
    rows = markov.join(ends, ["cloud_id", "dst"]).join(own, ["cloud_id", "src"])
    d = {n: F.col(n) - F.col(f"o_{n}") for n in names}
    sums = [F.sum(F.col("w") * d[n]).alias(f"m_{n}") for n in names] + [F.sum(F.col("w") * d[a] * d[b]).alias(f"s_{a}_{b}") for a, b in pairs]
    rows = rows.groupBy("cloud_id", F.col("src").alias("point_id")).agg(*sums).join(nodes.select("cloud_id", "point_id", "bw"), ["cloud_id", "point_id"])
    time = 2 * F.greatest("bw", F.lit(1e-8))
    return rows.select("cloud_id", "point_id", *[((F.col(f"s_{a}_{b}") - (F.col(f"m_{a}") * F.col(f"m_{b}") if mean_centres else F.lit(0.0))) / time).alias(f"g_{a}_{b}") for a, b in pairs])
