"""Exact k nearest neighbours (self included) on the leaves of a split tree, which is as deep as the points ask for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import gapless_rank
from ..functions.tables import stored

#: Points of a leaf at most, queries that meet a leaf in one group, parts that a cell is split into, copies of a place in one join key.
LEAF_POINTS, ASKING, PARTS, COPIES = 2048, 4096, 16, 65_536
#: Distances held at a time.
CHUNK = 1_000_000
#: Levels of splits; each leaves at most about a ``PARTS``-th of a cell's points together, or halves its box.
DEEPEST = 400
FOUND = "cloud_id long, src long, dst long, d2 double, want long"
SIDES = [f"{e}{a}" for e in ("lo", "hi") for a in "xyz"]
CELL = ["cloud_id", "cell"]


def split_tree(points: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Points with the leaf (cell) that they lie in, and all cells (cloud_id, cell, parent, n, box, leaf) of the tree.

    A cell of more than ``most`` points is cut across the widest side of its box, at about every 1/``PARTS`` of its points; where
    these cuts fall together, in the middle. Cells that are small enough are left alone, so that a level handles only what is
    still too large. Of a point's place at most ``most`` copies may be given. Boxes are tight around their points.
    """
    active = stored(points.withColumn("cell", F.lit("")).withColumn("parent", F.lit(None).cast("string")))
    placed, cells = None, None
    for _ in range(DEEPEST):
        sides = [f(a).alias(f"{e}{a}") for e, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]
        boxes = active.groupBy(*CELL, "parent").agg(F.count(F.lit(1)).alias("n"), *sides)
        width = {a: F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"}
        widest = F.greatest(*width.values())
        axis = F.when(width["x"] == widest, "x").when(width["y"] == widest, "y").otherwise("z")
        boxes = stored(boxes.select("*", axis.alias("axis"), ((F.col("n") <= most) | (widest == 0)).alias("leaf")))
        cells = boxes if cells is None else cells.union(boxes)
        done = boxes.filter("leaf").select(*CELL)
        leaves = active.join(done, CELL, "left_semi").drop("parent")
        placed = leaves if placed is None else placed.union(leaves)
        large = boxes.filter("not leaf")
        if large.isEmpty():
            return placed, cells.drop("axis")
        value = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
        ends = {e: F.when(F.col("axis") == "x", F.col(f"{e}x")).when(F.col("axis") == "y", F.col(f"{e}y")).otherwise(F.col(f"{e}z")) for e in ("lo", "hi")}
        rows = active.join(large.select(*CELL, "axis", *[v.alias(e) for e, v in ends.items()]), CELL).withColumn("value", value)
        shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
        cuts = rows.groupBy(*CELL).agg(F.percentile_approx("value", shares, F.lit(1000)).alias("cuts"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        kept = F.array_distinct(F.filter("cuts", lambda c: c < F.col("hi")))
        middle = F.col("lo") + (F.col("hi") - F.col("lo")) / 2
        middle = F.when(middle < F.col("hi"), middle).otherwise(F.col("lo"))
        cuts = stored(cuts.select(*CELL, F.when(F.size(kept) > 0, kept).otherwise(F.array(middle)).alias("cuts")))
        child = F.size(F.filter("cuts", lambda c: c < F.col("value")))
        rows = rows.join(cuts, CELL).withColumn("parent", F.col("cell")).withColumn("cell", F.concat_ws(".", "cell", child.cast("string")))
        active = stored(rows.select(*active.columns))
    raise RuntimeError("the tree is too deep")


def apart(low: str, high: str, a: list[Column], b: list[Column] | None = None) -> Column:
    """The squared way from box columns with the given prefixes to a box from ``a`` to ``b`` (or to the point ``a``)."""
    gaps = [F.greatest(F.col(f"{low}{c}") - (b or a)[i], a[i] - F.col(f"{high}{c}"), F.lit(0.0)) for i, c in enumerate("xyz")]
    return sum((g * g for g in gaps), F.lit(0.0))


def best(queries: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, id, squared distance) of the k nearest of ``at`` for each query, by distance and then by id; ``ids`` ascend."""
    k = min(k, len(ids))
    step = max(1, CHUNK // max(len(ids), 1))
    for i in range(0, len(queries), step):
        d2 = 0.0
        for axis in range(at.shape[1]):  # one axis at a time, so that little is held
            d = queries[i : i + step, axis, None] - at[None, :, axis]
            d *= d
            d2 = d2 + d
        if k < len(ids):
            last = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]  # those as far as the k-th may tie: ids decide
            row, col = np.nonzero(d2 <= last)
        else:
            row, col = (x.ravel() for x in np.indices(d2.shape))
        far = d2[row, col]
        order = np.lexsort((col, far, row))
        row, col, far = row[order], col[order], far[order]
        first = np.searchsorted(row, np.arange(len(d2)))
        kept = np.arange(len(row)) - first[row] < k
        yield row[kept] + i, ids[col[kept]], far[kept]


def _answers(key: tuple, q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    c = c.sort_values("point_id")
    ids, at = c["point_id"].to_numpy(), c[["x", "y", "z"]].to_numpy()
    out = [pd.DataFrame({n.split()[0]: [] for n in FOUND.split(", ")})]
    if len(q) and len(c):
        src, want = q["point_id"].to_numpy(), q["want"].to_numpy()
        out = [pd.DataFrame({"cloud_id": key[0], "src": src[row], "dst": dst, "d2": d2, "want": want[row]}) for row, dst, d2 in best(q[["x", "y", "z"]].to_numpy(), at, ids, k)]
    return pd.concat(out)


def knn(points: DataFrame, k: int = 32) -> DataFrame:
    """(cloud_id, src, rank, dst, dist), rank from 0, ordered by distance and then id; k is held to [1, n].

    Points of one place have one answer, and only the first k of them can be in any: one stands for all as a query and
    k as candidates, so that a place of many copies is no large group. Each query first looks into its own leaf of a split tree. What it
    finds there bounds how far it has to look: a leaf's largest bound is followed down the tree to the leaves that it may reach, and
    each query goes to those that its own bound reaches. Groups hold one leaf and ``ASKING`` queries at most. Points
    with a null coordinate have no rows.
    """
    k = max(k, 1)
    place = ["cloud_id", "x", "y", "z"]
    ranked = stored(gapless_rank(points.select("cloud_id", "point_id", "x", "y", "z").dropna(), place, [F.col("point_id")], "nth"))
    copies = ranked.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    want = ranked.groupBy("cloud_id").agg(F.least(F.lit(k), F.count(F.lit(1))).cast("long").alias("want"))
    near = ranked.filter(F.col("nth") < k).join(want, "cloud_id")
    placed, cells = split_tree(near, max(LEAF_POINTS, 2 * k))
    placed = stored(placed)
    own = stored(placed.groupBy(*CELL).applyInPandas(lambda key, c: _answers(key, c[c["nth"] == 0], c, k), FOUND))
    found = own if cells.filter("parent is not null").isEmpty() else with_other_leaves(own, placed, stored(cells), k)
    nth = F.row_number().over(Window.partitionBy("cloud_id", "src").orderBy("d2", "dst"))
    answers = found.withColumn("nth", nth).filter(F.col("nth") <= F.col("want"))
    return with_copies(stored(answers.select("cloud_id", "src", (F.col("nth") - 1).alias("rank"), "dst", F.sqrt("d2").alias("dist"))), ranked, copies, place)


def with_other_leaves(own: DataFrame, placed: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``own`` and what queries find in the leaves besides their own that may hold nearer points, or equally near ones."""
    slack = 1 + 1e-9  # ways to boxes are rounded
    nth = own.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.count(F.lit(1)).alias("have"), F.max("d2").alias("most"))
    queries = placed.filter("nth = 0").join(nth, ["cloud_id", "point_id"])
    queries = stored(queries.select("cloud_id", "cell", "point_id", "x", "y", "z", "want", F.when(F.col("have") < F.col("want"), float("inf")).otherwise(F.col("most") * slack).alias("reach")))
    leaves = cells.filter("leaf").join(queries.groupBy(*CELL).agg(F.max("reach").alias("reach")), CELL).select("cloud_id", "cell", "reach", *SIDES)
    below = cells.select("cloud_id", F.col("parent").alias("other"), F.col("cell").alias("child"), F.col("leaf").alias("at_leaf"), *[F.col(c).alias(f"o{c}") for c in SIDES])
    roots = cells.filter("parent is null").select("cloud_id", F.col("cell").alias("other"))
    open_, pairs = leaves.join(roots, "cloud_id"), None
    box = [[F.col(f"{e}{a}") for a in "xyz"] for e in ("lo", "hi")]
    while True:  # one level of the tree at a time
        ahead = stored(open_.join(below, ["cloud_id", "other"]).filter(apart("olo", "ohi", box[0], box[1]) <= F.col("reach")).filter("child <> cell"))
        reached = ahead.filter("at_leaf").select("cloud_id", "cell", F.col("child").alias("other"), *[f"o{c}" for c in SIDES])
        pairs = reached if pairs is None else pairs.union(reached)
        open_ = ahead.filter("not at_leaf").select("cloud_id", "cell", "reach", *SIDES, F.col("child").alias("other"))
        if open_.isEmpty():
            break
    asked = queries.join(pairs, CELL).filter(apart("olo", "ohi", [F.col(a) for a in "xyz"]) <= F.col("reach"))
    asked = stored(asked.select("cloud_id", F.col("other").alias("cell"), "point_id", "x", "y", "z", "want"))
    groups = asked.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("asking"))
    asked = asked.join(groups, CELL).select("cloud_id", "cell", F.pmod(F.xxhash64("point_id"), "asking").alias("ask"), "point_id", "x", "y", "z", "want")
    sent = placed.join(groups, CELL).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)))
    sent = sent.select(*[F.col(c).alias(c) for c in ("cloud_id", "cell", "ask", "point_id", "x", "y", "z")])
    keys = [*CELL, "ask"]
    more = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(lambda key, q, c: _answers(key, q, c, k), FOUND)
    return own.union(more)


def with_copies(answers: DataFrame, ranked: DataFrame, copies: DataFrame, place: list[str]) -> DataFrame:
    """The answers of first points given to the other points of their places, in blocks of ``COPIES`` points."""
    salt = F.expr(f"nth div {COPIES}")
    first = ranked.filter("nth = 0").join(copies.filter("__n > 1"), place).select(*place, F.col("point_id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES}"))).alias("salt"))
    others = ranked.filter("nth > 0").select(*place, "point_id", salt.alias("salt"))
    others = others.join(first, [*place, "salt"]).select("cloud_id", "src", "salt", "point_id")
    given = answers.join(first.select("cloud_id", "src", "salt"), ["cloud_id", "src"]).join(others, ["cloud_id", "src", "salt"])
    return answers.union(given.select("cloud_id", F.col("point_id").alias("src"), "rank", "dst", "dist"))
