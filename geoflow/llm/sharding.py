"""Uniform shuffle with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import gapless_rank
from ..functions.tables import pin

#: numpy draws hypergeometric numbers exactly below 10**9 rows; slabs of rows stay well under it.
SLAB_ROWS = 400_000_000
#: Input partitions whose counts are drawn together; the driver only sees one row for each block.
BLOCK = 256


def _capacities(slab_sizes: list[int], n_shards: int) -> list[np.ndarray]:
    """Shard capacities of each slab: dealt in turn, so that totals are at most one apart."""
    dealt, at = [], 0
    for n in slab_sizes:
        upto = lambda t: (t + n_shards - 1 - np.arange(n_shards)) // n_shards
        dealt.append(upto(at + n) - upto(at))
        at += n
    return dealt


def shard(df: DataFrame, n_shards: int = 24, seed: int = 20) -> DataFrame:
    """Deal all rows into ``n_shards`` shards whose sizes differ by one at most; add ``shard`` and ``slot``.

    1. Rows get the number of the input partition that holds them; this is pinned in the shared checkpoint
       folder, so that every later step sees the same partitions even if executors are lost.
    2. The matrix (input partition x shard) is drawn from the multivariate hypergeometric law with the
       partition counts and the shard sizes as its margins: first for blocks of partitions, then inside each
       block in parallel. Tables of more than ``SLAB_ROWS`` rows are first split into slabs by a hash of the
       row's own number; as that split is exchangeable, the whole is still uniform.
    3. Each partition permutes its rows and cuts the permutation by its row of the matrix.
    4. Rows are exchanged, and each shard permutes what it got; ``slot`` is gapless from 0 in each shard.

    All columns are carried: project wide ones away first. Null values and repeated rows are rows like any
    other; an empty table gives an empty result; columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    rows = df.drop("shard", "slot").withColumn("__src", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    rows = pin(rows)
    n_slabs = max(1, -(-rows.count() // SLAB_ROWS))
    rows = rows.withColumn("__slab", F.pmod(F.xxhash64(F.lit(seed), F.lit("slab"), "__id"), F.lit(n_slabs)).cast("int"))
    counts = rows.groupBy("__slab", "__src").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.expr(f"__src div {BLOCK}").cast("int"))

    blocks = sorted(map(tuple, counts.groupBy("__slab", "block").agg(F.sum("n")).collect()))
    sizes = [sum(n for s, _, n in blocks if s == k) for k in range(n_slabs)]
    left, rng, drawn = _capacities(sizes, n_shards), np.random.default_rng(seed), []
    for slab, block, n in blocks:
        take = rng.multivariate_hypergeometric(left[slab], n, method="marginals")
        left[slab] = left[slab] - take
        drawn.append((slab, block, [int(x) for x in take]))
    shares = spark.createDataFrame(drawn, "__slab int, block int, share array<long>")

    def rows_of_matrix(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__src")
        draw, rest, ends = np.random.default_rng([seed, 1, *map(int, key)]), np.array(part["share"].iloc[0], dtype=np.int64), []
        for n in part["n"]:
            take = draw.multivariate_hypergeometric(rest, int(n), method="marginals")
            rest = rest - take
            ends.append(np.cumsum(take))
        return pd.DataFrame({"__slab": part["__slab"], "__src": part["__src"], "ends": ends})

    matrix = counts.join(shares, ["__slab", "block"]).groupBy("__slab", "block").applyInPandas(rows_of_matrix, "__slab int, __src int, ends array<long>")
    local = Window.partitionBy("__slab", "__src").orderBy(F.xxhash64(F.lit(seed), F.lit("first"), "__id"), "__id")
    dealt = rows.withColumn("__at", F.row_number().over(local).cast("long") - 1).join(matrix, ["__slab", "__src"])
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("__at"))).cast("int"))
    dealt = dealt.drop("ends", "__at", "__slab", "__src")
    again = [F.xxhash64(F.lit(seed), F.lit("second"), "__id"), F.col("__id")]
    return gapless_rank(dealt, ["shard"], again, "slot").drop("__id").select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
