"""Gapless ranks inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import partitions, pin


def gapless_rank(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in each group along ``order``.

    Rows are range-partitioned by group and order, so that a large group spans many partitions; each
    partition ranks its own rows and adds the number of the group's rows in earlier partitions. Only
    (group, partition) counts are put in order. Group columns must not be null. Rows that tie on the whole
    order are told apart arbitrarily but only once, as the partitioning is pinned first.
    """
    spread = df.repartitionByRange(partitions(df.sparkSession), *[F.col(g) for g in groups], *order)
    spread = pin(spread.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = Window.partitionBy(*groups, "__part").orderBy(*order)
    ranked = spread.withColumn("__rank", F.row_number().over(here).cast("long") - 1)
    ranked = ranked.join(offsets, [*groups, "__part"])
    return ranked.withColumn(name, F.col("__rank") + F.col("__before")).drop("__rank", "__before", "__part")
