"""Reading the input tables and pinning intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage and fixes what depends on how rows were dealt out (partition ids, generated ids), so that a
    stage which is run again after a lost executor sees the very same rows. The folder is the one that the
    cluster names in ``spark.checkpoint.dir``; where that is unset a temporary one is taken in local mode, as in tests,
    and anything else is an error: executors would not share it.
    """
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, set as ``pin`` says."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Like ``pin``, as Parquet files in the shared folder.

    For steps that repeat: a checkpoint keeps the estimated size of the plan behind it, which multiplies from join to
    join until planning takes longer than the work; of files the true size is known.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    for paths in SCRATCH:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of ``stored`` since each ``scratch`` that is open began.
SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes what ``stored`` wrote inside, but for the files of the DataFrames that are put into the list given.

    For steps whose results are stored themselves; nothing else that was made inside may be read afterwards.
    """
    paths: list[str] = []
    kept: list[DataFrame] = []
    SCRATCH.append(paths)
    try:
        yield kept
    finally:
        SCRATCH[:] = [x for x in SCRATCH if x is not paths]
    read = {name for df in kept for file in df.inputFiles() for name in file.split("/")}
    for path in paths:
        if path.rsplit("/", 1)[1] not in read:
            remove(spark, path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files that ``df`` reads where ``stored`` wrote them; nothing that still reads them may follow."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("stored-"):
            remove(df.sparkSession, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: they are deleted as each query ends, instead of when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that has rows for points or faces: both sides are dealt out by the key, whatever their size is guessed to be.

    What Spark guesses from a well-packed file is far too low, as keys in order take next to no space: a table of millions of points would be
    broadcast, which the driver has to hold whole.
    """
    return df.hint("merge")


def bucketed(df: DataFrame, keys: list[str], in_place: bool = False) -> DataFrame:
    """``df`` written once as a table bucketed by ``keys``, in the shared folder, and read by name.

    Spark knows how such a table is dealt out: joins on the keys read it in place. It has as many buckets as there are shuffle
    partitions, each in one file. With ``in_place`` the rows lie by these keys already, as a join with such a table leaves them.
    ``drop_bucketed`` forgets the table.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = partitions(spark)
    path = f"{shared_folder(spark)}/{name}"
    with shuffles_dropped(spark):
        (df if in_place else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    found = spark.table(name)
    found.bucketed_name = name
    return found


def batches_by_bytes(spark: SparkSession, most: int = 64 << 20) -> None:
    """Ends Arrow batches at ``most`` bytes, for rows that are large. Only ever lowers what the session asks for; it stays, as plans run later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdecimal() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def short_methods(spark: SparkSession, most: int = 8000) -> None:
    """Keeps rows of many long expressions out of generated methods that the JVM leaves interpreted: it compiles none of over 8,000 bytes.

    Above ``most`` bytes Spark evaluates a stage operator by operator, in methods that it splits. Only ever lowers what the session asks for; it stays,
    as plans run later.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def drop_bucketed(df: DataFrame) -> None:
    """Forgets a table of ``bucketed`` and deletes its files."""
    spark, name = df.sparkSession, df.bucketed_name
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove(spark, f"{shared_folder(spark)}/{name}")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage, whatever file system that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone, not on how rows are dealt out."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))
