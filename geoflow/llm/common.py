"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Rows of text in one Arrow batch: a Python worker holds few long texts at a time.
BATCH_ROWS = 512


#: Bytes of one Arrow batch: a batch ends early where texts are very long.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory, by rows and by bytes.

    Only ever lowers what the session asks for. The setting stays, as the plans that need it run later.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def whole_text(df: DataFrame, name: str = "text") -> Column:
    """The text, with null taken as empty."""
    return F.coalesce(df[name], F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written as text (null as the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


#: Rows of a frequent key that share a salt; keys with fewer rows have one salt. Keys that are looked at for this, the most frequent ones.
ROWS_A_SALT, HOT_KEYS = 1000, 1024


def salted(unique: DataFrame, many: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``unique``, which has one row for each key; the rows of a frequent key are dealt out by salts.

    The ``HOT_KEYS`` most frequent keys and their counts are looked up first (a fixed number of rows, so that they may be
    broadcast); any other key has less than 1/``HOT_KEYS`` of the rows. A key's row of ``unique`` is sent once for each of its salts.
    ``many`` is read twice.
    """
    spark, salts = many.sparkSession, "__salts"
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias(salts)).filter(F.col(salts) > ROWS_A_SALT)
    hot = counts.orderBy(F.desc(salts), *on).limit(HOT_KEYS).select(*on, F.ceil(F.col(salts) / ROWS_A_SALT).cast("int").alias(salts)).collect()
    if not hot:
        return many.join(unique, on, how)
    fields = many.select(*on).schema.add(salts, IntegerType())
    number = lambda df: df.join(F.broadcast(spark.createDataFrame(hot, fields)), on, "left").withColumn(salts, F.coalesce(salts, F.lit(1)))
    copies = number(unique).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)
    dealt = number(many).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.col(salts)).cast("int")).drop(salts)
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")
