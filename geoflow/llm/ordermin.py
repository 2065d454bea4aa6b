"""Order MinHash fingerprints with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import partitions

#: Low bits of a sort key that hold a k-mer's place in the text (16.7 million words, then places wrap around).
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
BUCKET_SHIFT = 57
#: Scripts written without blanks; each of their characters is a word.
UNSPACED = "[\\u2E80-\\u9FFF\\uAC00-\\uD7AF]"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: an array of up to 64 longs, one for each bucket that the text's k-mers fall into.

    A k-mer is two words in a row (the last word alone at the end). Equal k-mers are numbered by occurrence, so
    that repeats count; each (k-mer, occurrence) is hashed once, its hash deals it to one of 64 buckets and
    ranks it there; the two least of a bucket are put in their text order and hashed as a tuple. A value is
    bucket * 2**32 + tuple hash. All steps are array expressions of one row: no shuffle, no row per k-mer. Two
    sorts of plain longs order k-mers and buckets; an occurrence number is the distance to the start of a run
    of equal k-mers, found by doubling steps. Null and empty texts have the fingerprint of one empty word.
    """
    place = lambda i: i.cast("long").bitwiseAND(PLACE)
    kmer = lambda x: F.shiftright(x, PLACE_BITS)
    bucket = lambda x: F.shiftright(x, BUCKET_SHIFT)
    df = df.withColumn("__w", F.split(F.coalesce(F.col(text), F.lit("")), rf"\s+|(?<={UNSPACED})"))
    df = df.withColumn("__s", F.sort_array(F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1)).bitwiseAND(~PLACE).bitwiseOR(place(i)))))

    def occurrence(x: Column, i: Column) -> Column:
        steps = F.array(*[F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)])
        back = F.aggregate(steps, F.lit(0), lambda n, d: F.when((i - n - d >= 0) & (kmer(F.get("__s", i - n - d)) == kmer(x)), n + d).otherwise(n))
        return F.when((i > 0) & (kmer(F.get("__s", i - 1)) == kmer(x)), back).otherwise(F.lit(0))

    least = F.transform("__s", lambda x, i: F.xxhash64(kmer(x), occurrence(x, i)).bitwiseAND(((1 << 63) - 1) & ~PLACE).bitwiseOR(x.bitwiseAND(PLACE)))
    df = df.withColumn("__t", F.sort_array(least))
    df = df.withColumn("__f", F.filter("__t", lambda x, i: (i < 2) | (bucket(F.get("__t", i - 2)) != bucket(x))))

    def tuple_hash(x: Column, i: Column) -> Column:
        y = F.get("__f", i + 1)
        a, b = kmer(x), kmer(y)
        both = F.when(y.isNull() | (bucket(y) != bucket(x)), F.xxhash64(a)).when(x.bitwiseAND(PLACE) < y.bitwiseAND(PLACE), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        return F.when((i == 0) | (bucket(F.get("__f", i - 1)) != bucket(x)), F.shiftleft(bucket(x), 32).bitwiseOR(both.bitwiseAND((1 << 32) - 1)))

    values = F.filter(F.transform("__f", tuple_hash), lambda v: v.isNotNull())
    return df.withColumn(name, values).drop("__w", "__s", "__t", "__f")


def shown(fingerprint: Column | str) -> Column:
    """The fingerprint as a string."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.hex(v))), "-")


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of equal tuples among the buckets that either text fills: 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    buckets = lambda v: F.transform(v, lambda x: F.shiftright(x, 32))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(buckets(a), buckets(b)))


def with_next(df: DataFrame, key: str, columns: list[str], most_buckets: int = 8192) -> DataFrame:
    """Add ``next_<column>`` of the row that follows by descending ``key``; after the last comes the first.

    Rows are dealt into key ranges (quantiles of the key column alone); the first row of each range is also
    sent, as a guest, to the range before it, so that every row finds its follower in its own range and the
    wide columns are shuffled once. Null keys come last; rows of equal keys follow each other by ``columns``.
    """
    spark = df.sparkSession
    wanted = min(most_buckets, 4 * partitions(spark))
    shares = [i / wanted for i in range(1, wanted)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), shares, F.lit(max(10_000, 20 * wanted)))).first()[0] if shares else []
    bounds = sorted(set(found or []))
    if bounds:
        steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
        edges = F.array(*[F.lit(b).cast("long") for b in bounds])
        home = F.aggregate(steps, F.lit(0), lambda n, d: F.when((n + d <= len(bounds)) & (F.get(edges, n + d - 1) <= F.col(key)), n + d).otherwise(n))
    else:
        home = F.lit(0)
    dealt = df.withColumn("__home", home)
    heads = sorted(dealt.groupBy("__home").agg(F.max(key)).collect(), reverse=True)  # one row for each range
    before = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads) if first is not None]
    guests = spark.createDataFrame(before, f"`{key}` {df.schema[key].dataType.simpleString()}, __guest int")
    dealt = dealt.join(F.broadcast(guests), key, "left")
    spots = F.array(F.struct(F.col("__home").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("__guest").alias("at"), F.lit(True).alias("guest")))
    spots = F.when(F.col("__guest").isNotNull(), spots).otherwise(F.slice(spots, 1, 1))
    dealt = dealt.withColumn("__spot", F.explode(spots)).select("*", "__spot.at", "__spot.guest")
    ahead = Window.partitionBy("at").orderBy("guest", F.col(key).desc_nulls_last(), *columns)
    dealt = dealt.select(*df.columns, "guest", *[F.coalesce(F.lead(c).over(ahead), F.col(c)).alias(f"next_{c}") for c in columns])
    return dealt.filter(~F.col("guest")).drop("guest")


def with_edit(df: DataFrame, text: str, other: str, name: str = "edited") -> DataFrame:
    """Replace the last floor(n/3) code points of ``text`` by the first as many (or all) of ``other``."""
    n = F.length(text)
    third = F.expr(f"length(`{text}`) div 3").cast("int")
    return df.withColumn(name, F.concat(F.substring(F.col(text), F.lit(1), (n - third).cast("int")), F.substring(F.col(other), F.lit(1), third)))
