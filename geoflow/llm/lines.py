"""Removal of boilerplate lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a line's sketch: a standard error of about 2.3 per cent; few sites are counted exactly.
SKETCH = 11
#: Parts that the rows of one line are dealt into where they meet a table of lines.
SALTS = 16


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _without(lines: Column, places: Column) -> Column:
    """The lines but for those at ``places``, joined again; the work grows with the number of lines, not with its square."""

    def rest(all_lines: Column) -> Column:  # as an argument the lines are split once
        left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), places)
        return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

    return F.get(F.transform(F.array(lines), rest), F.lit(0))


def _row(df: DataFrame, key: str, text: str) -> list[Column]:
    """128 bits that stand for a row's id and text."""
    return [F.xxhash64(F.lit(n), F.col(key).cast("string"), text).alias(f"__r{n}") for n in (1, 2)]


def _semi(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose line key (a, b) is among ``keys``; each key is sent ``SALTS`` times, so that a frequent line is dealt out."""
    salted = keys.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "__salt"], "left_semi").drop("__salt")


def spread_lines(df: DataFrame, sites: int, text: str = "text", site: str = "source") -> DataFrame:
    """128-bit keys (a, b) of the non-blank lines that occur on ``sites`` or more distinct sites.

    Lines that occur fewer than ``sites`` times in all are left out by a plain count. Each other line gets a
    HyperLogLog sketch of its sites; sketches are made before the shuffle and merged after it, so that a line of
    every page is no hot key. A sketch clear of the threshold by five standard errors decides; lines nearer to
    it get the exact distinct count. Rows of null site count as one site.
    """
    lines = df.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(_lines(text)).alias("line")).filter(F.trim("line") != "")
    keys = lines.select("site", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    often = keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sites).select("a", "b")
    keys = _semi(keys, often)
    guess = keys.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH)).alias("guess"))
    error = 5 * 1.04 / 2 ** (SKETCH / 2)
    low, high = sites * (1 - error) - 1, sites * (1 + error) + 1
    sure, near = guess.filter(F.col("guess") > high), guess.filter(F.col("guess").between(low, high))
    exact = _semi(keys, near).groupBy("a", "b").agg(F.countDistinct("site").alias("d")).filter(F.col("d") >= sites)
    return sure.select("a", "b").union(exact.select("a", "b"))


def removed_lines(df: DataFrame, sites: int, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """For each distinct (id, text) with such lines: its 128-bit key and the places of the lines to remove."""
    spread = spread_lines(df, sites, text, site)
    # In one step Spark would take the row's key after the lines, that is once for each line.
    placed = df.select(*_row(df, key, text), _lines(text).alias("__lines")).select("__r1", "__r2", F.posexplode("__lines").alias("place", "line")).filter(F.trim("line") != "")
    placed = placed.select("__r1", "__r2", "place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    return _semi(placed, spread).groupBy("__r1", "__r2").agg(F.collect_set("place").alias("__places"))


def without_boilerplate(df: DataFrame, sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source", counts: bool = False) -> DataFrame:
    """Cut from each text the lines that occur on ``sites`` or more distinct sites; rows all stay.

    Null text stays null; a text of such lines alone becomes empty. Rows of one id and text are treated alike.
    With ``counts`` the columns n_lines and n_removed are added (or replaced); null text counts as one empty line.
    An empty table gives an empty result.
    """
    rows = df.select("*", *_row(df, key, text)).join(removed_lines(df, sites, key, text, site), ["__r1", "__r2"], "left")
    some = F.col("__places").isNotNull()
    kept = F.when(some, _without(_lines(text), F.col("__places"))).otherwise(F.col(text))
    more = {"n_lines": F.size(_lines(text)).cast("long"), "n_removed": F.when(some, F.size("__places")).otherwise(0).cast("long")} if counts else {}
    columns = [kept.alias(text) if c == text else F.col(c) for c in df.columns if c not in more]
    return rows.select(*columns, *[v.alias(k) for k, v in more.items()])
