"""Near-duplicate groups by b-bit MinHash, with exact confirmation on whole shingle sets."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import partitions, pin
from .common import salted, small_batches

#: Bands and rows of each, the first that shares no band at the threshold with a chance of at most ``MISS``:
#: 24 x 6 from 0.85 on (1.2e-5), 32 x 5 from 0.8 on (3e-6; 24 x 6 would miss 7e-4 there), and so on.
SCHEMES, MISS = ((24, 6), (32, 5), (44, 4), (64, 3), (80, 2), (160, 1)), 1.2e-5
#: Bits kept of each minimum, packed sixteen to a long.
BITS = 4
#: Shares of estimate below the threshold at which a pair is still confirmed, from 0.85 on and below: about five standard deviations.
MARGIN, WIDE_MARGIN = 0.15, 0.16
#: Rows of a bucket that one task compares with as many others.
BLOCK = 1024


def scheme(percent: int) -> tuple[int, int]:
    """Bands and rows of each for a threshold."""
    return next((x for x in SCHEMES if (1 - (percent / 100) ** x[1]) ** x[0] <= MISS), SCHEMES[-1])


def margin(percent: int) -> float:
    return MARGIN if percent >= 85 else WIDE_MARGIN


@functools.cache
def _hashes(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands of the minima's hash functions, and factors of the band keys."""
    rng = np.random.default_rng(5)
    multiply = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
    return multiply, add, rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words make one shingle, none make none."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks divide
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    wide = min(width, len(h))
    at = np.full(len(h) - wide + 1, wide, dtype=np.uint64)
    for k in range(wide):
        at = _mix(at * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(at)])
    return np.unique(at)


def signature(found: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys from the full minima, and the minima's low bits packed into longs."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    multiply, add, factors = _hashes(bands, rows)
    least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        least = np.minimum(least, (multiply * x[None, i : i + 1024] + add).min(axis=1))
    wide = _mix(least.astype(np.uint64) + np.uint64(1))
    keys = _mix((wide.reshape(bands, rows) * factors).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    low = ((wide >> np.uint64(40)) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def estimate(a: Column | str, b: Column | str, minima: int) -> Column:
    """Similarity from packed bits: equal groups of bits are counted and corrected for chance collisions."""
    ones = int("0001" * 16, 2)

    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones))

    equal = 1 - F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, d: n + d) / F.lit(float(minima))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes on ``edges`` (a, b): the component is its smallest node.

    Alternating large and small star steps on a distributed edge table, which is pinned after each round;
    only two numbers a round come to the driver. The rounds needed grow with the logarithm of the nodes; a table
    that still changes after ``rounds`` is an error, never a half-done answer.
    """
    edges = pin(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = pin(small.filter("e.b <> e.m").select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    return found.select(F.col("a").alias("node"), "component").union(found.select("component", "component").distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("node").alias("a"), F.col("all").alias("__a")), sets.select(F.col("node").alias("b"), F.col("all").alias("__b"))
    both = F.size(F.array_intersect("__a", "__b"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("__a") + F.size("__b") - both)).select("a", "b")


def _shared_ids(base: DataFrame) -> DataFrame:
    """(a, b): keys of sets that rows of one id have, each with the least of them. Usually there are none."""
    keyed = base.filter("id is not null and n > 0").select("id", "key")
    several = keyed.groupBy("id").agg(F.min("key").alias("b"), F.max("key").alias("top")).filter("b <> top")
    return keyed.join(several.select("id", "b"), "id").filter("key <> b").select(F.col("key").alias("a"), "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of ``df``.

    Rows with equal sets fall into one class at once, by aggregation. Each class has a number and a MinHash
    signature; classes that share a band key are candidates. Round one links each member of a band bucket with the
    bucket's hub (its member of least hash), so that candidates grow linearly. Round two compares, in blocks, only
    those members of a bucket that round one left in different components; members of one component need no
    comparison. The packed low bits discard pairs estimated below the threshold less ``margin``; the others are
    confirmed on whole sets. component_id is the smallest id of all classes in the component.

    Null text, and text without words, has 0 shingles and is linked with nothing: component_id is the row's own id.
    Rows of one id but different texts stand for one document: their classes are in one component. Rows of null id
    get the component of their class (null if no row of it has an id) and link nothing themselves. An empty table
    gives an empty result; other columns are not looked at.
    """
    small_batches(df.sparkSession)
    n_bands, n_rows = scheme(percent)
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    ids = ids.withColumn("h", F.xxhash64("__text"))

    @F.pandas_udf("n long, key binary, bands array<long>, low array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found = shingles(t, width)
                rows.append((len(found), blake2b(found.tobytes(), digest_size=16).digest(), *signature(found, n_bands, n_rows)) if len(found) else (0, None, None, None))
            yield pd.DataFrame(rows, columns=["n", "key", "bands", "low"])

    base = pin(ids.select("id", "h", sketch("__text").alias("s")).select("id", "h", "s.*"))
    classes = base.filter("n > 0").groupBy("key").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("sample"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = pin(classes.filter("sample is not null").withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("h"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    banded = pin(salted(hubs.select("bucket", F.col("h.node").alias("hub"), "size"), banded, ["bucket"]))
    slim = classes.select("node", "n", "low")
    wanted = banded.select("node").distinct().join(classes, "node").select("node", "sample.id", "sample.h")
    sets = ids.join(wanted, ["id", "h"]).groupBy("id", "h", "node").agg(F.min("__text").alias("__text"))  # one of repeated rows

    @F.pandas_udf("array<long>")
    def whole_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, width).view(np.int64) for t in texts])

    sets = pin(sets.select("node", whole_sets("__text").alias("all")))

    @F.pandas_udf("binary")
    def codes(found: pd.Series) -> pd.Series:
        return found.map(lambda x: (np.asarray(x).view(np.uint64) >> np.uint64(16)).astype(np.uint16).tobytes())

    def likely(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(slim.toDF("a", "__na", "__la"), "a").join(slim.toDF("b", "__nb", "__lb"), "b")
        rows = rows.filter(100 * F.least("__na", "__nb") >= percent * F.greatest("__na", "__nb"))
        return rows.filter(estimate("__la", "__lb", n_bands * n_rows) >= percent / 100 - margin(percent)).select("a", "b")

    tried = likely(banded.filter("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())
    of_key = lambda key, node: classes.select(F.col("key").alias(key), F.col("node").alias(node))
    shared = _shared_ids(base).toDF("ka", "kb").join(of_key("ka", "a"), "ka").join(of_key("kb", "b"), "kb").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = pin(_confirmed(tried, sets, percent)).union(pin(shared))
    parts = pin(connected(links))

    rest = banded.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("bucket", "component").count()
    mixed = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("count", "component")).alias("most")).filter("parts > 1")
    rest = pin(salted(mixed.select("bucket", F.col("most.component").alias("main")), rest, ["bucket"]))
    rest = rest.join(slim, "node").join(sets.select("node", codes("all").alias("codes")), "node")
    more = pin(cross_candidates(rest, percent))
    links = links.union(pin(_confirmed(more, sets, percent)))
    parts = pin(connected(links))

    linked = classes.select("key", "node", F.col("sample.id").alias("own")).join(parts, "node", "left")
    least = linked.filter("component is not null").groupBy("component").agg(F.min("own").alias("least"))
    of_class = linked.join(least, "component", "left").select("key", F.coalesce("least", "own").alias("component_id"))
    out = salted(of_class, base.filter("key is not null").select("id", "n", "key"), ["key"], "left").select("id", "n", "component_id")
    out = out.union(base.filter("key is null").select("id", "n", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _compare_cell(x: pd.DataFrame, y: pd.DataFrame, percent: int, out: list[tuple[int, int]]) -> None:
    """Adds pairs of a row of x and one of y that lie in different components and may be similar enough."""
    ones, least, minima = np.uint64(int("0001" * 16, 2)), percent / 100, math.prod(scheme(percent))
    need = (least - margin(percent)) * (1 - 2.0**-BITS) + 2.0**-BITS
    lows, n_y, c_y, id_y = np.stack(y["low"].to_numpy()).view(np.uint64), y["n"].to_numpy(), y["component"].to_numpy(), y["node"].to_numpy()
    codes = [np.frombuffer(c, dtype=np.uint16) for c in y["codes"]]
    for low, n, c, node, mine in zip(x["low"], x["n"], x["component"], x["node"], x["codes"], strict=True):
        d = lows ^ np.asarray(low).view(np.uint64)[None, :]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        equal = 1 - np.bitwise_count(d & ones).sum(axis=1, dtype=np.int64) / minima
        ok = np.flatnonzero((equal >= need) & (c_y != c) & (100 * np.minimum(n_y, n) >= percent * np.maximum(n_y, n)))
        if not len(ok):
            continue
        have = np.zeros(1 << 16, dtype=bool)
        have[np.frombuffer(mine, dtype=np.uint16)] = True
        ends = np.cumsum([len(codes[i]) for i in ok])
        both = np.add.reduceat(have[np.concatenate([codes[i] for i in ok])].astype(np.int64), np.concatenate(([0], ends[:-1])))
        # Whole sets stand behind the codes: codes that are equal by chance only raise the number that is shared, so that no pair is lost.
        good = both * (1 + least) >= least * (n + n_y[ok]) * (1 - 1e-9)
        out.extend((max(node, o), min(node, o)) for o in id_y[ok[good]].tolist())


def cross_candidates(rest: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) inside a bucket whose members lie in different components, found block by block.

    ``rest``: bucket, node, component, main (the bucket's largest component), n, low, codes. Members outside the
    main component meet each other and the main ones; both kinds are dealt into blocks of about ``BLOCK`` rows.
    A cell pairs one block with one other; cells are sorted together in their partition and compared one
    after the other, first by packed bits, then by 16-bit codes of all members of the sets, so that few pairs leave a cell.
    """
    rest = rest.withColumn("minor", (F.col("component") != F.col("main")).cast("int"))
    sizes = rest.groupBy("bucket").agg(F.ceil(F.sum("minor") / BLOCK).alias("minors"), F.ceil(F.sum(1 - F.col("minor")) / BLOCK).alias("mains"))
    rest = salted(sizes, rest, ["bucket"])
    block = F.pmod(F.xxhash64("node"), F.when(F.col("minor") == 1, F.col("minors")).otherwise(F.col("mains")))
    rest = rest.withColumn("block", block)
    # Cells (i, j): minor block i against minor block j >= i, or against main block j - minors.
    spot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    is_minor, zero, last = F.col("minor") == 1, F.lit(0).cast("long"), F.col("minors") + F.col("mains") - 1
    as_row = F.transform(F.sequence("block", last), lambda j: spot(F.col("block"), j, 0))
    as_column = F.transform(F.sequence(zero, F.when(is_minor, F.col("block")).otherwise(F.col("minors") - 1)), lambda i: spot(i, F.when(is_minor, F.col("block")).otherwise(F.col("minors") + F.col("block")), 1))
    cells = rest.withColumn("cell", F.explode(F.when(is_minor, F.concat(as_row, as_column)).otherwise(as_column)))
    cells = cells.select("bucket", "cell.*", "node", "component", "n", "low", "codes")
    names = ["bucket", "i", "j"]
    cells = cells.repartition(partitions(cells.sparkSession), *names).sortWithinPartitions(*names)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for rows in itertools.chain(batches, [None]):
            if rows is not None:
                held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if held is None or not len(held):
                continue
            keys = held[names].to_numpy()
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(held))
            if rows is not None:  # the last cell may go on in the next batch
                starts, ends, rest_at = starts[:-1], ends[:-1], starts[-1]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts, ends, strict=True):
                cell = held.iloc[s:e]
                side = cell["side"].to_numpy()
                if side.any() and not side.all():
                    _compare_cell(cell[side == 0], cell[side == 1], percent, out)
            held = held.iloc[rest_at:] if rows is not None else None
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    return cells.mapInPandas(compare, "a long, b long").distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group; of rows with one id and group the first by text.

    Groups are of similarity ``percent`` or more on five-word shingles. Of repeated rows of one id and text one stays, the same in every run;
    rows of one id and several texts are one document and stay or go together. Rows of null id are kept, each by
    itself; null texts and texts without words are in no group and stay. An empty table gives an empty result. The
    columns are those of ``df``, whatever they are called.
    """
    found = near_duplicates(df.filter(F.col(id_col).isNotNull()), id_col, text, percent=percent)
    losers = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    rows = df.join(losers, id_col, "left_anti").select(df.columns)
    once = Window.partitionBy(id_col, F.xxhash64(text)).orderBy(text, F.xxhash64(*df.columns))
    alone = rows.filter(F.col(id_col).isNull())
    return rows.filter(F.col(id_col).isNotNull()).withColumn("__nth", F.row_number().over(once)).filter("__nth = 1").drop("__nth").union(alone)
