"""Compression of vectors to codes, one byte for each part, with an equal-average search for the nearest entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import pin

#: Parts of a vector, entries of a codebook, rounds, and by what components are multiplied before they are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components lie within this, so that squared distances of up to 128 components fit 64 bits.
LARGEST = 1 << 27
#: Parts that the rows of one label are dealt into where they meet the sums by label.
SALTS = 32
#: Vectors whose nearest entries are sought at a time.
STRIP = 8192


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row; of equally near ones the lowest index.

    By Cauchy and Schwarz the squared gap between two sums of d components is at most d times the squared distance.
    Entries are put in order of their sums; the search of a row begins where its own sum belongs and goes outward on
    both sides, until the squared gap over d strictly exceeds the best distance. All rows still searching step at once.
    """
    d = parts.shape[1]
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ordered, ahead = book[order], sums[order]
    own = parts.sum(axis=1)
    slack = 1 + 1e-12  # rounding may let the search go on where it could end, never end it early
    best, at = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(book), dtype=np.int64)
    start = np.searchsorted(ahead, own)
    for step, place in ((1, start.copy()), (-1, start - 1)):
        rows = np.arange(len(parts))
        while True:
            here = place[rows]
            inside = (here >= 0) & (here < len(book))
            rows, here = rows[inside], here[inside]
            gap = (ahead[here] - own[rows]).astype(np.float64)
            near = gap * gap <= d * slack * best[rows]
            rows, here = rows[near], here[near]
            if not len(rows):
                break
            apart = parts[rows] - ordered[here]
            far = np.einsum("ij,ij->i", apart, apart)
            name = order[here]
            better = (far < best[rows]) | (far == best[rows]) & (name < at[rows])
            best[rows[better]], at[rows[better]] = far[better], name[better]
            place[rows] += step
    return at, best


class NoVectors(ValueError):
    """Vectors that cannot be coded: lengths that differ or do not divide into parts, components out of range."""


def whole_components(vectors: pd.Series, dim: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, one row for each vector."""
    values = np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.zeros((0, dim))
    found = np.floor(values * scale)
    if np.abs(found).max(initial=0) > LARGEST:
        raise NoVectors(f"components over {LARGEST / scale:g} cannot be coded exactly")
    return found.astype(np.int64).reshape(len(vectors), parts, dim // parts)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null, infinite or NaN components."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.filter(x.isNotNull() & sound)


def first_codebooks(df: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """(parts, entries, d): the parts of the vectors of the least ids (null ids last, equal ids by their vectors); None for an empty table."""
    few = df.orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(entries).select(F.col(vector).alias("v")).toPandas()["v"]
    if not len(few):
        return None
    dim = len(few[0])
    if not dim or dim % parts or any(len(v) != dim for v in few):
        raise NoVectors(f"vectors need one length that {parts} divides")
    if df.filter(F.size(vector) != dim).limit(1).count():
        raise NoVectors("vectors of several lengths")
    return whole_components(few, dim, parts, scale).transpose(1, 0, 2)


def refined(df: DataFrame, vector: str, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floored mean of the parts that are nearest to it; unused ones stay.

    Every task sums its own parts first: parts * entries rows at most leave it, whatever the table's size.
    """
    parts, entries, d = books.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((parts, entries, d), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for k in range(0, len(batch), STRIP):
                vectors = whole_components(batch["v"][k : k + STRIP], parts * d, parts, scale)
                for p in range(parts):
                    at, _ = nearest(vectors[:, p], books[p])
                    total[p] += np.stack([np.bincount(at, weights=x, minlength=entries) for x in vectors[:, p].T], axis=1).astype(np.int64)  # exact: below 2**53
                    count[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(count)
        yield pd.DataFrame({"p": p, "e": e, "n": count[p, e], "s": list(total[p, e])})

    found = df.select(F.col(vector).alias("v")).mapInPandas(sums, "p int, e int, n long, s array<long>")
    found = found.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d)])
    books = books.copy()
    for r in found.collect():  # parts * entries rows at most
        books[r.p, r.e] = [r[3 + i] // r.n for i in range(d)]
    return books


def books_sha256(books: np.ndarray | None) -> str:
    """SHA-256 of all components as decimal integers with commas, by part, entry and place; of nothing for no codebooks."""
    return hashlib.sha256(b"" if books is None else ",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, components) over all usable vectors; None if there are none.

    The first ones are the parts of the vectors of the least ids. Vectors whose lengths differ or do not divide into ``parts``
    and components over ``LARGEST`` after scaling are an error. Only the codebooks, of a size that the parameters
    fix, reach the driver and the tasks.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    rows = usable(df, vector)
    books = first_codebooks(rows, key, vector, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        books = refined(rows, vector, books, scale)
    return books


def with_codes(df: DataFrame, books: np.ndarray | None, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Usable rows with code (two hex digits for each part) and error (squared distances, summed over the parts).

    Rows of unusable vectors go; repeated rows, null ids and further columns stay, columns of the new names are replaced.
    Without codebooks the result is empty.
    """
    rows = usable(df.drop("code", "error"), vector)
    if books is None:
        return rows.limit(0).select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    parts, _, d = books.shape

    @F.pandas_udf("code string, error long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, errors = [np.zeros((0, parts), dtype=np.uint8)], [np.zeros(0, dtype=np.int64)]
            for k in range(0, len(batch), STRIP):
                vectors = whole_components(batch[k : k + STRIP], parts * d, parts, scale)
                found = [nearest(vectors[:, p], books[p]) for p in range(parts)]
                codes.append(np.stack([at for at, _ in found], axis=1).astype(np.uint8))
                errors.append(sum(far for _, far in found))
            yield pd.DataFrame({"code": [bytes(c).hex() for c in np.concatenate(codes)], "error": np.concatenate(errors)})

    rows = rows.withColumn("__c", coded(F.col(vector)))
    return rows.select("*", F.col("__c.code").alias("code"), F.col("__c.error").alias("error")).drop("__c")


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add label_error: the errors of all rows of the same label, nulls together. A frequent label is summed before the shuffle and dealt out after it.

    ``coded`` is pinned first; give it no more columns than are needed. A column called label_error is replaced.
    """
    coded = pin(coded.drop("label_error"))
    by = F.to_json(F.struct(F.col(label).alias("l"))).alias("__label")
    total = coded.groupBy(by).agg(F.sum("error").alias("label_error")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("__label", by).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(total, ["__label", "__salt"]).drop("__label", "__salt")
