"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import pin
from .common import small_batches

#: Confirmed toxic and unlabelled documents that are learned from, at most.
POSITIVE, UNLABELLED = 3000, 6000
#: Hashed features, and how many of them the classifier uses.
SPACE, FEATURES = 1 << 20, 768
WORD = re.compile(r"\w+")


def features_of(word: str) -> set[int]:
    """Hashed features of a lower-cased word: the word and its beginnings of 3 to 8 characters."""
    return {zlib.crc32(f"{word}$".encode("utf-8", "surrogatepass")) % SPACE, *(zlib.crc32(word[:k].encode("utf-8", "surrogatepass")) % SPACE for k in range(3, min(8, len(word)) + 1))}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _one_of_each(df: DataFrame, text: str, key: str, positive: int) -> DataFrame:
    """(text, positive): one text for each id, however many rows share it."""
    return df.groupBy(key).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text")).select("text", F.lit(positive).alias("positive"))


def sampled(pool: DataFrame, marked: DataFrame, text: str, key: str, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> DataFrame:
    """(text, positive): what is learned from, written once to the shared folder.

    Positives are the ``positive`` toxic ids of least hash; being so few, they are broadcast to the documents, so
    that no text is shuffled to find them. Unlabelled rows are a share of the ids, about ``unlabelled`` of them.
    """
    ids = marked.filter("toxic = 1").orderBy(F.xxhash64(F.lit("toxic"), key), key).limit(positive).select(key)
    share = unlabelled / max(pool.count(), unlabelled)
    some = pool.filter(F.pmod(F.xxhash64(F.lit("unlabelled"), key), F.lit(1 << 40)) / float(1 << 40) < share)
    return pin(_one_of_each(pool.join(F.broadcast(ids), key, "left_semi"), text, key, 1).union(_one_of_each(some, text, key, 0)))


@dataclass
class Model:
    """Hashed feature -> column; weights of presence and of rate for each column; bias."""

    column: dict[int, int]
    presence: np.ndarray
    rate: np.ndarray
    bias: float


def vectors(texts: list[str], column: dict[int, int], memo: dict[str, tuple[int, ...]]) -> Iterator[tuple[int, Counter]]:
    """Number of words and, for each chosen feature, of words with it."""
    for t in texts:
        words = words_of(t)
        if len(memo) > 300_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = tuple(column[f] for f in features_of(w) if f in column)
        found: Counter = Counter()
        for cols in filter(None, map(memo.__getitem__, words)):
            found.update(cols)
        yield len(words), found


def _shape(n_words: int, found: Counter) -> tuple[list[int], np.ndarray, np.ndarray]:
    count = np.fromiter(found.values(), dtype=np.float64, count=len(found))
    return list(found), np.log1p(count), np.log1p(100 * count / max(n_words, 20))


def risk_gradient(w: np.ndarray, b: float, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk of positives, risk of negatives, slopes by w, slope by b) of the non-negative risk estimator, logistic loss.

    Risk: prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]). Where the second term is negative, the
    slopes are those that lead it back up, as positives would else be fitted as negatives without end.
    """
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    fp, fu = positive @ w + b, unlabelled @ w + b
    plus = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    p_plus, p_minus, u_minus = -prior * (1 - sigmoid(fp)) / len(fp), prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
    gp, gu = (p_plus - p_minus, u_minus) if negative >= 0 else (p_minus, -u_minus)
    return plus, negative, positive.T @ gp + unlabelled.T @ gu, gp.sum() + gu.sum()


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Linear logistic classifier by the non-negative risk estimator, with adaptive steps along its slopes."""
    w, b = np.zeros(positive.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        _, _, by_w, by_b = risk_gradient(w, b, positive, unlabelled, prior)
        g = np.append(by_w + decay * w, by_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(
    df: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", key: str = "doc_id", positive: int = POSITIVE, unlabelled: int = UNLABELLED, features: int = FEATURES
) -> Model | None:
    """Learn from ``allowed`` rows: confirmed toxic ones (label 1) and unlabelled ones of the whole table.

    The class prior is the share of toxic rows among the allowed labelled ones. At most ``positive`` and about
    ``unlabelled`` documents are taken; the ``features`` that set them apart best are counted in parallel. None if no
    toxic row is known. An id counts as toxic if any label of it says so; null ids and labels are left out; of
    several texts of an id the least is taken; other columns are not looked at.
    """
    small_batches(df.sparkSession)
    marked = labels.filter(allowed & F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    n_labelled, n_toxic = marked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n_toxic:
        return None
    sample = sampled(df.filter(allowed).select(key, text), marked, text, key, positive, unlabelled)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, memo = np.zeros((2, SPACE), dtype=np.int32), {}
        n = np.zeros(2, dtype=np.int64)
        for rows in batches:
            for t, p in zip(rows["text"], rows["positive"], strict=True):
                if len(memo) > 200_000:
                    memo.clear()
                present: set[int] = set()
                for w in set(words_of(t)):
                    if w not in memo:
                        memo[w] = features_of(w)
                    present |= memo[w]
                seen[p, list(present)] += 1
                n[p] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"feature": at, "n1": seen[1, at], "n0": seen[0, at]})
        yield pd.DataFrame({"feature": [-1], "n1": [n[1]], "n0": [n[0]]})

    counts = sample.mapInPandas(counted, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).persist()
    n1, n0 = counts.filter("feature = -1").select("n1", "n0").first()
    if not n1 or not n0:
        return None
    p1, p0 = F.col("n1") / n1, F.col("n0") / n0
    both = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-6)) * (1 / n1 + 1 / n0) + 1e-9)
    best = counts.filter("feature >= 0 and n1 + n0 >= 4").orderBy(z.desc(), "feature").limit(features).collect()
    counts.unpersist()
    column = {r["feature"]: i for i, r in enumerate(best)}

    @F.pandas_udf("cols array<int>, presence array<double>, rate array<double>")
    def shaped(texts: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        return pd.DataFrame([_shape(n, c) for n, c in vectors(texts.tolist(), column, memo)], columns=["cols", "presence", "rate"])

    rows = sample.select("positive", shaped("text").alias("x")).select("positive", "x.*").collect()
    x = np.zeros((len(rows), 2 * len(column)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["cols"]] = r["presence"]
        x[i, [c + len(column) for c in r["cols"]]] = r["rate"]
    is_p = np.array([r["positive"] == 1 for r in rows])
    w, b = fit(x[is_p], x[~is_p], min(0.9, max(1e-3, n_toxic / n_labelled)))
    return Model(column, w[: len(column)], w[len(column) :], b)


def with_toxicity(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name``: 0 to 1, higher where label 1 is likelier; null and empty texts get the score of no features.

    Row-wise over whole texts; without a model the score is 0. A column of this name is replaced, all others are
    carried along, whatever they are called; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    if model is None:
        return df.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for texts in batches:
            out = []
            for n, found in vectors(texts.tolist(), model.column, memo):
                cols, presence, rate = _shape(n, found)
                f = model.bias + float(presence @ model.presence[cols] + rate @ model.rate[cols])
                out.append(1 / (1 + np.exp(-np.clip(f, -40, 40))))
            yield pd.Series(out, dtype="float64")

    return df.withColumn(name, score(F.coalesce(F.col(text), F.lit(""))))
