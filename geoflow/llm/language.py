"""Language identification with string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Length of the presence vectors that n-grams of 1 to ORDERS characters are hashed to.
WIDTH, ORDERS = 1 << 15, 4
#: Labelled documents of each language that are learned from, and landmarks among them.
TRAIN, LANDMARKS = 300, 16
#: Labelled documents and landmarks of all languages together, at most: with more than 40 languages each has fewer.
TRAIN_ALL, LANDMARKS_ALL = 12_000, 1_600
#: Labelled documents unpacked at a time.
FIT_BLOCK = 512
RIDGE = 1e-2
#: Different values of the language column up to which a model is fitted; above, ``train`` raises an error.
MOST_LANGUAGES = 400
#: A language's bound of resemblance: this share of what all but one in a hundred of its labelled documents reach.
BOUND_SHARE, BOUND_QUANTILE = 0.5, 0.01
#: Documents and code points of one matrix product.
BLOCK, BLOCK_CHARS = 64, 400_000


def presence(texts: list[str]) -> np.ndarray:
    """Which hashed n-grams each whole text holds: one row for each, lower-cased, 1 to ORDERS characters."""
    out = np.zeros((len(texts), WIDTH), dtype=bool)
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(low)), [len(t) for t in low])
    at = np.zeros(len(codes), dtype=np.uint64)
    for k in range(ORDERS):
        n = len(codes) - k
        if n <= 0:
            break
        at = at[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[k:] + np.uint64(k + 1)
        whole = row[:n] == row[k:]
        out[row[:n][whole], ((at * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)[whole]] = True
    return out


@dataclass
class Model:
    """Landmarks as packed presence bits, for each the weight of each language and its own, and each language's bound of resemblance."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    owners: np.ndarray
    bounds: np.ndarray


def overlap(x: np.ndarray, z: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
    """Shared n-grams over the smaller of both numbers, so that short and very long texts are not put at a disadvantage."""
    return (x @ z.T if both is None else both) / np.maximum(np.minimum(x.sum(1)[:, None], z.sum(1)[None, :]), 1)


def nearest(overlaps: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Each row's largest overlap with a landmark of each language."""
    out = np.zeros((len(overlaps), n))
    for k in range(n):
        out[:, k] = overlaps[:, owners == k].max(1, initial=0)
    return out


def bounds_of(unpacked: Callable[[np.ndarray], np.ndarray], label: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Each language's bound, from its labelled rows' overlap with its landmarks other than themselves.

    A language of one row has nothing to compare and takes the least bound of the others; 0 if there is none.
    """
    out = np.full(n, np.nan)
    for k in range(n):
        rows, marks = np.flatnonzero(label == k), chosen[label[chosen] == k]
        if len(rows) > 1:
            found = np.where(rows[:, None] == marks[None, :], -1, overlap(unpacked(rows), unpacked(marks))).max(1)
            found = found[found >= 0]
            out[k] = BOUND_SHARE * np.quantile(found, BOUND_QUANTILE)
    return np.nan_to_num(out, nan=np.nanmin(out) if (~np.isnan(out)).any() else 0.0)


def kernel(x: np.ndarray, z: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
    """Shared n-grams over the geometric mean of both numbers, as one matrix product."""
    return (x @ z.T if both is None else both) / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(z.sum(1), 1)[None, :])


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """One-versus-rest kernel ridge regression on (language, packed presence); landmarks are taken evenly.

    Rows stay packed, 4 KB each, but for ``FIT_BLOCK`` of them at a time.
    """
    languages = sorted({lang for lang, _ in rows})
    rows = sorted(rows)
    packed = np.stack([np.frombuffer(b, dtype=np.uint8) for _, b in rows])
    unpacked = lambda at: np.unpackbits(packed[at], axis=1).astype(np.float32)
    label = np.array([languages.index(lang) for lang, _ in rows])
    landmarks = max(1, min(LANDMARKS, LANDMARKS_ALL // len(languages)))
    chosen = np.concatenate([(at := np.flatnonzero(label == k))[np.linspace(0, len(at) - 1, min(landmarks, len(at))).astype(int)] for k in range(len(languages))])
    z = unpacked(chosen)
    value, vector = np.linalg.eigh(kernel(z, z).astype(np.float64))
    kept = value > 1e-6 * value.max()
    root = vector[:, kept] / np.sqrt(value[kept])
    mapped = np.concatenate([kernel(unpacked(slice(i, i + FIT_BLOCK)), z) @ root for i in range(0, len(packed), FIT_BLOCK)])
    phi = np.c_[mapped, np.ones(len(mapped))]
    share = 1 / np.bincount(label)[label]  # each language weighs the same
    target = np.where(label[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    gram = phi.T @ (phi * share[:, None]) + RIDGE / len(phi) * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, phi.T @ (target * share[:, None]))
    return Model(languages, np.packbits(z.astype(bool), axis=1), np.r_[root @ solved[:-1], solved[-1:]].astype(np.float32), label[chosen], bounds_of(unpacked, label, chosen, len(languages)))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, a score in (0, 1), the soft-max share of its margin, and its resemblance.

    Resemblance is the largest overlap with a language's landmarks, over that language's bound: below 1 a text is
    unlike labelled documents of every language. A further language can raise it but never lower it.
    """
    z = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
    names, scores, alike = [], [], []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < BLOCK and (size == 0 or size + len(texts[j]) <= BLOCK_CHARS):
            size += len(texts[j])
            j += 1
        part = texts[i:j]
        x = presence(part).astype(np.float32)
        both = x @ z.T
        margins = np.c_[kernel(x, z, both), np.ones(len(part), dtype=np.float32)] @ model.weights
        like = nearest(overlap(x, z, both), model.owners, len(model.languages))
        like = np.where(model.bounds > 0, like / np.where(model.bounds > 0, model.bounds, 1), np.inf).max(1)
        share = np.exp(3 * (margins - margins.max(1, keepdims=True)))
        best = margins.argmax(1)
        found = share[np.arange(len(part)), best] / share.sum(1)
        for t, k, s, r in zip(part, best, found, like, strict=True):
            spoken = any(map(str.isalpha, t))
            names.append(model.languages[k] if spoken else "und")
            scores.append(float(s) if spoken else 0.0)
            alike.append(float(r) if spoken else 0.0)
        i = j
    return names, np.array(scores), np.array(alike)


def train(df: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Fit on about ``TRAIN`` documents of each language among the ``allowed`` rows with text and language.

    All rows are counted; those of least hash are taken, evenly for each language, so that rows' order plays no
    part; with many languages fewer of each, about ``TRAIN_ALL`` in all. What comes to the driver is ``WIDTH`` bits
    a document. None if there is nothing to learn from. More than ``MOST_LANGUAGES`` languages are an error: none is
    left out in silence. Repeated rows are taken or left together; other columns are not looked at.
    """
    small_batches(df.sparkSession)
    rows = df.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"column {lang} has more than {MOST_LANGUAGES} different values; clean it or raise language.MOST_LANGUAGES")
    if not counts:
        return None
    each = min(TRAIN, TRAIN_ALL // len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(1.0 if r[1] <= each else each / r[1]))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("train"), key, text), F.lit(1 << 40)) / float(1 << 40) < F.coalesce(share[F.col(lang)], F.lit(0.0)))

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence([t])[0]).tobytes() for t in texts])

    found = chosen.select(F.col(lang), bits(text).alias("bits")).collect()
    return fit([(r[0], bytes(r[1])) for r in found]) if found else None


def with_language(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; null texts and texts without letters are 'und' with score 0.

    Row-wise; ids and labels are not looked at. Without a model every row is 'und'. Columns of these names are replaced.
    """
    small_batches(df.sparkSession)
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    rows = _predicted(df.drop("lang_pred", "score"), model, text)
    return rows.select(*[c for c in rows.columns if c != "__found"], "__found.lang_pred", "__found.score")


def spoken_rows(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has letters and resembles a language of the model (see ``predict``).

    Neither the languages' number nor the text's length decides. Null texts and texts without letters go; without a
    model all texts with letters stay. Repeated rows are treated alike; the columns are those of ``df``, whatever they
    are called; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    if model is None:
        return df.filter(F.col(text).rlike(r"\p{L}"))
    found = _predicted(df, model, text).filter((F.col("__found.lang_pred") != "und") & (F.col("__found.resemblance") >= 1))
    return found.drop("__found")


def _predicted(df: DataFrame, model: Model, text: str) -> DataFrame:
    """``df`` with what ``predict`` finds as the struct ``__found``."""

    @F.pandas_udf("lang_pred string, score double, resemblance double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, alike = predict(model, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores, "resemblance": alike})

    return df.withColumn("__found", found(F.coalesce(F.col(text), F.lit(""))))
