"""Benchmark decontamination with a generalised suffix automaton of test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import pin
from .common import small_batches

#: Words of test items in one automaton; larger benchmarks are dealt into several, run one after the other.
AUTOMATON_WORDS = 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of ASCII letters, digits and all non-ASCII characters."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class ItemAutomaton:
    """Suffix automaton over the words of many items; finds where a text repeats ``window`` item words in a row.

    An item of fewer words, but not none, counts as a window by itself.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = 10) -> None:
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        read = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                read.append((name, ids))
                last = 0
                for x in ids:
                    last = self._extend(last, x)
        self.shortest = min((min(window, len(ids)) for _, ids in read), default=window)
        self.owners: dict[int, set[str | None]] = {}  # of the state that holds a whole window
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in read:
            need, state, size = min(window, len(ids)), 0, 0
            for x in ids:
                state = self.step[state][x]
                size += 1
                if size >= need:
                    at = self._holding(state, need)
                    if need < window:
                        self.short.setdefault(at, []).append((need, name))
                    else:
                        self.owners.setdefault(at, set()).add(name)

    def _extend(self, last: int, x: int) -> int:
        """Add a word after state ``last``, which may have been made by another item."""
        step, link, length = self.step, self.link, self.length
        known = step[last].get(x)
        if known is not None and length[known] == length[last] + 1:
            return known
        new = -1
        if known is None:
            new = self._state({}, -1, length[last] + 1)
            at = last
            while at >= 0 and x not in step[at]:
                step[at][x] = new
                at = link[at]
            if at < 0:
                link[new] = 0
                return new
            known = step[at][x]
            if length[known] == length[at] + 1:
                link[new] = known
                return new
        else:
            at = last
        split = self._state(dict(step[known]), link[known], length[at] + 1)
        link[known] = split
        while at >= 0 and step[at].get(x) == known:
            step[at][x] = split
            at = link[at]
        if new < 0:
            return split
        link[new] = split
        return new

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _holding(self, state: int, n: int) -> int:
        """The state on the suffix chain that holds the last ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans of hit words (first and last index) and the names of the items found."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, -1) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        step, link, length, window = self.step, self.link, self.length, self.window
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if stop - start < self.shortest:
                continue
            state, size = 0, 0
            for i, x in enumerate(ids[start:stop].tolist(), start):
                while state and x not in step[state]:
                    state = link[state]
                    size = length[state]
                to = step[state].get(x)
                if to is None:
                    continue
                state, size = to, size + 1
                reach = 0
                if size >= window:
                    reach = size
                    items |= self.owners[self._holding(state, window)]
                if self.short:
                    at = state
                    while at > 0:
                        for n, name in self.short.get(at, ()):
                            if n <= size:
                                items.add(name)
                                reach = max(reach, n)
                        at = link[at]
                if reach:
                    first = i - reach + 1
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i))
        return spans, items


_automata: dict[bytes, ItemAutomaton] = {}


def automaton_of(held: list[tuple[str | None, str]], window: int) -> ItemAutomaton:
    """The automaton of these items; a worker process keeps the last one, so that its tasks share it."""
    key = hashlib.sha256(repr((window, held)).encode("utf-8", "surrogatepass")).digest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = ItemAutomaton(held, window)
    return _automata[key]


def _bounded_items(items: DataFrame, window: int, most: int) -> DataFrame:
    """(name, words, n): items of more than ``most`` words are cut into parts that overlap by all but one word of a window."""

    @F.pandas_udf("array<struct<words:string,n:long>>")
    def parts(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = words_of(t)
            if len(words) <= most:
                out.append([{"words": t, "n": len(words)}])
            else:
                cut = [words[i : i + most] for i in range(0, len(words) - window + 1, most - window + 1)]
                out.append([{"words": b" ".join(w).decode("utf-8", "surrogatepass"), "n": len(w)} for w in cut])
        return pd.Series(out)

    return items.select("name", F.explode_outer(parts("words")).alias("p")).select("name", "p.words", "p.n").filter("n > 0")


def with_hits(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, name: str = "hits") -> DataFrame:
    """Add ``name``: struct of n_words, spans of hit words and the ids of the items found, sorted as strings.

    The items are measured first; each part of them of about ``AUTOMATON_WORDS`` words at most goes to the workers,
    which build its automaton and stream whole texts through it. Only one part is in memory at a time; a longer item
    is cut into overlapping parts, so that no window is lost. Null or empty texts and items have no words; items
    of equal text or id are all found; an item of null id hits words like any other but has no id to be named by,
    so that it is not among the items found; an empty table of items hits nothing. A column called ``name`` is
    replaced, all others are carried along.
    """
    small_batches(df.sparkSession)
    df = df.drop(name)
    items = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("words")).filter("words is not null")
    items = pin(_bounded_items(items, window, max(window, AUTOMATON_WORDS // 2)))
    size = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * size // AUTOMATON_WORDS))

    def searched(rows: DataFrame, part: int) -> DataFrame:
        here = items.filter(F.pmod(F.xxhash64("name", "words"), F.lit(parts)) == part) if parts > 1 else items
        held = sorted(((r.name, r.words) for r in here.select(F.col("name"), "words").collect()), key=repr)  # at most about AUTOMATON_WORDS words

        @F.pandas_udf(HITS)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            automaton = automaton_of(held, window)
            for texts in batches:
                out = []
                for t in texts:
                    words = words_of(t)
                    spans, names = automaton.search(words)
                    out.append((len(words), spans, sorted(names - {None})))
                yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

        # Called nondeterministic so that a filter on its result does not run it a second time.
        return rows.withColumn(name, find.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))

    if parts == 1:
        return searched(df, 0)
    rows = pin(df.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for part in range(parts):
        one = searched(rows.select("__row", text), part).select("__row", name)
        found = one if found is None else found.union(one)

    @F.pandas_udf(HITS)
    def merged(several: pd.Series) -> pd.DataFrame:
        out = []
        for hits in several:
            spans: list[tuple[int, int]] = []
            for first, last in sorted((s["first"], s["last"]) for h in hits for s in h["spans"]):
                if spans and first <= spans[-1][1] + 1:
                    spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
                else:
                    spans.append((first, last))
            out.append((hits[0]["n_words"], spans, sorted({i for h in hits for i in h["items"]})))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    found = found.groupBy("__row").agg(F.collect_list(name).alias("several")).select("__row", merged("several").alias(name))
    return rows.join(found, "__row").drop("__row")


def n_hit(name: str = "hits") -> F.Column:
    """Hit words of a row of ``with_hits``."""
    return F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def cleaned(df: DataFrame, items: DataFrame, text: str = "text", most_cover: float = 0.5) -> DataFrame:
    """Cut hit spans out of each text; rows of which more than ``most_cover`` of the words are hit are dropped.

    Texts without a hit stay as they are, null ones too. The columns are those of ``df``, whatever they are called;
    repeated rows are treated alike; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans, strict=True):
            if t is not None and found is not None and len(found):
                raw = t.encode("utf-8", "surrogatepass")
                places = [m.span() for m in WORD.finditer(raw.lower())]
                at, kept = 0, []
                for s in found:
                    kept.append(raw[at : places[s["first"]][0]])
                    at = places[s["last"]][1]
                t = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out)

    rows = with_hits(df, items, text, name="__hits").filter(n_hit("__hits") <= most_cover * F.col("__hits.n_words"))
    return rows.withColumn(text, cut(text, "__hits.spans")).select(*df.columns)
