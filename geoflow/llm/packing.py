"""Best-fit packing of tokenized documents into sequences by bin completion."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import gapless_rank
from ..functions.tables import pin
from .common import small_batches
from .tokencount import byte_of_char

PIECE = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


#: Latin letters below U+0250 that lower-case to one letter below it, then marks of ASCII other than the apostrophe, or none.
LATIN = re.compile("([" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250") + "]+)([!-&(-/:-@[-`{-~]*)").fullmatch


#: Characters of the longest word that is remembered.
LONGEST = 64


class WordEncoder(dict):
    """Token ids of whole texts for a tokenizer that lower-cases and drops white space, one remembered word at a time.

    Pre-tokenization never joins what a blank or line feed divides, so that the ids of a text are those of its
    blank-separated parts in turn. A word of Latin letters with marks after it has the ids of its lower-case
    letters and then those of the marks; its letters are one piece, left to the library's merges. Other words go
    through the whole library. Each new word is looked up once; what is remembered is bounded.
    """

    def __init__(self, path: str, most: int = 150_000) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenize = self.tokenizer.model.tokenize
        self.shown = {b: c for c, b in byte_of_char().items()}
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}  # words of the generation before this one
        self.letters: dict[str, bytes] = {}

    def _library(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _of_letters(self, low: str) -> bytes:
        ids = self.letters.get(low)
        if ids is None:
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(self.shown)
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.tokenize(spelt)])
            if len(low) <= LONGEST:
                self.letters[low] = ids
        return ids

    def _of_marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = self._library(marks)
            if len(marks) <= LONGEST:
                self.marks[marks] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.earlier.get(word)
        if ids is None:
            found = LATIN(word)
            if found is None:
                ids = self._library(word)
            else:
                ids = self._of_letters(found[1].lower())
                if found[2]:
                    ids += self._of_marks(found[2])
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(self) > self.most:  # words that are still in use are taken over from the generation before
            self.earlier = dict(self)
            self.clear()
        if len(self.letters) > self.most:
            self.letters.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, shared by its tasks."""
    return WordEncoder(path)


def cut_into_pieces(df: DataFrame, path: str, capacity: int, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per piece of each document: piece, start, length, ids_crc32; other columns are carried along.

    A document's ids are those of its whole text (null: empty) and then ``end_id``; only documents longer than
    ``capacity`` are cut.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf(PIECE)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, end, width = encoder_of(path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for texts in batches:
            out = []
            for text in texts:
                ids = encoder.encode(text) + end
                out.append([{"piece": k // width, "start": k // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k in range(0, len(ids), width) for part in (ids[k : k + width],)])
            yield pd.Series(out)

    names = ("piece", "start", "length", "ids_crc32")
    kept = [c for c in df.columns if c not in names]
    rows = df.withColumn("__pieces", pieces(F.coalesce(F.col(text), F.lit(""))))
    # Outer, though each document has a piece: of a plain explode Spark derives a filter, for which it would run the function a second time.
    rows = rows.select(*[c for c in kept if c != text], F.explode_outer("__pieces").alias("__p"))
    return rows.select(*[c for c in kept if c != text], *[F.col(f"__p.{n}").alias(n) for n in names])


# The plan: it sees only how many pieces there are of each length, at most ``capacity`` numbers.
Fill = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs: the larger of the volume bound and the bounds that set aside pieces under k."""
    size = np.arange(capacity + 1)
    volume = int((counts * size).sum())
    best = -(-volume // capacity)
    upto = np.concatenate(([0], np.cumsum(counts)))  # pieces shorter than i
    weight = np.concatenate(([0], np.cumsum(counts * size)))
    for k in range(capacity // 2 + 1):
        large = upto[capacity + 1] - upto[capacity - k + 1]
        half = capacity // 2
        middle = upto[capacity - k + 1] - upto[half + 1]
        room = int(middle * capacity - (weight[capacity - k + 1] - weight[half + 1]))
        small = int(weight[half + 1] - weight[k])
        best = max(best, int(large + middle + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Fill, int]]:
    """Best-fit decreasing over the counts: equal bins are handled together."""
    bins: dict[int, dict[Fill, int]] = {}  # by free room
    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        while n:
            room = min((r for r in bins if r >= s), default=None)
            if room is None:
                each = capacity // s
                kinds = [((), each, n // each), ((), n % each, 1)]
                room = capacity
                n = 0
            else:
                fill, number = bins[room].popitem()
                each = room // s
                full = min(number, n // each)
                kinds = [(fill, each, full)]
                n -= full * each
                if full < number and 0 < n < each:
                    kinds.append((fill, n, 1))
                    full, n = full + 1, 0
                if full < number:
                    bins[room][fill] = number - full
                if not bins[room]:
                    del bins[room]
            for fill, k, number in kinds:
                if k and number:
                    grown = bins.setdefault(room - k * s, {})
                    grown[(*fill, (s, k))] = grown.get((*fill, (s, k)), 0) + number
    return [x for kinds in bins.values() for x in kinds.items()]


def completions(room: int, left: np.ndarray, most_waste: int, tries: int = 400, keep: int = 24) -> list[tuple[int, Fill]]:
    """Undominated fillings of ``room``, least waste first, each as (waste, filling).

    A filling is dominated if a piece that it does not hold could replace some of its pieces of no greater sum
    and still fit. A single piece that fills the room exactly dominates all. ``tries`` and ``keep`` bound the search.
    """
    if room == 0:
        return [(0, ())]
    if left[room]:
        return [(0, ((room, 1),))]
    sizes = np.flatnonzero(left[: room + 1])[::-1].tolist()
    if not sizes:
        return [(room, ())]
    found: list[tuple[int, Fill]] = []
    budget = [tries]

    def undominated(fill: Fill, waste: int) -> bool:
        if not waste:
            return True
        others = left.copy()
        for s, k in fill:
            others[s] -= k
        sums = 1  # bit t: some pieces of the filling add up to t
        for s, k in fill:
            for _ in range(k):
                sums |= sums << s
        longer = int.from_bytes(np.packbits(others[: room + waste + 1] > 0, bitorder="little").tobytes(), "little")
        longer &= ~1
        return not any(longer & (sums << w) for w in range(1, waste + 1))  # a sum of t could be one piece of up to waste more

    def grow(at: int, space: int, fill: Fill) -> None:
        budget[0] -= 1
        while at < len(sizes) and sizes[at] > space:
            at += 1
        if at == len(sizes) or space == 0:
            if space <= most_waste and undominated(fill, space):
                found.append((space, fill))
            return
        for i in range(at, len(sizes)):
            if budget[0] <= 0 or len(found) >= 4 * keep or found and found[-1][0] == 0 and len(found) >= keep:
                return
            s = sizes[i]
            for k in range(min(int(left[s]), space // s), 0, -1):
                grow(i + 1, space - k * s, (*fill, (s, k)))
                if budget[0] <= 0:
                    break

    grow(0, room, ())
    return sorted(set(found), key=lambda x: (x[0], tuple(-s for s, _ in x[1])))[:keep]


def plan(counts: np.ndarray, capacity: int, nodes: int = 1000) -> list[tuple[Fill, int]]:
    """Fillings and how many sequences get each, by bin completion.

    The longest piece left is completed by an undominated filling, used as often as the counts allow; branches
    whose waste exceeds what the best packing so far leaves are cut, and depth-first search goes on until the
    lower bound is met or ``nodes`` are spent. The first incumbent is best-fit decreasing, and each branch's
    rest is also closed by it to find better incumbents.
    """
    counts = counts.astype(np.int64)
    size, volume = np.arange(capacity + 1), int((counts * np.arange(capacity + 1)).sum())
    least, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    n_best = sum(k for _, k in best)
    whole = [(((capacity, 1),), int(counts[capacity]))] if counts[capacity] else []
    counts = counts.copy()
    counts[capacity] = 0
    n_whole = sum(k for _, k in whole)
    spent = 0
    # Each entry: counts left, sequences used, waste so far, fillings chosen, completions not yet tried.
    stack = [[counts, n_whole, 0, None, None]]
    chosen: list[tuple[Fill, int]] = []
    while stack and n_best > least and spent < nodes:
        left, used, waste, fill, options = stack[-1]
        if options is None:
            spent += 1
            present = np.flatnonzero(left)
            if not len(present):
                if used < n_best:
                    best, n_best = [*whole, *(x[3] for x in stack if x[3])], used
                stack[-1][4] = []
                continue
            most = (n_best - 1) * capacity - volume - waste  # waste that a better packing may still have
            if most < 0:
                stack[-1][4] = []
                continue
            if spent % 64 == 1 or len(present) < 40:
                rest = best_fit(left, capacity)
                if used + sum(k for _, k in rest) < n_best:
                    best, n_best = [*whole, *(x[3] for x in stack if x[3]), *rest], used + sum(k for _, k in rest)
                    continue
            long = int(present[-1])
            left[long] -= 1
            stack[-1][4] = [(w, long, f) for w, f in completions(capacity - long, left, most)][::-1]
            left[long] += 1
            continue
        if not options:
            stack.pop()
            continue
        w, long, f = options.pop()
        need = dict(f)
        need[long] = need.get(long, 0) + 1
        times = min(int(left[s]) // k for s, k in need.items())
        most = (n_best - 1) * capacity - volume - waste
        if w:
            times = min(times, most // w)
        if times <= 0:
            continue
        after = left.copy()
        for s, k in need.items():
            after[s] -= times * k
        stack.append([after, used + times, waste + times * w, (tuple(sorted(need.items(), reverse=True)), times), None])
    return best


def segments(fills: list[tuple[Fill, int]]) -> pd.DataFrame:
    """Which ranks of each length go where: rank r of ``length`` from ``first`` on lies in sequence base + (r - first) // each."""
    rows, seen, base = [], {}, 0
    for fill, number in fills:
        offset = 0
        for s, k in fill:
            first = seen.get(s, 0)
            rows.append((s, first, base, offset, k))
            seen[s] = first + number * k
            offset += s * k
        base += number
    return pd.DataFrame(rows, columns=["length", "first", "base", "offset", "each"]).sort_values(["length", "first"])


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Give each piece (1 <= length <= capacity) a sequence_id and an offset; sequences are filled gapless from 0.

    Only the number of pieces of each length goes to the driver (``capacity`` numbers at most, whatever the
    input); the plan that comes back names ranks of lengths, at most a few rows for each distinct length in each
    filling. Ranks are given in parallel, also inside a length that a third of all pieces share. Rows with
    equal ``order`` values are packed as separate rows; an empty table gives an empty result.
    """
    pieces = pin(pieces.drop("sequence_id", "offset").withColumn("__id", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    where = segments(plan(counts, capacity))
    span = np.int64(1) << 44
    key = where["length"].to_numpy(np.int64) * span + where["first"].to_numpy(np.int64)
    first, base, start, each = (where[c].to_numpy(np.int64) for c in ("first", "base", "offset", "each"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        ahead = rank.to_numpy() - first[at]
        return pd.DataFrame({"sequence_id": base[at] + ahead // each[at], "offset": start[at] + ahead % each[at] * length.to_numpy()})

    ranked = gapless_rank(pieces, ["length"], [F.xxhash64(*order, "__id"), F.col("__id")], "__nth").drop("__id")
    placed = ranked.withColumn("__place", place("length", "__nth"))
    return placed.select(*[c for c in ranked.columns if c != "__nth"], F.col("__place.sequence_id").alias("sequence_id"), F.col("__place.offset").alias("offset"))
