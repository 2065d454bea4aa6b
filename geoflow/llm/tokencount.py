"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic machines are run one after the other. The first reads character classes and marks where the
pre-tokenizer begins a new piece; it has 13 states, so that a chunk of text acts on it as a map from state to
state, the maps of all chunks are made at once and composed by a parallel prefix scan. The second reads the
bytes of a piece and carries, on each transition, by how much the number of emitted tokens changes; its states
are made when first met and kept in a bounded table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Character classes. T: s, t, m, d (one-letter contractions); the other letters of contractions have their own.
LETTER, T, R, V, LL, E, NUMBER, BLANK, SPACE, OTHER, QUOTE, STOP = range(12)
# States: what the open piece is. W1/W2: one or more white spaces, the last a blank (B) or another one (O);
# Q: a quote that may begin a contraction, QR, QV, QL: with its first letter; DONE: a whole contraction.
START, WORD, NUM, MARKS, W1B, W1O, W2B, W2O, Q, QR, QV, QL, DONE = range(13)
#: Emissions: a piece begins at this character, at the one before it.
HERE, BACK = 1, 2
CHUNK = 128
#: Code points that are run through the machines at a time.
STRIP = 1_000_000
#: Bytes at the start of a piece over which the machine's path is remembered as one step.
HEAD = 7
#: Characters of the longest piece that is remembered.
LONGEST = 64
#: The code points with Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def piece_machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, next state and emission for state x class."""
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = LETTER
        elif major == "N":
            kind[c] = NUMBER
    kind[WHITE], kind[32], kind[39] = SPACE, BLANK, QUOTE
    for letters, k in (("stmd", T), ("r", R), ("v", V), ("l", LL), ("e", E)):
        kind[[ord(x) for x in letters]] = k
    letters = (LETTER, T, R, V, LL, E)
    fresh = {**dict.fromkeys(letters, WORD), NUMBER: NUM, BLANK: W1B, SPACE: W1O, OTHER: MARKS, QUOTE: Q}
    step, emit = np.zeros((13, 12), dtype=np.uint8), np.zeros((13, 12), dtype=np.uint8)
    for s in range(13):
        emit[s, STOP] = HERE | (BACK if s in (QR, QV, QL) else 0)
        for c in range(11):
            to, out = fresh[c], HERE
            if s == WORD and c in letters or s == NUM and c == NUMBER:
                out = 0
            elif s == MARKS and c in (OTHER, QUOTE):
                to, out = MARKS, 0
            elif s in (W1B, W1O, W2B, W2O):
                if c in (BLANK, SPACE):
                    to, out = (W2B if c == BLANK else W2O), 0
                elif s in (W1B, W2B):  # the last blank goes with what follows
                    to, out = (MARKS if c == QUOTE else to), (BACK if s == W2B else 0)
                else:
                    out = HERE | (BACK if s == W2O else 0)
            elif s == Q:
                if c in (T, R, V, LL):
                    to, out = {T: DONE, R: QR, V: QV, LL: QL}[c], 0
                elif c in (OTHER, QUOTE):
                    to, out = MARKS, 0
            elif s in (QR, QV, QL):
                if c == (LL if s == QL else E):
                    to, out = DONE, 0
                else:  # no contraction: a word began at the letter before
                    out = BACK | (0 if c in letters else HERE)
            step[s, c], emit[s, c] = to, out
    return kind, step, emit


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``classes`` ends each text with STOP."""
    _, step, emit = piece_machine()
    n = len(classes)
    k = -(-n // CHUNK)
    grid = np.full(k * CHUNK, STOP, dtype=np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(k, CHUNK).T)
    flat_step, flat_emit = step.ravel(), emit.ravel()
    maps = np.tile(np.arange(13, dtype=np.uint8), (k, 1))  # of each chunk: state before -> state after
    for column in grid:
        maps = flat_step[maps * np.uint8(12) + column[:, None]]
    d = 1
    while d < k:  # inclusive prefix scan: the first chunks' maps come first
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
        d *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.uint8)
    out = np.empty((CHUNK, k), dtype=np.uint8)
    for j, column in enumerate(grid):
        at = state * np.uint8(12) + column
        out[j], state = flat_emit[at], flat_step[at]
    marks = out.T.ravel()[:n]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BACK).astype(bool)
    return np.flatnonzero(begins)


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class CountingTransducer:
    """Reads bytes; the weights along the path of a piece add up to the number of its tokens.

    After each byte the state holds, for every earlier place from which a token may still be open, the trie node
    of the bytes since then, the last token before it (-1: none) and how many fewer tokens there were. A token t
    may follow a token a iff the merges leave the bytes of a + t as just these two; of all tokens that end at a
    place exactly one follows rightly, so that the machine is deterministic. ``limit`` bounds its tables.
    """

    def __init__(self, vocab: dict[str, int], merges: list, limit: int = 150_000) -> None:
        byte = byte_of_char()
        self.child: dict[int, int] = {}  # trie node * 256 + byte -> node
        self.token, self.inner = [-1], [True]  # of each node: the token it spells, whether it goes on
        for text, number in vocab.items():
            if all(c in byte for c in text):
                node = 0
                for c in text:
                    self.inner[node] = True
                    to = self.child.get(node << 8 | byte[c])
                    if to is None:
                        to = self.child[node << 8 | byte[c]] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = to
                self.token[node] = number
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.rank = {vocab[a] << 24 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = {vocab[a + b]: (i, vocab[a], vocab[b]) for i, (a, b) in reversed([*enumerate(pairs)])}
        self.limit = limit
        self.follows: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.heads: dict[bytes, tuple[int, int]] = {}
        self.root = self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return n

    def _may_follow(self, a: int, t: int) -> bool:
        left, right, before, never = a, t, 1 << 60, 1 << 60
        while True:  # undo the later of the two last merges: one across the border must not have come first
            if self.rank.get(left << 24 | right, never) < before:
                return False
            (p, _, x), (q, y, _) = self.made.get(left, (-1, left, left)), self.made.get(right, (-1, right, right))
            if p < 0 and q < 0:
                return True
            if p > q:
                before, left = p, x
            else:  # of equal merges the one further left came first
                before, right = q + 1, y

    def _move(self, state: int, x: int) -> tuple[int, int]:
        grown, token, gain, follows = [], -1, 0, self.follows
        for node, last, fewer in self.states[state]:
            to = self.child.get(node << 8 | x)
            if to is None:
                continue
            if self.inner[to]:
                grown.append((to, last, fewer))
            t = self.token[to]
            if token < 0 <= t:
                right = last < 0
                if not right:
                    right = follows.get(last << 24 | t)
                    if right is None:
                        if len(follows) > 4 * self.limit:
                            follows.clear()
                        right = follows[last << 24 | t] = self._may_follow(last, t)
                if right:
                    token, gain = t, 1 + fewer
        key = (*[(to, last, fewer - gain) for to, last, fewer in grown], (0, token, 0))
        move = self.moves[state][x] = (self._state(key), gain)
        return move

    def count(self, piece: bytes) -> int:
        if len(piece) <= HEAD:
            return self._run(self.root, piece)[1]
        head = piece[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self._run(self.root, head)
            self.heads[head] = known
        return known[1] + self._run(known[0], piece[HEAD:])[1]

    def _run(self, state: int, piece: bytes) -> tuple[int, int]:
        total, moves = 0, self.moves
        for x in piece:
            move = moves[state].get(x)
            if move is None:
                if len(self.states) > self.limit:
                    key = self.states[state]
                    self.clear()
                    state, moves = self._state(key), self.moves
                move = self._move(state, x)
            state = move[0]
            total += move[1]
        return state, total


class TokenCounter:
    """Counts the tokens of whole texts as the library does for a byte-level BPE file."""

    def __init__(self, path: str, memo: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.machine = CountingTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.memo: dict[str, int] = {}
        self.most = memo

    def _segments(self, text: str) -> tuple[list[str], int]:
        parts, found = [text], 0
        for s in self.special:
            if any(s in p for p in parts):
                split = [p.split(s) for p in parts]
                found += sum(len(x) - 1 for x in split)
                parts = [y for x in split for y in x]
        return parts, found

    def _strip(self, texts: list[str]) -> np.ndarray:
        """Tokens of each of some texts without special strings."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = piece_machine()[0][codes]
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[stops] = STOP
        begins = piece_starts(classes)
        real = classes[begins] != STOP
        ends = np.append(begins[1:], len(codes))[real]
        begins = begins[real]
        pieces = [joined[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, count, long = self.memo, self.machine.count, {}
        for p in set(pieces).difference(memo):  # long pieces are counted for this strip alone
            (memo if len(p) <= LONGEST else long)[p] = count(p.encode("utf-8", "surrogatepass"))
        of = (lambda p: memo[p] if len(p) <= LONGEST else long[p]) if long else memo.__getitem__
        counts = np.fromiter(map(of, pieces), dtype=np.int64, count=len(pieces))
        return np.bincount(np.searchsorted(stops, begins), weights=counts, minlength=len(texts)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            if held:
                np.add.at(total, [i for i, _ in held], self._strip([t for _, t in held]))
                held.clear()

        for i, text in enumerate(texts):
            parts, found = self._segments(text)
            total[i] += found
            for p in parts:
                held.append((i, p))
                size += len(p)
                if size >= STRIP:
                    flush()
                    size = 0
        flush()
        return total


@cache
def counter_of(path: str) -> TokenCounter:
    """One counter for each worker process, shared by its tasks."""
    return TokenCounter(path)


def with_token_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of the whole text (null and empty: 0) by the byte-level BPE file at ``path``.

    Purely row-wise: no shuffle, rows with null or repeated ids and extra columns pass through, a column
    already called ``name`` is replaced. ``path`` must be readable on the executors.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(path)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()))

    return df.withColumn(name, tokens(F.coalesce(F.col(text), F.lit(""))))
