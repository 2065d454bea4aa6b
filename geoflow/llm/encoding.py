"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the bytes says so, so that a passage is cut alike wherever it stands. A chunk
that several texts share is encoded for one of them, its owner, and the others take its ids; all other chunks are
encoded where they are. At the joins the stretch from the last blank before to the first blank after a cut is encoded
again: nothing is joined across a blank, so that at both of its ends the ids agree exactly with those of the chunks.
A chunk without blanks agrees nowhere and becomes part of the stretch, which goes on to the next blank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from .common import salted, small_batches, whole_text
from .packing import encoder_of

#: Bytes that the rolling hash sees; chunks have 2**CUT_BITS bytes in the mean beyond the least number, and at most MOST_BYTES.
SEEN, CUT_BITS, LEAST_BYTES, MOST_BYTES = 32, 10, 256, 1 << 16
#: What can be made of the ids of a text.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes: places whose last bytes have a hash that begins with zeros, moved to the next code point."""
    at = np.frombuffer(text, dtype=np.uint8)
    n, ends, last = len(at), [], 0
    h, power, width = (at.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), 1
    while width < SEEN:  # a window of twice the width is one window after another
        ahead = h.copy()
        ahead[width:] += h[:-width] * power
        h, power, width = ahead, np.uint32(int(power) ** 2 & 0xFFFFFFFF), 2 * width
    begins = (at & 0xC0) != 0x80
    for end in np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0).tolist():
        end += 1
        while end < n and not begins[end]:
            end += 1
        while end - last > MOST_BYTES:
            last = last + MOST_BYTES
            while not begins[last]:
                last -= 1
            ends.append(last)
        if end - last >= LEAST_BYTES and end < n:
            ends.append(end)
            last = end
    while n - last > MOST_BYTES:
        last = last + MOST_BYTES
        while not begins[last]:
            last -= 1
        ends.append(last)
    return [*ends, n] if n else []


def digest(chunk: bytes) -> bytes:
    """128 bits that stand for a chunk."""
    return xxhash.xxh3_128_digest(chunk)


def blanks(chunk: bytes) -> tuple[int, int]:
    """Places of the first and the last blank or line feed of a chunk; -1 if it has none."""
    first = min((x for x in (chunk.find(b" "), chunk.find(b"\n")) if x >= 0), default=-1)
    return first, max(chunk.rfind(b" "), chunk.rfind(b"\n"))


class ChunkedEncoder:
    """Ids of one text from the ids of its chunks, some of which are borrowed."""

    def __init__(self, path: str) -> None:
        self.words = encoder_of(path)

    def ids(self, part: bytes) -> bytes:
        return self.words.encode(part.decode())

    def encode(self, text: bytes, borrowed: set[bytes], owned: set[bytes]) -> tuple[list[bytes], list[tuple[bytes, int, int]], dict[bytes, bytes]]:
        """Stretches of ids, the holes between them (digest, bytes of ids to leave out at its head and at its tail), ids of the owned chunks."""
        known: dict[bytes, bytes] = {}  # chunks that recur in this text
        segments: list[list[bytes]] = [[]]
        holes, published = [], {}
        begin, open_at = 0, 0  # of the chunk; of the stretch that is still to be encoded
        ends = cuts(text)
        for k, end in enumerate(ends):
            chunk = text[begin:end]
            name = digest(chunk)
            lend = name in borrowed
            if name in owned and name not in published:
                published[name] = known[name] = self.ids(chunk)
            first, last = blanks(chunk)
            if first >= 0:
                head, tail = 0, len(chunk)
                if k:  # the join before: up to the first blank
                    head = first
                    segments[-1].append(self.ids(text[open_at : begin + first]))
                if k + 1 < len(ends):
                    tail = last
                if lend:
                    holes.append((name, len(self.ids(chunk[:head])), len(self.ids(chunk[tail:]))))
                    segments.append([])
                else:
                    ids = known.get(name)
                    if ids is None:
                        ids = known[name] = self.ids(chunk)
                    segments[-1].append(ids[len(self.ids(chunk[:head])) : len(ids) - len(self.ids(chunk[tail:]))])
                open_at = begin + tail
            begin = end
        if open_at < len(text):  # the end of the text has no blank after the last stretch
            segments[-1].append(self.ids(text[open_at:]))
        return [b"".join(s) for s in segments], holes, published


class Finisher:
    """What is asked for of the ids of a whole text."""

    def __init__(self, path: str, outputs: list[str]) -> None:
        tokenizer = encoder_of(path).tokenizer
        self.outputs = outputs
        self.plain = tokenizer.decoder is None  # then the library puts blanks between the tokens
        self.tokenizer = tokenizer
        self.shown = [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size())] if self.plain else []

    def __call__(self, ids: bytes) -> tuple:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        decoded = b""
        if {"decoded", "decoded_sha256"} & set(self.outputs):
            decoded = b" ".join(map(self.shown.__getitem__, numbers)) if self.plain else self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        made = {
            "n_tokens": lambda: len(numbers), "ids": lambda: numbers, "decoded": lambda: decoded.decode(),
            "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
        }
        return tuple(made[o]() for o in self.outputs)


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2")]


def chunks_of(texts: DataFrame) -> DataFrame:
    """(__h1, __h2, c): the digests of each text's chunks, each once for a row."""

    @F.pandas_udf("array<binary>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                raw = text.encode()
                ends = cuts(raw)
                out.append(list({digest(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)}))
            yield pd.Series(out)

    return texts.select("__h1", "__h2", F.explode_outer(digests("text")).alias("c")).filter("c is not null")


def roles(occurrences: DataFrame) -> DataFrame:
    """(__h1, __h2, borrowed, owned): of the chunks that several texts share, those that a text takes and those that it encodes for all.

    The owner is the text of the least key. Texts that share nothing have no row.
    """
    shared = occurrences.groupBy("c").agg(F.min("__h1").alias("owner"), F.max("__h1").alias("last")).filter("owner <> last").drop("last")
    rows = salted(shared, occurrences, ["c"]).distinct()
    own = F.col("__h1") == F.col("owner")
    return rows.groupBy("__h1", "__h2").agg(F.collect_list(F.when(~own, F.col("c"))).alias("borrowed"), F.collect_list(F.when(own, F.col("c"))).alias("owned"))


def encode_texts(texts: DataFrame, path: str, outputs: list[str]) -> DataFrame:
    """(__h1, __h2, *outputs) for each distinct text of (__h1, __h2, text)."""
    kinds = ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)
    part = f"__h1 long, __h2 long, done struct<{kinds.replace(' ', ':').replace(',:', ',')}>, segments array<binary>, holes array<struct<c:binary,head:int,tail:int>>, published array<struct<c:binary,ids:binary>>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, finish, pack = ChunkedEncoder(path), Finisher(path, outputs), zstandard.ZstdCompressor(3).compress
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                segments, holes, published = encoder.encode(r.text.encode(), set(r.borrowed if r.borrowed is not None else ()), set(r.owned if r.owned is not None else ()))
                done = None if holes else dict(zip(outputs, finish(segments[0]), strict=True))
                out.append((r[0], r[1], done, [pack(s) for s in segments] if holes else [], [dict(zip(("c", "head", "tail"), h, strict=True)) for h in holes], [{"c": c, "ids": pack(ids)} for c, ids in published.items()]))
            yield pd.DataFrame(out, columns=["__h1", "__h2", "done", "segments", "holes", "published"])

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finish, unpack = Finisher(path, outputs), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lent = {x["c"]: x["ids"] for x in r.lent}
                ids = [unpack(r.segments[0])]
                for hole, after in zip(r.holes, r.segments[1:], strict=True):
                    whole = unpack(lent[hole["c"]])
                    ids += [whole[hole["head"] : len(whole) - hole["tail"]], unpack(after)]
                out.append((r[0], r[1], *finish(b"".join(ids))))
            yield pd.DataFrame(out, columns=["__h1", "__h2", *outputs])

    occurrences = stored(chunks_of(texts))
    once = texts.groupBy("__h1", "__h2").agg(F.first("text").alias("text"))
    told = once.join(roles(occurrences), ["__h1", "__h2"], "left").select("__h1", "__h2", "text", "borrowed", "owned")
    first = stored(told.mapInPandas(encode, part))
    whole = first.filter("done is not null").select("__h1", "__h2", *[F.col(f"done.{o}").alias(o) for o in outputs])
    lent = first.select(F.explode("published").alias("p")).select("p.c", "p.ids").dropDuplicates(["c"])
    wanted = first.filter("done is null").select("__h1", "__h2", F.explode(F.array_distinct(F.transform("holes", lambda h: h["c"]))).alias("c"))
    found = salted(lent, wanted, ["c"]).groupBy("__h1", "__h2").agg(F.collect_list(F.struct("c", "ids")).alias("lent"))
    open_ = first.filter("done is null").select("__h1", "__h2", "segments", "holes").join(found, ["__h1", "__h2"])
    return whole.unionByName(open_.mapInPandas(assemble, f"__h1 long, __h2 long, {kinds}"))


def with_encoding(df: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Add what ``outputs`` names of ``OUTPUTS``: the ids of each whole text (null: empty) by the tokenizer file at ``path``, or what follows from them.

    For tokenizers that join nothing across blanks and line feeds. Equal texts are encoded once, and so is each chunk
    that several texts share; a chunk or text of any number of rows is dealt out by salts. Rows all stay, with null and
    repeated ids and further columns; columns of the new names are replaced. An empty table gives an empty result.
    ``path`` must be readable on the executors.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in outputs or c == text]
    rows = df.select(*kept, *_key(whole_text(df, text)))
    texts = df.select(*_key(whole_text(df, text)), whole_text(df, text).alias("text"))
    return salted(encode_texts(texts, path, list(outputs)), rows, ["__h1", "__h2"]).select(*[c for c in kept if c not in outputs], *outputs)
