"""Quotation linking: conversations in reply order, without their quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import gapless_rank
from ..functions.tables import pin, stored
from .common import salted, small_batches

#: Leading quote marks of a line, each with one optional blank; white space inside a passage.
MARKS, BLANKS = re.compile(r"(?:> ?)*"), re.compile(r"[ \t\n\x0B\f\r]+")
PASSAGES = "array<struct<level:int,a:long,b:long,n:long>>"


def normal(passage: str) -> str:
    """Lower case, white space collapsed and trimmed."""
    return BLANKS.sub(" ", passage.lower()).strip(" ")


def passages_of(text: str) -> list[tuple[int, str]]:
    """(level, passage): runs of lines of one quote level, and each of their lines; normalised, distinct, not empty.

    Level 0 is a message's own text; '> > x' has level 2.
    """
    lines = []
    for line in text.split("\n"):
        marks = MARKS.match(line)[0]
        lines.append((marks.count(">"), line[len(marks) :]))
    found = {}
    for level, run in groupby(lines, key=lambda x: x[0]):
        parts = [x for _, x in run]
        found |= dict.fromkeys((level, normal(p)) for p in ("\n".join(parts), *parts))
    return [x for x in found if x[1]]


def passages(rows: DataFrame) -> DataFrame:
    """(__row, conv, turn, tie, level, a, b, n) of rows with __row, conv, turn, tie and text: for each passage 128 bits that stand for it, and its length."""
    small_batches(rows.sparkSession)

    @F.pandas_udf(PASSAGES)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                hashed = [(level, xxhash.xxh3_128_intdigest(p.encode("utf-8", "surrogatepass")), len(p)) for level, p in passages_of(text)]
                out.append([{"level": level, "a": (h >> 64) - (1 << 63), "b": (h & (1 << 64) - 1) - (1 << 63), "n": n} for level, h, n in hashed])
            yield pd.Series(out)

    # Outer: of a plain explode Spark derives a filter, for which it would run the function a second time.
    found = rows.select("__row", "conv", "turn", "tie", F.explode_outer(parsed("text")).alias("p"))
    return found.filter("p is not null").select("__row", "conv", "turn", "tie", "p.*")


def reply_links(found: DataFrame) -> DataFrame:
    """(__row, parent, reply_to): the earlier message of the same conversation that a message quotes.

    A quoted passage belongs to the first message that has it as own text; of messages of one turn to the first by
    ``tie``. A message answers what it quotes at the shallowest level from which a passage leads to an earlier message: deeper ones
    are quotes inside that quote. Of several passages there the longest decides, then the later message. Messages of
    null turn own nothing and answer nothing.
    """
    found = found.filter("turn is not null")
    own = found.filter("level = 0").groupBy("conv", "a", "b").agg(F.min(F.struct("turn", "tie", "__row")).alias("first"))
    quoted = found.filter("level > 0").select("__row", "conv", "turn", "level", "a", "b", "n")
    links = salted(own, quoted, ["conv", "a", "b"]).filter("first.turn < turn")
    rank = F.struct((-F.col("level")).alias("shallow"), "n", F.col("first.turn").alias("turn"), F.col("first.__row").alias("parent"))
    best = links.groupBy("__row").agg(F.max(rank).alias("b"))
    return best.select("__row", F.col("b.parent").alias("parent"), F.col("b.turn").alias("reply_to"))


def roots(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(__row, root): the message at the start of each reply chain, by doubling steps along the links."""
    at = pin(links.select("__row", F.col("parent").alias("root")))
    for _ in range(rounds):
        ahead = at.toDF("root", "further")
        stepped = salted(ahead, at, ["root"], "left")
        if not stepped.filter("further is not null").limit(1).count():
            break
        at = pin(stepped.select("__row", F.coalesce("further", "root").alias("root")))
    return at


def reply_ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages without quoted lines, linked and ordered by reply.

    Adds body (own lines, trimmed), n_quoted (quoted lines), reply_to (turn of the message that is quoted, null if
    none), thread_root (first turn of the reply chain) and position (gapless from 0 in a conversation: threads by
    their root, then by turn, so that a reply follows what it answers). A conversation of any size is spread over
    tasks, and so is a passage that many messages quote. Null text is empty; null ids form one conversation, null turns come first and quote or answer nothing;
    repeated rows are separate messages. Columns of the new names are replaced; other columns, whatever they are
    called, are carried along. An empty table gives an empty result.
    """
    rows = stored(df.drop("body", "n_quoted", "reply_to", "thread_root", "position").withColumn("__row", F.monotonically_increasing_id()))
    slim = rows.select("__row", F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("turn"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = pin(reply_links(stored(passages(slim))))
    tops = salted(slim.select(F.col("__row").alias("root"), F.col("turn").alias("root_turn")), roots(links), ["root"])
    linked = slim.select("__row", "conv", "turn").join(links.select("__row", "reply_to"), "__row", "left").join(tops, "__row", "left")
    linked = linked.withColumn("thread_root", F.coalesce("root_turn", "turn")).withColumn("root", F.coalesce("root", "__row")).drop("root_turn")
    order = [F.col(c).asc_nulls_first() for c in ("thread_root", "root", "turn", "__row")]
    ranked = gapless_rank(linked, ["conv"], order, "position").select("__row", "reply_to", "thread_root", "position")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    body = F.trim(F.array_join(F.filter(lines, lambda x: ~x.startswith(">")), "\n"))
    n_quoted = F.size(F.filter(lines, lambda x: x.startswith(">"))).cast("long")
    kept = [c for c in rows.columns if c != "__row"]
    return rows.join(ranked, "__row").select(*kept, body.alias("body"), n_quoted.alias("n_quoted"), "reply_to", "thread_root", "position")
