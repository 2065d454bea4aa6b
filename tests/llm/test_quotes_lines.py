"""Reply links by quote level, and line removal and memories of encoders at sizes where they used to fail."""

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoflow.llm import lines, packing, queries, quotes, tokencount

CONV = "conv_id long, turn int, role string, text string"
LONG = "what is the longest river that flows through the whole of this land"


@pytest.mark.parametrize(
    ("texts", "replies"),
    [
        ([LONG, "Fine", f"> > {LONG}\n> Fine\nGood"], [None, None, 1]),  # a short quote outside, a long one inside
        ([LONG, f"> {LONG}\nFine", f"> > {LONG}\n> Fine\nGood", f"> > > {LONG}\n> > Fine\n> Good\nYes"], [None, 0, 1, 2]),  # quotes of messages that quote
        ([LONG, "Fine", f"> > > {LONG}\n> unknown words\nGood"], [None, None, 0]),  # a gap in the levels; level 1 leads nowhere
        (["a b", "c d e f", "> a b\nx\n> c d e f\ny"], [None, None, 1]),  # of one level the longest
        (["same", "same", "> same\nz"], [None, None, 0]),  # the first message that has a passage owns it
        (["a b", "a c", "> a b\n> a c\nboth"], [None, None, 1]),  # of equal lengths the later message
        (["first line\nsecond line", "> second line\nok"], [None, 0]),  # one line of a message
        (["a", ">a\n>>b\nc", "> > b\nd"], [None, 0, None]),  # nothing owns what is only quoted
    ],
)
def test_parents_by_level(spark, texts, replies):
    rows = [(1, t, "user", x) for t, x in enumerate(texts)]
    found = quotes.reply_ordered(spark.createDataFrame(rows, CONV)).orderBy("turn").collect()
    assert [r.reply_to for r in found] == replies


def test_each_message_of_nested_quotes_answers_the_one_before(spark):
    sf = "/root/testdata/sf0.01"
    own = {(r.conv_id, r.turn): quotes.normal(r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    found = queries.nested_quotes(spark, sf).collect()
    quoting = [r for r in found if r.n_quoted and own.get((r.conv_id, r.turn - 1))]
    assert len(quoting) > 400
    for r in quoting:
        said = own[r.conv_id, r.turn - 1]
        assert r.reply_to == min(t for t in range(r.turn) if own.get((r.conv_id, t)) == said)


def test_passages_of_one_text():
    assert quotes.passages_of("> > Deep  One\n> Outer\n> two\nmine\n\n>last") == [(2, "deep one"), (1, "outer two"), (1, "outer"), (1, "two"), (0, "mine"), (1, "last")]
    assert quotes.passages_of("") == [] and quotes.passages_of("> \n>\n ") == []


def test_a_million_lines_of_boilerplate(spark):
    schema = "doc_id long, text string, source string"
    odd = "\n".join(["keep this"] + ["cut me", "me too"] * 500_000 + ["and this"])
    df = spark.createDataFrame([(0, odd, "s0"), *[(i, "cut me\nme too", f"s{i}") for i in range(1, 4)]], schema)
    began = time.time()
    found = {r.doc_id: r for r in lines.without_boilerplate(df, 3, counts=True).collect()}
    assert time.time() - began < 90
    assert found[0].text == "keep this\nand this" and (found[0].n_lines, found[0].n_removed) == (1_000_002, 1_000_000)
    assert found[2].text == ""


def test_lines_near_and_far_from_the_bound_of_many_sites(spark):
    """With thousands of sites the sketch errs; lines near the bound are counted exactly."""
    spread = {"far over": 5000, "one over": 3001, "at the bound": 3000, "one under": 2999, "far under": 900}
    rows = [(k, f"{line}\nown {k}", f"s{k % n}") for line, n in spread.items() for k in range(5200)]
    rows += [(7, "far over\nown 7", "s7")] * 3  # repeated rows
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)] + [(-1, "one under\nfar over", None), (-1, "one under\nfar over", None)], "doc_id long, text string, source string")
    keys = lines.spread_lines(df, 3000)
    named = spark.createDataFrame([(x,) for x in spread], "line string").select("line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    # The row without a source is a site of its own, so that 2,999 and one make 3,000.
    assert {r.line for r in named.join(keys, ["a", "b"]).collect()} == {"far over", "one over", "at the bound", "one under"}
    out = {r.doc_id: r.text for r in lines.without_boilerplate(df, 3000).collect()}
    assert out[-1] == "" and out[0] == "own 0" and out[4 * 5200] == "far under\nown 0" and out[len(rows) - 1] == "own 7"


def test_long_words_are_not_remembered():
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", dtype=np.uint8)
    words = [bytes(rng.choice(letters, 100_000)).decode() for _ in range(3)] + ["".join(rng.choice(list("abcdefgh"), 3000)) for _ in range(40)]
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for w in words:
        assert np.frombuffer(encoder.encode(f"a {w} b"), dtype="<u4").tolist() == library.encode(f"a {w} b", add_special_tokens=False).ids
    assert max(map(len, [*encoder, *encoder.letters, *encoder.marks])) <= packing.LONGEST
    counter, library = tokencount.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = words[3:9] + [f"short {words[5]} text"]
    assert counter.count(some).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in some]
    assert max(map(len, counter.memo)) <= tokencount.LONGEST
