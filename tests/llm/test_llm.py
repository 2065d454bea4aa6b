import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoflow.llm import decontaminate, language, lines, neardup, ordermin, packing, queries, quotes, sharding, tokencount, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string"
ODD = [None, "", " ", "a", "\n\n", "It's  'll x" * 3, "é́Σ<|endoftext|>日本語 12", "word " * 9000, "same text here", "same text here", "> quoted\nown"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", None, None, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[8], (None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sharding(spark, docs, empty):
    found = sharding.shard(docs.repartition(3), 4).toPandas()
    sizes = found.groupby("shard")["slot"].agg(["count", "max"])
    assert len(found) == len(ODD) + 2 and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all()
    assert sharding.shard(empty, 4).count() == 0
    first = queries.op1_sharding(spark, SF).toPandas().sort_values("doc_id")
    assert first["doc_id"].is_unique and first["shard"].nunique() == 24


def test_shuffle_is_uniform():
    left, rng, seen = np.array([2, 2, 2]), np.random.default_rng(0), defaultdict(int)
    for _ in range(6000):
        seen[tuple(rng.multivariate_hypergeometric(left, 3, method="marginals"))] += 1
    assert abs(seen[1, 1, 1] / 6000 - 8 / 20) < 0.03


def test_token_counts(docs, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in tokencount.with_token_counts(docs, path).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    found = tokencount.TokenCounter(path).count(list(texts.values()))
    assert found.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts.values()]
    assert tokencount.with_token_counts(empty, path).count() == 0


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(packing.cut_into_pieces(docs.filter("doc_id <> 8"), path, 64), 64, ["doc_id", "piece"]).toPandas()
    for doc, part in pieces.groupby("doc_id"):
        ids = [*library.encode(ODD[int(doc)] or "", add_special_tokens=False).ids, 0]
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        assert part["length"].sum() == len(ids)
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"].to_numpy() == np.concatenate(([0], np.cumsum(part["length"])[:-1]))).all() and part["length"].sum() <= 64
    assert packing.pack(packing.cut_into_pieces(empty, path, 64), 64, ["doc_id", "piece"]).count() == 0


def test_plan_meets_small_optimum():
    counts = np.bincount([6, 6, 5, 5, 5, 4, 4, 4, 4, 3, 2], minlength=13)
    assert sum(k for _, k in packing.plan(counts, 12)) == packing.lower_bound(counts, 12) == 4


def test_fingerprints(spark, docs, empty):
    rows = queries.op4_order_minhash(spark, SF).toPandas().set_index("doc_id")
    assert (rows["near_edited"] > rows["near_next"]).mean() > 0.95
    same = ordermin.with_fingerprint(docs, "text", "fp").filter("doc_id in (8, 9)").select("fp").distinct()
    assert same.count() == 1
    chain = ordermin.with_edit(ordermin.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"]), "text", "next_text")
    got = {r.doc_id: r.edited for r in chain.filter("doc_id <> 8 and doc_id > 0").collect()}
    for i in range(1, len(ODD)):
        t, nxt = ODD[i] or "", ODD[i - 1] or ""
        if i != 8:
            k = len(t) // 3
            assert got[i] == t[: len(t) - k] + nxt[:k]
    assert ordermin.with_next(empty.select("doc_id", "text"), "doc_id", ["text"]).count() == 0


def test_near_duplicates(spark, docs, empty, texts):
    found = {r.doc_id: r for r in queries.op5_near_duplicates(spark, SF).collect()}
    sets = {d: set(neardup.shingles(t, 5).tolist()) for d, t in texts.items()}
    group = {d: d for d in sets}

    def top(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    assert {d: (r.component_id, r.n_shingles) for d, r in found.items()} == {d: (top(d), len(s)) for d, s in sets.items()}
    odd = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert odd[9] == 8 and odd[0] == 0 and odd[1] == 1
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.keep_one(docs).filter("doc_id in (8, 9)").count() == 1


def test_near_copies_without_a_common_hub(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(np.where(rng.random(400) < 0.02, f"x{i}", base))) for i in range(60)]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(neardup.shingles(t, 5).tolist()) for _, t in rows]
    group = list(range(60))
    for a in range(60):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert [found[i] for i in range(60)] == group


def test_lines(spark, empty):
    rows = [(i, f"own line {i}\nboiler plate\n\nrare", f"s{i % 12}") for i in range(24)] + [(99, "boiler plate", None), (None, None, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in lines.without_boilerplate(df.filter("doc_id < 24 or doc_id = 99 or doc_id is null"), 13, counts=True).collect()}
    assert out[0].text == "own line 0\n\nrare" and out[0].n_removed == 1 and out[99].text == "" and out[None].text is None
    assert lines.without_boilerplate(empty, 3).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "user", "How are you?\nI ask."), (1, 1, "assistant", "> how  are you?\n> I ask.\nFine"), (1, 2, "user", "> > How are you?\n> Fine\nGood"), (1, 3, "user", "Other"), (None, None, None, None)]
    out = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert out[1].reply_to == 0 and out[1].body == "Fine" and out[1].n_quoted == 2
    assert out[2].body == "Good" and out[2].thread_root == 0 and out[3].reply_to is None
    assert [out[t].position for t in (0, 1, 2, 3)] == [0, 1, 2, 3] and out[None].body == ""


def test_decontamination(spark, docs, empty, texts):
    items = {str(r.item_id): r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: pattern.findall(t.translate(low))
    windows = defaultdict(set)
    for i, t in items.items():
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    for r in queries.op8_decontamination(spark, SF).collect():
        w, hit, names = words(texts[r.doc_id]), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    test = spark.createDataFrame([("a", "same TEXT"), ("b", None), ("c", "")], "item_id string, text string")
    cut = {r.doc_id: r.text for r in decontaminate.cleaned(docs, test, most_cover=0.9).collect()}
    assert cut[8] == " here" and cut[3] == "a" and decontaminate.cleaned(empty, test).count() == 0


def test_automaton_in_parts_gives_the_same(spark, docs, monkeypatch):
    test = spark.createDataFrame([("a", "same text"), ("b", "text here"), ("c", "word word word")], "item_id string, text string")
    whole = {(r.doc_id, tuple(map(tuple, r.hits.spans)), tuple(r.hits.items)) for r in decontaminate.with_hits(docs, test).collect()}
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 4)
    assert {(r.doc_id, tuple(map(tuple, r.hits.spans)), tuple(r.hits.items)) for r in decontaminate.with_hits(docs, test).collect()} == whole


def test_toxicity(spark, docs, empty):
    found = queries.op9_toxicity(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    rows = found[found["held_out"]].join(labels, how="inner")
    assert rows[rows.toxic == 1]["score"].mean() > rows[rows.toxic == 0]["score"].mean() + 0.3
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)) is None
    assert toxicity.with_toxicity(empty, None).count() == 0


def test_language(spark, docs, empty):
    found = queries.op10_language(spark, SF).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["lang"]
    held = found[found["held_out"]]
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.95
    model = language.train(docs, F.lit(True))
    odd = {r.doc_id: r.lang_pred for r in language.with_language(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == "und"
    assert language.train(empty, F.lit(True)) is None and language.with_language(empty, None).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048 and not out.duplicated(["doc_id", "piece"]).any()
    kept = {r.doc_id for r in queries.op5_near_duplicates(spark, SF).filter("kept").collect()}
    assert len(set(out["doc_id"])) >= 0.9 * len(kept)
