"""Stages of the pipeline on inputs of their own, against brute force."""

import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from geoflow.llm import language, neardup, queries


def brute_components(texts: dict[int, str], percent: int) -> dict[int, int]:
    """The least id of each group of texts linked by similarity on word shingles, by comparing all pairs."""
    sets = {d: set(zip(*[w[k:] for k in range(min(5, len(w)))], strict=False)) for d, t in texts.items() for w in [t.lower().split()]}
    group = {d: d for d in texts}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    return group


def test_pipeline_drops_near_copies_from_080_up(spark):
    """Copies of 0.81, which 0.85 would keep, go; those of 0.73 stay; op5's own threshold is as it was."""
    rng, texts = np.random.default_rng(3), {}
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(100)]
        texts[3 * i] = " ".join(words)
        for more, spots in ((1, (20, 60)), (2, (10, 40, 70))):
            copy = list(words)
            for at in spots:
                copy[at + int(rng.integers(0, 10))] = f"other{i}x{at}"
            texts[3 * i + more] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {d for d, g in brute_components(texts, 80).items() if d == g}
    assert len(want) == 80
    assert {r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, "").collect()} == want
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == brute_components(texts, 85)


def test_bands_miss_few_pairs_at_each_threshold():
    for percent in (95, 90, 85, 80, 70, 60, 50):
        bands, rows = neardup.scheme(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1.2e-5 and bands * rows % 16 == 0
    assert neardup.scheme(85) == (24, 6)


@pytest.mark.parametrize("n", [2, 4, 20])
def test_language_stage_keeps_and_rejects_alike_for_any_number_of_languages(spark, n):
    rng = np.random.default_rng(8)

    def sampler():
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 14, replace=False)
        words = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(400)]
        chance = 1 / np.arange(1, 401)
        return lambda size: " ".join(rng.choice(words, size, p=chance / chance.sum()))

    rows = []
    for k in range(n):
        say = sampler()
        rows += [(say(rng.integers(60, 300)), f"l{k}") for _ in range(24)]
        rows += [(say(size), None) for size in (5, 20, 6000)]
    clean = set(range(len(rows)))
    odd = [chr(c) for c in range(0x3B1, 0x3C9)]
    rows += [(" ".join("".join(rng.choice(odd, 6)) for _ in range(100)), None), ("12 34 !", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()} == clean


def test_language_stage_without_labels_keeps_what_has_letters(spark):
    df = spark.createDataFrame([(0, "plain words", None), (1, "12 !", None), (2, None, None), (3, "日本", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()} == {0, 3}


def test_no_language_is_left_out_in_silence(spark):
    rows = [(i, f"text of language {i % n}", f"l{i % n}") for n in (400, 401) for i in range(n)]
    df = spark.createDataFrame(rows[400:], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 400"):
        language.train(df, F.lit(True))


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(i, f"text {i}", ("a", "a", "b", "c")[i]) for i in range(4)], "doc_id long, text string, lang string")
    assert language.train(df, F.lit(True)).languages == ["a", "b", "c"]


def test_links_of_large_sets_are_all_found(spark):
    """Sets of 600 to 20,000 shingles around the threshold of 85 per cent, in groups without a common hub, against all pairs."""
    rng, rows = np.random.default_rng(12), []
    for size, members in ((600, 12), (1500, 10), (5000, 8), (20_000, 5)):
        base = np.array([f"w{size}x{i}" for i in range(size)])
        for k in range(members):
            words = base.copy()
            at = rng.choice(size // 12, size=int(size * rng.choice([0.006, 0.0075, 0.009])), replace=False) * 12
            words[at] = [f"o{size}x{k}x{i}" for i in at]
            rows.append((len(rows), " ".join(words)))
    sets = [set(neardup.shingles(t, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    near, links = 0, 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            share = both / (len(sets[a]) + len(sets[b]) - both)
            near += 0.82 < share < 0.88
            if share >= 0.85:
                links += 1
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert near > 40 and 0 < links
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(group))


def test_no_pair_over_the_threshold_is_lost_in_a_cell(monkeypatch):
    """The codes of whole sets discard no pair that the packed bits let through, whatever the sizes."""
    import pandas as pd

    monkeypatch.setattr(neardup, "margin", lambda percent: 10.0)  # the bits let all through
    rng = np.random.default_rng(3)
    for size in (5, 700, 3000, 60_000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = []
        for drop in (0, 0.02, 0.05, 0.08, 0.2):
            own = base[rng.random(size) >= drop]
            sets.append(np.unique(np.append(own, rng.integers(0, 1 << 63, int(size * drop), dtype=np.uint64))))
        frame = pd.DataFrame({"low": [np.zeros(9, dtype=np.int64)] * 5, "n": list(map(len, sets)), "component": range(5), "node": range(5), "codes": [(x >> np.uint64(16)).astype(np.uint16).tobytes() for x in sets]})
        out = []
        neardup._compare_cell(frame, frame, 85, out)
        want = {(a, b) for a in range(5) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
        assert want and want <= set(out)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, sites):
    spread = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                spread[line].add(r.source or "")
    gone = {line for line, where in spread.items() if len(where) >= sites}
    return {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if x not in gone) for r in rows}


def brute_clean(texts, items, window=10, most_cover=0.5):
    windows = defaultdict(set)
    for t in items:
        w = words_of(t or "")
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    out = {}
    for doc, t in texts.items():
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))]
        w, hit = words_of(t or ""), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
        if len(hit) > most_cover * len(w):
            continue
        kept, at = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                kept.append(t[at : places[k][0]])
            if k + 1 not in hit:
                at = places[k][1]
        out[doc] = t if not hit else "".join([*kept, t[at:]])
    return out


def test_the_chain_equals_brute_force_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    rows = kept.collect()
    assert kept.columns == docs.columns and len(rows) >= 0.95 * docs.filter(F.col("text").rlike(r"\p{L}")).count()
    texts = brute_lines(rows, queries.SITES)
    lined = corpus_pipeline.dedup_lines(spark, kept, sf)
    assert {r.doc_id: r.text for r in lined.collect()} == texts
    group = brute_components({d: t or "" for d, t in texts.items()}, 80)
    empty = {d for d, t in texts.items() if not (t or "").split()}
    texts = {d: t for d, t in texts.items() if d == group[d] or d in empty}
    single = corpus_pipeline.dedup_documents(spark, lined, sf)
    assert {r.doc_id: r.text for r in single.collect()} == texts
    texts = brute_clean(texts, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    clean = corpus_pipeline.decontaminate_documents(spark, single, sf)
    assert {r.doc_id: r.text for r in clean.collect()} == texts
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 2048):
            want[doc, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    packed = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    fill = defaultdict(list)
    for r in packed:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert not list(pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("pipeline-*/language"))
