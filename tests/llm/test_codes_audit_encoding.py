"""Vector codes, filter audit and chunk reuse against brute force and the tokenizer library."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoflow.llm import audit, common, encoding, queries, vectorcodes

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_equal_average_search_finds_the_nearest_entry_of_lowest_index():
    rng = np.random.default_rng(5)
    for d, size, spread in ((1, 9, 4), (4, 40, 3), (16, 256, 900), (3, 1, 5), (8, 60, 1 << 26)):
        book, parts = rng.integers(-spread, spread, (size, d)), rng.integers(-spread, spread, (300, d))
        book[size // 2 :: 3] = book[0]  # equal entries: ties
        far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        at, least = vectorcodes.nearest(parts, book)
        assert (least == far.min(axis=1)).all() and (at == far.argmin(axis=1)).all()


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Codebooks and (key, code, error) by plain loops over rows of (key, vector)."""
    rows = sorted((k is None, k or 0, v, [int(np.floor(1024.0 * x)) for x in v]) for k, v in rows)
    d = len(rows[0][3]) // parts
    cut = [[r[3][p * d : (p + 1) * d] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    pick = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(pick(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[p])]
    found = [[pick(c[p], books[p]) for p in range(parts)] for c in cut]
    coded = [(None if r[0] else r[1], "".join(f"{e:02x}" for _, e in f), sum(x for x, _ in f)) for r, f in zip(rows, found, strict=True)]
    return books, coded


def test_codes_equal_plain_loops_on_odd_tables(spark):
    rng = np.random.default_rng(6)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3 or None, "x") for i in range(30)]
    rows += [rows[4], (4, rows[7][1], 1, "y"), (None, rows[2][1], None, None), (50, rows[3][1], 2, "z")]  # repeated rows, ids and vectors
    bad = [(90, None, 1, "x"), (91, [nan] * 8, 1, "x"), (92, [inf] + [0.0] * 7, 1, "x"), (-1, [None] + [0.0] * 7, None, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string")
    single = [(r[0], [float(np.float32(x)) for x in r[1]]) for r in rows]
    books, coded = brute_codes(single, entries=16)
    found = vectorcodes.train(df, entries=16)
    assert found.tolist() == books
    out = vectorcodes.with_label_errors(vectorcodes.with_codes(df, found)).collect()
    assert sorted(map(repr, [(r.vec_id, r.code, r.error) for r in out])) == sorted(map(repr, coded))
    sums = Counter()
    for r in out:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in out) and {r.label for r in out} == {None, 1, 2}
    digits = ",".join(str(x) for book in books for entry in book for x in entry)
    assert vectorcodes.books_sha256(found) == hashlib.sha256(digits.encode()).hexdigest()


def test_no_vectors_and_vectors_that_cannot_be_coded(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)]):
        df = spark.createDataFrame(rows, schema)
        assert vectorcodes.train(df) is None
        assert vectorcodes.with_label_errors(vectorcodes.with_codes(df, None)).count() == 0
    for rows in ([(1, [0.0] * 6, 1)], [(1, [0.0] * 8, 1), (2, [0.0] * 4, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="vectors|components"):
            vectorcodes.train(spark.createDataFrame(rows, schema))


def brute_audit(docs, labels):
    """The audit by applying each order of the filters, one after another."""
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}  # rows without an id have no labels

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(u == t and j is not None and (i is None or j < i) for j, u, _ in docs)
        return {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if x}

    failed = [(i, part, fails(i, t)) for i, t, part in docs]
    out, share = {}, Counter()
    for part in {p for _, p, _ in failed}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, x) for i, p, x in failed if p == part]
            for k, f in enumerate(order):
                gone = [i for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                share[part, f] += len(gone)
                here = [x for _, p, x in failed if p == part and f in x]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(here) - len(gone), sum(x == {f} for x in here), sum(i in good for i in gone), sum(i in bad for i in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_retracts_when_smaller_ids_come_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "BUCKET_ROWS", 100)
    rng = random.Random(2)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", "a b a b", long, long + " #", "A" * 40 + long, "x " * 60_000, "tail"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [docs[0], docs[0], (0, docs[0][1], "fr"), (None, long, "en"), (None, "only one", None), (None, "only one", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(0, 1, 1), (None, 1, 1)]
    order = sorted(docs, key=lambda r: -(r[0] or 0))  # larger ids come first, so that least ids are taken back over and over
    for k in range(6):
        part = order[k * 51 : k * 51 + 51]
        spark.createDataFrame([(*r, "x") for r in part], "doc_id long, text string, lang string, mask string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(docs, labels)
    for batches in (6, 1):
        found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in audit.audit(spark, str(tmp_path / "docs"), marks, batches).collect()}
        assert found == want


def test_changes_of_one_text_add_up():
    """Whatever the order of arrival, the counters of one text are those of all its rows at once."""

    class State:
        exists, get = False, None

        def update(self, new):
            self.exists, self.get = True, new

    import pandas as pd

    rows = [(7, "en"), (3, "en"), (3, "de"), (5, "en"), (1, "fr"), (1, "fr"), (9, "de")]
    for order in itertools.islice(itertools.permutations(rows), 0, 5040, 211):
        state, total = State(), Counter()
        for chunk in (order[:2], order[2:3], order[3:]):
            batch = pd.DataFrame([(1, 2, i, p, 4, 0, 1) for i, p in chunk], columns=["a", "b", "id", "part", "mask", "quality", "toxic"])
            for part in audit.folded(5)(iter([batch])):
                for out in audit.updated((1,), iter([part]), state):
                    for r in out.itertuples():
                        total[r.part, r.mask] += r.n
        assert {k: n for k, n in total.items() if n} == {("fr", 4): 2, ("en", 20): 3, ("de", 20): 2}


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    assert audit.audit(spark, str(tmp_path / "docs"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def library(text):
    t = Tokenizer.from_file(WORDS) if not hasattr(library, "t") else library.t
    library.t = t
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


ALPHABET = [*"abcDE  \n\n' sdtll.,!12éΣσİ日本́‍\x00 \r\t", "<|endoftext|>", "<|startoftext|>", "'ll", "hello ", "\U0001f600"]


def small_chunks(monkeypatch):
    for name, value in (("CUT_BITS", 3), ("LEAST_BYTES", 3), ("MOST_BYTES", 40)):
        monkeypatch.setattr(encoding, name, value)


def test_joins_of_borrowed_chunks_give_the_ids_of_the_whole_text(monkeypatch):
    small_chunks(monkeypatch)
    encoder, finish, rng, n_holes = encoding.ChunkedEncoder(WORDS), encoding.Finisher(WORDS, ["ids", "decoded"]), random.Random(1), 0
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200)))
        raw = text.encode()
        ends = encoding.cuts(raw)
        chunks = {encoding.digest(raw[a:b]): raw[a:b] for a, b in zip([0, *ends], ends, strict=False)}
        borrowed = {c for c in chunks if rng.random() < 0.5}
        segments, holes, published = encoder.encode(raw, borrowed, set(chunks) - borrowed)
        assert set(published) == set(chunks) - borrowed
        ids = segments[0]
        for (name, head, tail), after in zip(holes, segments[1:], strict=True):
            whole = encoder.ids(chunks[name])
            ids += whole[head : len(whole) - tail] + after
        n_holes += len(holes)
        assert tuple(finish(ids)) == library(text)
    assert n_holes > 3000


def test_cuts_follow_the_content():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é日") for _ in range(20_000)).encode()
    whole, moved = encoding.cuts(passage), encoding.cuts(b"something before " + passage)
    shared = {x - 17 for x in moved} & set(whole)
    assert len(shared) > 0.7 * len(whole) and 5 < len(whole)
    for text in (b"", b"a", "日".encode() * 70_000, b"a" * 200_000, passage):
        ends = encoding.cuts(text)
        assert (ends[-1] if ends else 0) == len(text) and ends == sorted(set(ends))
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert all(p.decode() for p in parts) and max(map(len, parts), default=0) <= encoding.MOST_BYTES + encoding.LEAST_BYTES


def test_shared_chunks_are_encoded_by_one_text_only(spark, monkeypatch):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900))
    texts = [f"{i} own words " * 30 + passage + f" end {i}" for i in range(6)] + ["alone " * 400]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    rows = df.select(*encoding._key(F.col("text")), "text", "doc_id")
    roles = encoding.roles(encoding.chunks_of(rows)).join(rows, ["__h1", "__h2"]).collect()
    owners = Counter(bytes(c) for r in roles for c in r.owned)
    assert owners and set(owners.values()) == {1} and {r.doc_id for r in roles} == set(range(6))
    assert {bytes(c) for r in roles for c in r.borrowed} == set(owners)


def test_encoding_equals_the_library(spark):
    rng = random.Random(9)
    passage = " ".join("".join(rng.choice("abcdefghé") for _ in range(5)) for _ in range(700))
    texts = [None, "", " ", "\n\n", "a", "word " * 30_000, "x" * 150_000, "It's 'll <|endoftext|> 日本", passage, passage, passage + " more", "before " + passage, passage.replace("a", "b", 3) + passage]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(4, "a", None, None), (None, passage, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, c string")
    found = encoding.with_encoding(df, WORDS)
    assert found.columns == ["doc_id", "text", "c", "ids", "decoded"]
    got = sorted(((r.doc_id, r.text, r.c, (r.ids, r.decoded)) for r in found.collect()), key=repr)
    assert got == sorted(((i, t, c, library(t)) for i, t, _, c in rows), key=repr)
    assert encoding.with_encoding(df.limit(0), WORDS).count() == 0


def test_encoding_of_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_bpe_reuse(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids, decoded = library(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_rows_of_frequent_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_SALT", 3)
    many = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(100)], "k long, v int")
    unique = spark.createDataFrame([(k, f"u{k}") for k in range(6)], "k long, u string")
    for how in ("inner", "left"):
        want = sorted(map(repr, many.join(unique, ["k"], how).select("k", "v", "u").collect()))
        assert sorted(map(repr, common.salted(unique, many, ["k"], how).select("k", "v", "u").collect())) == want


def test_encoding_with_frequent_texts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_SALT", 3)
    passage = " ".join(f"word{i}" for i in range(900))
    texts = [passage] * 20 + [f"{passage} {i}" for i in range(20)]
    found = encoding.with_encoding(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), WORDS, outputs=("ids",)).collect()
    assert len(found) == 40 and all(r.ids == library(texts[r.doc_id])[0] for r in found)
