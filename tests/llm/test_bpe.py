import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from robusteval.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(bpe.default_path())


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def naive(own, piece):
    """Merges by scanning all pairs each time."""
    out = own.byte_id[list(piece.encode())].tolist()
    while True:
        found = [(own.pair[a * own.ids + b], i) for i, (a, b) in enumerate(zip(out, out[1:])) if a * own.ids + b in own.pair]
        if not found:
            return out
        (rank, new), i = min(found, key=lambda x: (x[0][0], x[1]))
        out[i : i + 2] = [new]


SPECIAL = ["", None, " ", "a", "\n\n  \n x", "don't we'll I'd x's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>\n", "\x00special:x", "\0special:<|endoftext|>", "١٢٣ ½ Ⅷ 12345", "日本語テキスト", "👩‍👩‍👧 x", "a b c\x1cd\x85e f", "ß" * 300, "ab" * 5000, "=" * 1000 + " " * 999, "é́ ñ", "﻿x"]


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts_as_the_library(own, library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    got = own.encode_batch([text])[0]
    assert ids(got) == want
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_random_texts_as_the_library(own, library):
    rng = random.Random(3)
    pools = ["abcdefghij   \n", "abcXYZ0189'.,!? \t\n", "äöüßéèñ abc", "ае жщ 中文 ​", " \x0b\x0c\r\n\x1f\x85　z"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 300))) for _ in range(1500)]
    for t, raw in zip(texts, own.encode_batch(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(raw) == want, repr(t)
        assert own.decode(raw) == t


def test_trees_equal_a_scan_of_all_pairs(own):
    rng = random.Random(4)
    for n in (2, 3, 7, 8, 9, 33, 64, 65, 200, 700):
        for _ in range(6):
            piece = "".join(rng.choice("etaoin shrdlu"[:: rng.choice([1, 2])]) for _ in range(n))
            assert ids(own.merge([piece])[0]) == naive(own, piece)
            assert own.merge_long(own.byte_id[list(piece.encode())].tolist()) == naive(own, piece)


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 50)
    own = bpe.Codec(bpe.default_path())
    for k in range(20):
        own.encode_batch([f"word{k} other{k} third{k} " * 3])
    assert len(own.store) <= 50 + 9


def test_query_equals_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op4_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.exact) for r in bpe.round_trip(docs, bpe.default_path()).collect())
    assert got == [("1", 0, True), ("1", 0, True), ("2", 2, True), ("None", 0, True)]
    assert bpe.round_trip(docs.limit(0), bpe.default_path()).count() == 0
    one = bpe.round_trip(docs.filter("doc_id = 2"), bpe.default_path(), keep_ids=True).first()
    assert one.ids == Tokenizer.from_file(bpe.default_path()).encode("one two").ids


def test_all_code_points_are_split_as_the_library_does(own, library):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for at in range(0, len(points), 30_000):
        text = "".join(f"x{chr(p)}x 1{chr(p)}1 !{chr(p)} " for p in points[at : at + 30_000])
        assert ids(own.encode_batch([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_the_three_splitting_rules_agree_on_latin(own):
    rng = random.Random(8)
    rules = own.pieces
    for _ in range(4000):
        t = "".join(chr(rng.choice([32, 39, rng.randrange(256), rng.randrange(256)])) for _ in range(rng.randint(0, 30)))
        assert rules.latin.findall(t) == rules.basic.findall(t) == rules.any.findall(t)
