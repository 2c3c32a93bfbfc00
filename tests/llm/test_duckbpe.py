import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from robusteval.llm import duckbpe, pieces


@pytest.fixture(scope="module")
def library():
    with open(duckbpe.default_path(), "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return duckbpe.Engine(duckbpe.default_path())


def odd_texts():
    rnd = random.Random(5)
    out = [None, "", " ", "\n\n \t x", "don't I'll 'S <|endoftext|> é\x85\x1c\x1f ñandú 中文字 \U0001f600\U0001f600", "a" * 5000, "ab" * 700, " " * 3000, "\0\0 \0x", "12345678901234567890" * 9]
    for alphabet in ("ab", "etaoinshrdlu ", "aAbB'1 \n\t.", "éñ中\U0001f600x\U000323b0 ࢏"):
        out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(150)]
    out += ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(150)]
    out += ["".join(rnd.choice("etaoinshrdlu") for _ in range(900))]
    return out


def test_ids_and_bytes_equal_the_library(own, library):
    texts = odd_texts()
    ids = own.encode(texts)
    for t, x in zip(texts, ids):
        assert x.tolist() == library.encode_ordinary(t or ""), t
    assert own.decode(ids) == [(t or "").encode() for t in texts]


def test_both_queries_contract_alike_and_a_full_store_is_emptied(library, monkeypatch):
    monkeypatch.setattr(duckbpe, "LONG", 0)
    long = duckbpe.Engine(duckbpe.default_path())
    long.most = 50
    texts = odd_texts()[10:400]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [x.tolist() for x in long.encode(part)] == [library.encode_ordinary(t) for t in part]


def test_a_very_long_piece_takes_few_rounds(own, library):
    texts = ["a" * 100_000, "x" + "ab" * 30_000]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_taken_in_parts(library, monkeypatch):
    monkeypatch.setattr(duckbpe, "PART", 7)
    monkeypatch.setattr(duckbpe, "WORDS", 5)
    small, texts = duckbpe.Engine(duckbpe.default_path()), ["one two three " * 20 + "etaoin shrdlu " * 9, None, "x", "", "four five six seven eight nine ten eleven"]
    ids = small.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t or "") for t in texts]
    assert small.decode(ids) == [(t or "").encode() for t in texts]


def test_rows_out_of_order_are_aggregated_by_place(own, library):
    ids = own.encode(["one two three four", "five six"])
    own._give("encoded", {"doc": np.arange(1, dtype=np.int32), "ids": [ids[0].astype(np.int32)]})
    turned = duckbpe.DECODE.replace("AS place FROM encoded)", "AS place FROM encoded ORDER BY place DESC)")
    assert own.aggregated(turned, np.array([len(ids[0])]))["t"].to_pylist() == ["one two three four"]


def test_rows_come_in_order_so_nothing_is_aggregated_twice(library, monkeypatch):
    """Few long texts, as many ids as the vocabulary has tokens or more; then few pieces
    beside a large store."""
    fresh, asked = duckbpe.Engine(duckbpe.default_path()), []
    take = fresh._take
    monkeypatch.setattr(fresh, "_take", lambda sql: asked.append(sql) or take(sql))
    rnd = random.Random(7)
    for texts in (["".join(rnd.choice("etaoinshrdlu ") for _ in range(70_000)) for _ in range(3)], ["one two three " * 50, "four five"]):
        ids = fresh.encode(texts)
        assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
        assert fresh.decode(ids) == [t.encode() for t in texts]
    assert len(asked) == 4 and not any("ORDER BY place" in sql for sql in asked)


def test_a_large_store_is_not_held_twice(library):
    fresh = duckbpe.Engine(duckbpe.default_path())
    fresh.encode(["x"])
    fresh.con.execute("INSERT INTO store SELECT range, [1, 2, 3, 4] FROM range(1_000_000, 3_000_000)")
    used = fresh.con.sql("SELECT sum(memory_usage_bytes) FROM duckdb_memory()").fetchall()[0][0]
    fresh.con.execute(f"SET memory_limit = '{int(used / 1e6) + 70}MB'")
    assert fresh.encode(["one two three"])[0].tolist() == library.encode_ordinary("one two three")


def test_unknown_ids_raise(own):
    with pytest.raises(ValueError):
        own.decode([np.array([1, 60_000], dtype="<u4")])


def test_the_splitter_takes_every_code_point_as_the_libraries_do(library):
    from tokenizers.pre_tokenizers import ByteLevel

    characters, other = pieces.all_characters(), ByteLevel(add_prefix_space=False, use_regex=True)
    ours = {name: pieces.splitter(name) for name in ("tiktoken", "tokenizers")}
    rebuilt = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    for at in range(0, len(characters), 4096):
        text = "".join(f"x{c}x 1{c}1 !{c}! {c} \n{c}\n" for c in characters[at : at + 4096])
        assert ours["tokenizers"](text) == [text[a:b] for _, (a, b) in other.pre_tokenize_str(text)]
        if at % 65536 == 0:
            whole = [i for p in ours["tiktoken"](text) for i in rebuilt._core_bpe.encode_single_piece(p.encode())]
            assert whole == rebuilt.encode_ordinary(text)
    for name, expression in pieces.CLASSES.items():
        assert pieces.found_by_tiktoken(expression) == pieces.found_by_tokenizers(expression), name


def check(rows, texts, library):
    expected = []
    for i, t in texts:
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_edge_rows(spark, library):
    texts = [(None, None), (None, "x"), (1, ""), (2, "same text"), (2, "same text"), (3, "long " * 100_000), (4, "é" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_tokens int, ids string")
    check(duckbpe.round_trip(docs, duckbpe.default_path()).collect(), texts, library)
    assert duckbpe.round_trip(docs.limit(0), duckbpe.default_path()).count() == 0
    kept = duckbpe.round_trip(docs.filter("doc_id = 2"), duckbpe.default_path(), keep_ids=True).first()
    assert kept.ids == library.encode_ordinary("same text")


def test_query(spark, sf_dir, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(duckbpe.op13_duckdb_bpe(spark, sf_dir).collect(), texts, library)
