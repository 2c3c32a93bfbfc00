import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from robusteval.llm import bpe, wavelet


@pytest.mark.parametrize("n,top", [(1, 1), (7, 2), (64, 9), (1000, 300), (5000, 70000), (65536, 40), (150_001, 900)])
def test_matrix_against_plain_arrays(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    file = wavelet.TokenFile.from_bytes(wavelet.TokenFile.of([1, None], [n - n // 2, n // 2], ids).to_bytes())
    assert file.ids().tolist() == ids.tolist()
    assert file.null.tolist() == [False, True]
    assert [file.token(i) for i in range(0, n, 7 + n // 500)] == ids[:: 7 + n // 500].tolist()
    for token in [*np.unique(ids)[:5].tolist(), int(ids[-1]), top + 5]:
        at = np.flatnonzero(ids == token).tolist()
        if len(at) < 500:
            assert file.occurrences(token) == at
        else:
            code = int(np.searchsorted(file.vocabulary, token))
            assert [file.matrix.select(code, k) for k in range(0, len(at), 97)] == at[::97]
        for end in (0, 1, n // 2, n):
            assert file.count(token, end) == int((ids[:end] == token).sum())
    for a, b in [(0, 0), (n, n), (n // 3, n // 2), (n // 2, min(n, n // 2 + 300)), (max(0, n - 70_000), n)]:
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    assert file.document(0).tolist() == ids[: n - n // 2].tolist() and file.document(1).tolist() == ids[n - n // 2 :].tolist()
    with pytest.raises(IndexError):
        file.token(n)
    with pytest.raises(IndexError):
        file.matrix.select(0, n + 1)


def test_the_directory_is_small_and_a_token_reads_few_frames():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.2, 600_000) % 20_000).astype(np.uint32)
    raw = wavelet.TokenFile.of([1], [len(ids)], ids).to_bytes()
    file = wavelet.TokenFile.from_bytes(raw)
    frames = file.matrix.frames
    planes = file.matrix.bits * len(ids) / 8
    counts = frames.before.nbytes + sum(x.nbytes for k in range(frames.before.shape[1] - 1) for level in range(file.matrix.bits) for x in [frames.get(level, k)[1]])
    assert counts <= 0.07 * planes + frames.before.nbytes + 20_000
    file = wavelet.TokenFile.from_bytes(raw)
    assert not file.matrix.frames.read
    assert file.token(123_456) == ids[123_456]
    assert len(file.matrix.frames.read) <= file.matrix.bits
    rare = int(np.flatnonzero(np.bincount(ids) == 2)[0])
    file = wavelet.TokenFile.from_bytes(raw)
    assert file.occurrences(rare) == np.flatnonzero(ids == rare).tolist()
    assert len(file.matrix.frames.read) <= 5 * file.matrix.bits
    assert file.matrix._ranks(3, np.arange(0, 600_000, 999)).tolist() == [file.matrix._rank1(3, i) for i in range(0, 600_000, 999)]


def brute(docs):
    """docs: (doc_id, text)."""
    library = Tokenizer.from_file(bpe.default_path())
    start, out = 0, []
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t or "", 42), "big", signed=True)
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1]), d[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(wavelet.op8_wavelet_tokens(spark, sf_dir)) == brute(docs)


@pytest.mark.parametrize("parts,tokens", [(1, 10**6), (3, 10), (8, 200)])
def test_edge_rows(spark, parts, tokens):
    docs = [(None, None), (None, "x y"), (-5, "é ß"), (7, ""), (7, ""), (7, "twice"), (9, "long " * 30000), (8, "<|endoftext|> x")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, start int, part int").repartition(4)
    assert rows_of(wavelet.store_tokens(df, bpe.default_path(), 2, parts=parts, file_tokens=tokens)) == brute(docs)
    assert wavelet.store_tokens(df.limit(0), bpe.default_path(), 2).count() == 0


def test_writing_again_replaces_files(tmp_path):
    uri = f"file://{tmp_path}/a/b.wm"
    wavelet.put_file(uri, b"one", "1")
    wavelet.put_file(uri, b"two", "2")
    assert [p.read_bytes() for p in (tmp_path / "a").iterdir()] == [b"two"]


def test_library_codec_equals_the_library():
    rng = np.random.default_rng(6)
    library, own = Tokenizer.from_file(bpe.default_path()), wavelet.LibraryCodec(bpe.default_path())
    letters = list("abcdefgh ijkl éßñ 中жक़้ \u0301'12.,\n<|>") + ["<|endoftext|>", "'s", " 've"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(400)]
    for t, raw in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_bounds_below(spark):
    values = [-9, -5, -4, 0, 1, 7, 8, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for bounds in ([], [0], [-5, 0, 7], list(range(-20, 20, 3))):
        got = df.select(wavelet.bounds_below(bounds, df.v).alias("n"), wavelet.bounds_below(bounds, df.v, True).alias("m")).collect()
        assert [(r.n, r.m) for r in got] == [(sum(b < v for b in bounds), sum(b <= v for b in bounds)) for v in values]


def test_rows_without_an_id_and_of_one_id_are_spread(spark):
    docs = [(None, f"text {k} of none") for k in range(400)] + [(7, f"text {k} of seven") for k in range(400)] + [(k, "x") for k in range(100)] + [(-(2**63), f"least {k}") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(wavelet.store_tokens(df, bpe.default_path(), 2, parts=8)) == brute(docs)
    bounds = [wavelet.LEAST] * 3 + [7] * 3 + [50]
    own = df.selectExpr("doc_id as id", "xxhash64(text) as hash").withColumn("part", wavelet.range_of(bounds))
    sizes = {r.part: r["count"] for r in own.groupBy("part").count().collect()}
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 250


def test_bounds_are_proved_by_rank():
    rng = np.random.default_rng(4)
    lengths = [int(n) for n in rng.integers(1, 90, 3000)]
    ids = rng.integers(0, 700, sum(lengths)).astype("<u4")
    ends = np.cumsum(lengths)
    ids[ends - 1] = 2
    file = wavelet.TokenFile.from_bytes(wavelet.TokenFile.of(list(range(3000)), lengths, ids).to_bytes())
    places = np.r_[0, rng.integers(0, len(ids) + 1, 50), len(ids)]
    code = file._code(2)
    assert file.matrix.ranks(code, places).tolist() == [file.matrix.rank(code, int(i)) for i in places] == [int((ids[:i] == 2).sum()) for i in places]
    starts, found = file.bounds(2)
    assert found.tolist() == ends.tolist() and starts.tolist() == (ends - lengths).tolist()
    moved = file.lengths.copy()
    at = next(k for k in range(2999) if ids[ends[k]] != 2 and lengths[k + 1] > 1)
    moved[at], moved[at + 1] = moved[at] + 1, moved[at + 1] - 1
    for broken, end_id in ((wavelet.TokenFile(file.doc_ids, file.null, moved, file.vocabulary, file.matrix), 2), (file, 3), (file, 10**6)):
        with pytest.raises(ValueError):
            broken.bounds(end_id)


def test_a_folder_without_a_scheme_is_named_by_its_file_system(spark):
    assert wavelet.qualified(spark, "/x/y").startswith("file:") and wavelet.qualified(spark, "file:///x").startswith("file:")
