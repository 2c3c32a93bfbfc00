"""Token-id shards as wavelet matrices in compressed files.

A shard's ids are mapped to dense codes of its own vocabulary and stored as a
wavelet matrix: one bit-plane per code bit, each plane stably partitioned by its
bit for the next. A directory in the file gives the ones before every FRAME bits
of a plane (32 bits each) and, relative to these, before every BLOCK bits (16 bits
each): 6.3 % of the planes. From it rank is a sum of two counts and of at most
BLOCK bits, and select a binary search in the counts and one block; access(i),
rank(id, i), select(id, k), count(id) and occurrences(id) take one such step per
plane. A range of tokens is read by following its intervals from plane to plane.

File format (little-endian): magic ``WMX2``, the header's length (u32), a JSON
header (documents, tokens, bits, the zeros of each plane, compressed sizes of the
parts), then zstd frames: doc ids (i64) and their nulls, tokens per document (u32),
vocabulary (u32), the directory (u32 ones before each frame of each plane, then
u32 compressed sizes of the frames), and the frames of the planes, FRAME bits and
their u16 counts each. A frame is read only when a step needs it.

Documents are dealt by ranges of doc_id, and rows of one id (or none) that fill
several ranges by a hash of their text, so files in order of their name hold the
corpus in ascending doc_id. A task writes files of bounded size under fixed
names and renames them into place: a task run again replaces its own files.

Defined results: a null text is empty and holds its end id only; null doc_ids
come first; repeated ids are separate documents, ordered by a hash of their text,
then by their text; very
long texts fill a file of their own; extra columns are ignored; an empty table
writes no file and gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.llm import bpe
from robusteval.llm.common import documents, save, scratch_path

MAGIC = b"WMX2"
#: Bits of a frame and of a block; ones of a frame before a block fit into 16 bits.
FRAME, BLOCK = 1 << 16, 1 << 8
FILE_TOKENS = 1_000_000


class Frames:
    """The bit-planes of a matrix by frames, each with its counts; packed ones are
    unpacked when they are first read."""

    def __init__(self, before: np.ndarray, packed: list[list[bytes]] | None = None):
        #: ones before each frame of a plane, then all of the plane
        self.before, self.packed = before, packed
        self.read: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._unpack = zstandard.ZstdDecompressor().decompress if packed else None

    def get(self, level: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a frame and the ones of the frame before each of its blocks."""
        found = self.read.get((level, at))
        if found is None:
            raw = self._unpack(self.packed[level][at])
            found = np.frombuffer(raw, dtype=np.uint8, count=FRAME // 8), np.frombuffer(raw, dtype="<u2", offset=FRAME // 8)
            self.read[level, at] = found
        return found

    def plane(self, level: int, start: int, end: int) -> np.ndarray:
        """Bits from start to end of a plane, as booleans."""
        if start == end:
            return np.zeros(0, dtype=bool)
        low, high = start // FRAME, (end - 1) // FRAME
        parts = [self.get(level, k)[0] for k in range(low, high + 1)]
        part = parts[0] if len(parts) == 1 else np.concatenate(parts)
        first = (start - low * FRAME) >> 3
        bits = np.unpackbits(part[first : (end - low * FRAME + 7) >> 3], bitorder="little")
        skip = start & 7
        return bits[skip : skip + end - start].view(bool)


class WaveletMatrix:
    """A sequence of codes below 2 ** bits."""

    def __init__(self, frames: Frames, zeros: list[int], size: int):
        self.frames, self.zeros, self.size = frames, zeros, size

    @classmethod
    def build(cls, codes: np.ndarray, bits: int) -> WaveletMatrix:
        now, zeros, size = codes, [], len(codes)
        count = max(1, -(-size // FRAME))
        frames = Frames(np.zeros((bits, count + 1), dtype="<u4"))
        for level in range(bits):
            bit = (now & now.dtype.type(1 << (bits - 1 - level))) != 0
            plane = np.zeros(count * FRAME // 8, dtype=np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            ones = np.bitwise_count(plane.view("<u8")).reshape(count, -1, BLOCK // 64).sum(axis=2, dtype=np.int64)
            inner = np.cumsum(ones, axis=1)
            frames.before[level, 1:] = np.cumsum(inner[:, -1])
            relative = (inner - ones).astype("<u2")
            for k, own in enumerate(plane.reshape(count, -1)):
                frames.read[level, k] = own, relative[k]
            low, high = 0, size - int(np.count_nonzero(bit))
            zeros.append(high)
            after = np.empty_like(now)
            # part by part, so that what is moved stays in the processor's cache
            for at in range(0, size, FRAME):
                some = now[at : at + FRAME]
                zero, one = np.flatnonzero(~bit[at : at + FRAME]), np.flatnonzero(bit[at : at + FRAME])
                np.take(some, zero, out=after[low : low + len(zero)], mode="clip")
                np.take(some, one, out=after[high : high + len(one)], mode="clip")
                low, high = low + len(zero), high + len(one)
            now = after
        return cls(frames, zeros, size)

    @property
    def bits(self) -> int:
        return len(self.zeros)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        frame, rest = divmod(i, FRAME)
        ones = int(self.frames.before[level, frame])
        if not rest:
            return ones
        plane, counts = self.frames.get(level, frame)
        block, inside = divmod(rest, BLOCK)
        some = int.from_bytes(plane[block * BLOCK // 8 : (rest + 7) >> 3], "little") & ((1 << inside) - 1)
        return ones + int(counts[block]) + some.bit_count()

    def _ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """_rank1 of many places."""
        frame, rest = at // FRAME, at % FRAME
        out = self.frames.before[level, frame].astype(np.int64)
        for f in np.unique(frame[rest > 0]):
            mine = np.flatnonzero((frame == f) & (rest > 0))
            plane, counts = self.frames.get(level, int(f))
            own = rest[mine]
            block, word = own // BLOCK, own % BLOCK // 64
            words = plane.view("<u8").reshape(-1, BLOCK // 64)[block]
            full = np.bitwise_count(words) * (np.arange(BLOCK // 64)[None, :] < word[:, None])
            part = words[np.arange(len(own)), word] & ((np.uint64(1) << (own % 64).astype(np.uint64)) - np.uint64(1))
            out[mine] += counts[block] + full.sum(axis=1, dtype=np.int64) + np.bitwise_count(part)
        return out

    def _bit(self, level: int, i: int) -> int:
        plane, _ = self.frames.get(level, i // FRAME)
        return int(plane[i % FRAME >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        code = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            code = code << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return code

    def access_range(self, start: int, end: int) -> np.ndarray:
        """Codes from start to end, in order. On every plane they lie in intervals, of
        which each splits into one of zeros and one of ones on the next, by the ranks
        of its ends; neighbours join again. A whole sequence is one interval on every
        plane, so its places are known and it is followed back from the last one."""
        if not 0 <= start <= end <= self.size:
            raise IndexError((start, end))
        if end - start == self.size:
            return self._whole()
        # a place in the range in the low half, its code so far in the high half
        now = np.arange(end - start, dtype=np.uint64)
        begin, length = np.array([start]), np.array([end - start])
        for level in range(self.bits):
            bit = self._interval_bits(level, begin, length)
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            after = np.empty_like(now)
            np.take(now, low, out=after[: len(low)], mode="clip")
            np.take(now, high, out=after[len(low) :], mode="clip")
            after[len(low) :] |= np.uint64(1 << (32 + self.bits - 1 - level))
            now = after
            heads = np.cumsum(length) - length
            ones = np.add.reduceat(bit, heads, dtype=np.int64) if len(bit) else np.zeros(len(length), dtype=np.int64)
            before = self._ranks(level, begin)
            begin = np.r_[begin - before, self.zeros[level] + before]
            length = np.r_[length - ones, ones]
            begin, length = begin[length > 0], length[length > 0]
            if not len(begin):
                break
            apart = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1] + length[:-1]])
            begin, length = begin[apart], np.add.reduceat(length, apart)
        out = np.empty(end - start, dtype=np.uint32)
        out[now.astype(np.uint32)] = now >> np.uint64(32)
        return out

    def _whole(self) -> np.ndarray:
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.size, dtype=kind)
        for level in reversed(range(self.bits)):
            low, high = 0, self.zeros[level]
            now[high:] |= kind(1 << (self.bits - 1 - level))
            before = np.empty_like(now)
            for at in range(0, self.size, FRAME):
                bit = self.frames.plane(level, at, min(self.size, at + FRAME))
                zero, one = np.flatnonzero(~bit), np.flatnonzero(bit)
                some = before[at : at + FRAME]
                some[zero] = now[low : low + len(zero)]
                some[one] = now[high : high + len(one)]
                low, high = low + len(zero), high + len(one)
            now = before
        return now

    def _interval_bits(self, level: int, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        if len(begin) <= 16:
            return np.concatenate([np.zeros(0, dtype=bool), *[self.frames.plane(level, int(b), int(b + n)) for b, n in zip(begin, length)]])
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        out, frame = np.empty(len(at), dtype=bool), at // FRAME
        for f in np.unique(frame):
            mine = np.flatnonzero(frame == f)
            plane, _ = self.frames.get(level, int(f))
            own = at[mine] % FRAME
            out[mine] = plane[own >> 3] >> (own & 7) & 1
        return out

    def rank(self, code: int, i: int) -> int:
        """Occurrences of a code among the first i."""
        start, end = self._range(code, i)
        return end - start

    def ranks(self, code: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of a code among the first i, for many i."""
        start, ends = 0, at
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._ranks(level, ends)
            one = code >> (self.bits - 1 - level) & 1
            start, ends = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, ends - b)
        return ends - start

    def _range(self, code: int, i: int) -> tuple[int, int]:
        start, end, bits = 0, i, self.bits
        for level in range(bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if code >> (bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def select(self, code: int, k: int) -> int:
        """Position of the k-th occurrence of a code, from 0."""
        start, end = self._range(code, self.size)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i, bits = start + k, self.bits
        for level in reversed(range(bits)):
            one = code >> (bits - 1 - level) & 1
            i = self._select(level, i - self.zeros[level] if one else i, one)
        return i

    def _select(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th bit of a kind in a plane: a binary search for the frame,
        one for the block, and a scan of the block's bytes."""
        before = self.frames.before[level]
        upto = lambda j: int(before[j]) if bit else j * FRAME - int(before[j])
        frame = bisect_right(range(len(before) - 1), k, key=upto) - 1
        plane, counts = self.frames.get(level, frame)
        k -= upto(frame)
        inside = lambda j: int(counts[j]) if bit else j * BLOCK - int(counts[j])
        block = bisect_right(range(len(counts)), k, key=inside) - 1
        k -= inside(block)
        for byte in range(block * BLOCK // 8, (block + 1) * BLOCK // 8):
            value = int(plane[byte]) if bit else ~int(plane[byte]) & 255
            if k >= value.bit_count():
                k -= value.bit_count()
                continue
            for offset in range(8):
                if value >> offset & 1:
                    if k == 0:
                        return frame * FRAME + byte * 8 + offset
                    k -= 1
        raise IndexError(k)


class TokenFile:
    """The contents of one file: documents and their token ids."""

    def __init__(self, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.null, self.lengths, self.vocabulary, self.matrix = doc_ids, null, lengths, vocabulary, matrix

    @classmethod
    def of(cls, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> TokenFile:
        seen = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
        seen[ids] = True
        vocabulary = np.flatnonzero(seen).astype("<u4")
        bits = max(1, int(len(vocabulary) - 1).bit_length())
        code = np.zeros(len(seen), dtype=np.uint16 if bits <= 16 else np.uint32)
        code[vocabulary] = np.arange(len(vocabulary))
        null = np.array([i is None for i in doc_ids], dtype=bool)
        own = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
        return cls(own, null, np.array(lengths, dtype="<u4"), vocabulary, WaveletMatrix.build(code[ids], bits))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        m, frames = self.matrix, self.matrix.frames
        own = [[pack(b"".join(x.tobytes() for x in frames.get(level, k))) for k in range(frames.before.shape[1] - 1)] for level in range(m.bits)]
        sizes = np.array([[len(f) for f in row] for row in own], dtype="<u4")
        parts = [pack(x.tobytes()) for x in (self.doc_ids, self.null, self.lengths, self.vocabulary)]
        parts.append(pack(frames.before.astype("<u4").tobytes() + sizes.tobytes()))
        head = json.dumps({"docs": len(self.doc_ids), "tokens": m.size, "bits": m.bits, "zeros": m.zeros, "parts": [len(p) for p in parts]}).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts, *[f for row in own for f in row]])

    @classmethod
    def from_bytes(cls, raw: bytes) -> TokenFile:
        """A file's contents; frames of the planes stay packed until they are read."""
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        end = 8 + int.from_bytes(raw[4:8], "little")
        head, at, parts = json.loads(raw[8:end]), end, []
        unpack = zstandard.ZstdDecompressor().decompress
        for n in head["parts"]:
            parts.append(unpack(raw[at : at + n]))
            at += n
        arrays = [np.frombuffer(p, dtype=k) for p, k in zip(parts, ("<i8", bool, "<u4", "<u4"))]
        bits, count = head["bits"], max(1, -(-head["tokens"] // FRAME))
        table = np.frombuffer(parts[4], dtype="<u4")
        before, sizes = table[: bits * (count + 1)].reshape(bits, -1), table[bits * (count + 1) :]
        ends = at + np.cumsum(sizes, dtype=np.int64)
        packed = [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        frames = Frames(before, [packed[k * count : (k + 1) * count] for k in range(bits)])
        return cls(*arrays, WaveletMatrix(frames, head["zeros"], head["tokens"]))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Token ids from start to end."""
        return self.vocabulary[self.matrix.access_range(start, self.matrix.size if end is None else end)]

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document."""
        ends = np.cumsum(self.lengths[: k + 1], dtype=np.int64)
        return self.ids(int(ends[-1]) - int(self.lengths[k]), int(ends[-1]))

    def bounds(self, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the documents, of which each ends in end_id: by rank there is
        one more of it before each end than before the place ahead."""
        ends = np.cumsum(self.lengths, dtype=np.int64)
        code = self._code(end_id)
        if len(ends) and (code is None or ends[-1] != self.matrix.size or (self.matrix.ranks(code, ends) - self.matrix.ranks(code, ends - 1) != 1).any()):
            raise ValueError("a document of the file does not end in the end id")
        return ends - self.lengths, ends

    def token(self, i: int) -> int:
        return int(self.vocabulary[self.matrix.access(i)])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.vocabulary, token))
        return k if k < len(self.vocabulary) and self.vocabulary[k] == token else None

    def count(self, token: int, end: int | None = None) -> int:
        code = self._code(token)
        return 0 if code is None else self.matrix.rank(code, self.matrix.size if end is None else end)

    def occurrences(self, token: int) -> list[int]:
        code = self._code(token)
        return [] if code is None else [self.matrix.select(code, k) for k in range(self.count(token))]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the file system that Spark reads it from: tasks write to the same
    one, and not to disks of their own, if the name has no scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def put_file(uri: str, data: bytes, attempt: str) -> None:
    """Writes a whole file under its name, by way of a name of this attempt."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        path = where.path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{attempt}", "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(f"{path}.{attempt}", path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.{attempt}") as out:
        out.write(data)
    store.move(f"{path}.{attempt}", path)


class LibraryCodec(bpe.Codec):
    """The codec's splitting and store of pieces, with the ids of each new piece
    from the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.most = 1_200_000
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.begins = np.array([b[:1] == b" " for b in self.bytes_of])

    def merge_new(self, pieces: list[str]) -> list[bytes]:
        """Most new pieces are a space and a word: many of them side by side make
        a text that the library splits into just these, so they share a call; a token
        with a space in front begins the next of them."""
        found: dict[str, bytes] = {}
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        runs = [words[k : k + 256] for k in range(0, len(words), 256)]
        for run, e in zip(runs, self.library.encode_batch_fast(list(map("".join, runs)), add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            starts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            if len(starts) != len(run):
                continue
            raw = ids.tobytes()
            found.update(zip(run, [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]))
        rest = [p for p in pieces if p not in found]
        encoded = self.library.encode_batch_fast([p.removeprefix(bpe.MARK) for p in rest], add_special_tokens=False)
        found.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(rest, encoded))
        return [found[p] for p in pieces]


_libraries: dict[str, LibraryCodec] = {}


def library_codec(path: str) -> LibraryCodec:
    if path not in _libraries:
        _libraries[path] = LibraryCodec(path)
    return _libraries[path]


def bounds_below(bounds: list[int], value: Column, equal: bool = False) -> Column:
    """How many of the sorted bounds are below a value, or also equal to it: a binary
    search over a literal array."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        at = F.get(table, mid)
        above = at <= value if equal else at < value
        low = F.when((a["low"] < a["high"]) & above, mid + 1).otherwise(a["low"])
        high = F.when((a["low"] < a["high"]) & ~above, mid).otherwise(a["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step, lambda a: a["low"])


#: Stands for a null id in the choice of ranges.
LEAST = -(2**63)


def range_of(bounds: list[int]) -> Column:
    """The range of a row (id, hash): ids in order, and rows of an id that is a bound
    over the ranges it spans by their hash. Null ids come before all others."""
    value = F.coalesce("id", F.lit(LEAST))
    unit = F.col("hash") / F.lit(2.0**64) + 0.5
    unit = F.when(F.col("id").isNull(), unit / 2).when(F.col("id") == LEAST, (1 + unit) / 2).otherwise(unit)
    low, high = bounds_below(bounds, value), bounds_below(bounds, value, True)
    spread = F.floor(unit * (high - low + 1))
    return F.when(high == low, low).otherwise(F.least(low + spread, high)).cast("int")


def write_files(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS, parts: int | None = None) -> DataFrame:
    """Writes all documents; returns a saved row (part, seq, tokens) per file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    value = F.coalesce("id", F.lit(LEAST))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(bounds or [])

    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionById(len(bounds) + 1, range_of(bounds)).sortWithinPartitions("id", "hash", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = library_codec(path), TaskContext.get()
        part, attempt = task.partitionId(), f"{task.taskAttemptId()}.tmp"
        end = np.uint32(end_id).astype("<u4").tobytes()
        ids: list[int | None] = []
        made: list[bytes] = []
        sizes: list[int] = []

        def flush() -> None:
            tokens = np.frombuffer(b"".join(made), dtype="<u4")
            lengths = [len(m) // 4 for m in made]
            put_file(f"{folder}/{part:08d}-{len(sizes):06d}.wm", TokenFile.of(ids, lengths, tokens).to_bytes(), attempt)
            sizes.append(len(tokens))
            ids.clear()
            made.clear()

        held = 0
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in bpe.in_chunks(batch.column(1), 2_000_000):
                for raw in own.encode_batch(texts):
                    if held and held + len(raw) // 4 >= file_tokens:
                        flush()
                        held = 0
                    ids.append(names[at])
                    made.append(raw + end)
                    held += len(raw) // 4 + 1
                    at += 1
        if ids:
            flush()
        seq = list(range(len(sizes)))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(seq), pa.int32()), "seq": pa.array(seq, pa.int32()), "tokens": pa.array(sizes, pa.int64())})

    return save(dealt.mapInArrow(write, "part int, seq int, tokens long"), "files")


def read_files(files: DataFrame, folder: str, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. Where
    documents end is proved by rank of the end id; ids are read as one range."""
    spark = files.sparkSession
    per_part = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = per_part.select(F.col("part"), F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = files.withColumn("within", within).join(before, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                part, seq = map(int, name.as_py().rsplit("/", 1)[1].removesuffix(".wm").split("-"))
                file = TokenFile.from_bytes(raw.as_py())
                data = memoryview(file.ids().astype("<u4").tobytes())
                starts, ends = file.bounds(end_id)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, seq, dtype=np.int32)), pa.array(file.doc_ids, mask=file.null), pa.array(starts), pa.array(file.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    rows = found.mapInArrow(read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, path: str, end_id: int, **options) -> DataFrame:
    """Writes the documents' ids to files below the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "tokens"))
    files = write_files(docs, path, folder, end_id, **options)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(files, folder, end_id)


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(documents(spark, sf_dir), bpe.default_path(), 2)
