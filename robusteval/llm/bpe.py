"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

Every leaf holds rank * width + position of the pair that starts there (or a
value above all others), every inner node the least of its children: the root is
the leftmost pair of lowest rank. A merge changes three leaves, each updated
along its path to the root. Pieces of up to 64 bytes are merged many at a time,
one tree per row of an array; longer ones with a tree each.

Pre-tokens repeat, so each worker keeps a bounded store of their ids.

Defined results: a null text is an empty one and has no tokens; special tokens
found in a text become their own ids, as the library does; ids that the
vocabulary does not have can't be decoded and raise; rows are independent of
each other, so repeated rows and ids of any kind don't matter; very long texts
and very long pieces are taken whole; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import give_back, spread_documents
from robusteval.llm.pieces import splitter

#: Pieces whose ids a worker keeps.
STORE = 200_000
#: Begins a special token in a list of pieces; the rule above never joins a control and a letter.
MARK = "\0s"
_NONE = np.int64(1) << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 for itself, the others in order from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.pieces = splitter("tokenizers")
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.ids = len(self.bytes_of)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.ids + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = np.r_[key[order], _NONE], np.r_[order, -1], np.r_[made[order], -1]
        self.pair = dict(zip(key.tolist(), zip(range(len(merges)), made.tolist())))
        self.store: dict[str, bytes] = {}
        self.most = STORE

    # -- one long piece ---------------------------------------------------------

    def merge_long(self, ids: list[int]) -> list[int]:
        n, width, top = len(ids), 1, int(_NONE)
        while width < n:
            width *= 2
        made = [0] * n
        tree = [top] * (2 * width)

        def leaf(i: int, j: int) -> int:
            found = self.pair.get(ids[i] * self.ids + ids[j]) if j < n else None
            if found is None:
                return top
            made[i] = found[1]
            return found[0] * width + i

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != top:
            i = tree[1] % width
            gone = after[i]
            ids[i] = made[i]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, top)
            put(i, leaf(i, after[i]))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    # -- many short pieces ------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.ids + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1), self.made[at]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of pieces of 2 to width bytes."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        flat = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        here = np.arange(width)[None, :] < size[:, None]
        sym = np.full((n, width + 1), -1, dtype=np.int64)
        sym[:, :width][here] = flat
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        made = np.zeros((n, width), dtype=np.int64)

        def leaves(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            there = (i >= 0) & (j < size[row])
            rank, new = self._look_up(sym[row, i], sym[row, j])
            made[row, i] = np.where(there, new, made[row, i])
            return np.where(there & (rank >= 0), rank * width + i, _NONE)

        rows, cols = np.nonzero(here[:, 1:])
        tree[rows, width + cols] = leaves(rows, cols, cols + 1)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = width + i
            tree[row, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            i = tree[row, 1] % width
            gone = after[row, i]
            nxt = after[row, gone]
            sym[row, i] = made[row, i]
            here[row, gone] = False
            after[row, i] = nxt
            more = nxt < size[row]
            before[row[more], nxt[more]] = i[more]
            put(row, gone, np.full(len(row), _NONE))
            put(row, i, leaves(row, i, nxt))
            prev = before[row, i]
            has = prev >= 0
            if has.any():
                put(row[has], prev[has], leaves(row[has], prev[has], i[has]))
            row = row[tree[row, 1] != _NONE]
        out = sym[:, :width][here].astype("<u4").tobytes()
        ends = np.cumsum(here.sum(1)) * 4
        return [out[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def merge(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        groups: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            if len(b) == 1:
                out[k] = int(self.byte_id[b[0]]).to_bytes(4, "little")
            elif len(b) > 64:
                out[k] = np.array(self.merge_long(self.byte_id[list(b)].tolist()), dtype="<u4").tobytes()
            else:
                groups.setdefault(1 << (len(b) - 1).bit_length(), []).append(k)
        for width, members in groups.items():
            for at in range(0, len(members), 16384):
                part = members[at : at + 16384]
                for k, ids in zip(part, self.merge_many([raw[k] for k in part], width)):
                    out[k] = ids
        return out

    # -- texts ------------------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        """Pieces of a text; special tokens are pieces of their own."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [MARK + part] if k % 2 else self.pieces(part)
        return out

    def merge_new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the store doesn't have."""
        plain = [p for p in pieces if not p.startswith(MARK)]
        found = dict(zip(plain, self.merge(plain)))
        return [found[p] if p in found else self.special[p.removeprefix(MARK)].to_bytes(4, "little") for p in pieces]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        store = self.store
        if len(store) > self.most:
            store.clear()
        pieces = [self._split(t) if t else [] for t in texts]
        new = list(set().union(*pieces).difference(store))
        store.update(zip(new, self.merge_new(new)))
        return [b"".join(map(store.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a file: loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def in_chunks(texts: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in order, in lists of a few MB."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: (doc_id, n_tokens, ids_sha256,
    decoded_sha256, exact), and with keep_ids the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for texts in in_chunks(batch.column(1)):
                ids = own.encode_batch(texts)
                decoded = [own.decode(x) for x in ids]
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                    pa.array([d == (t or "") for d, t in zip(decoded, texts)]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
                if keep_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    flat = np.frombuffer(b"".join(ids), dtype="<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)
            give_back()

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spread_documents(spark, sf_dir), default_path())
