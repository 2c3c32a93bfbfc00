"""Byte-level BPE by recursive DuckDB queries, one engine per worker.

A vocabulary file of ranks becomes two tables: the tokens, and the merge table that
holds every pair of tokens whose bytes together are a token (rank and id are one in
such files). New pieces of a batch of texts become rows (word, position, token), one
per byte; a recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of least rank until no pair is left. Pieces that are tokens
themselves are looked up. A document's ids are the ids of its pieces, aggregated in
order; its bytes are the tokens' bytes, aggregated in order of the ids.

Spark deals out the documents; the engine sees the texts of one batch at a time, in
one thread, in bounded memory and without files, so a lost executor costs its own
batches only. Pieces repeat, so each worker keeps a bounded store of their ids.

Long pieces contract every place of the least pair in one round, every second one
where places overlap; this equals contracting them one by one unless the new token
has a pair of lower rank than its own, and for those tokens only the leftmost place
is contracted. So a piece of 100,000 equal letters takes 17 rounds.

Defined results: a null text is an empty one and has no tokens; marks of special
tokens are plain text; ids that the vocabulary does not have can't be decoded and
raise; rows are independent of each other, so ties, repeated rows and ids of any kind
don't matter; very long texts and pieces are taken whole; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.bpe import in_chunks
from robusteval.llm.common import give_back, spread_documents
from robusteval.llm.pieces import splitter

#: Pieces whose ids a worker keeps, characters it takes at once, memory of its engine.
STORE, CHUNK, MEMORY = 800_000, 2_000_000, "500MB"
#: Pieces of more bytes take the query that contracts many places in a round.
LONG = 64
#: Pieces or ids of one aggregation, and new pieces of one contraction: longer texts
#: are taken in parts, so the engine's memory doesn't depend on a text's length.
PART, WORDS = 1_000_000, 50_000

#: Joins are run as written, the table on the right in memory and the left one streamed,
#: so rows keep their order. Left to itself the engine guesses sizes, takes the rows of
#: unnested lists for few, and turns the joins on tokens and store around.
AS_WRITTEN = "join_order,build_side_probe_side"

#: All pairs of tokens that make a token, and the tokens with a pair of lower rank.
MERGES = """
CREATE TABLE merges AS
SELECT l.id AS lft, r.id AS rgt, t.id AS made
FROM (SELECT id, t, unnest(range(1, len(t))) AS k FROM tokens) t JOIN tokens l ON l.t = t.t[:k] JOIN tokens r ON r.t = t.t[k + 1:];
CREATE TABLE lone AS SELECT lft AS id FROM merges WHERE made < lft UNION SELECT rgt FROM merges WHERE made < rgt
"""

#: One pair a word a round. Words without a pair leave as closed rows.
CONTRACT = """
WITH RECURSIVE step(word, pos, tok, open) AS (
    SELECT word, pos, tok, true FROM bytes
    UNION ALL
    (WITH pairs AS (
        SELECT word, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos, lead(word) OVER w AS next_word
        FROM step WHERE open WINDOW w AS (ORDER BY word, pos)),
    least_pair AS (
        SELECT p.word, min(struct_pack(made := m.made, pos := p.pos, gone := p.next_pos)) AS m
        FROM pairs p JOIN merges m ON m.lft = p.tok AND m.rgt = p.next_tok WHERE p.word = p.next_word GROUP BY p.word)
    SELECT p.word, p.pos, CASE WHEN p.pos = l.m.pos THEN l.m.made ELSE p.tok END, l.m IS NOT NULL
    FROM pairs p LEFT JOIN least_pair l USING (word) WHERE l.m IS NULL OR p.pos <> l.m.gone))
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT open GROUP BY word
"""

#: The same with all places of the least pair a word a round: of places in a row, which
#: overlap, every second one; of a token in lone, only the leftmost.
CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, tok, open) AS (
    SELECT word, pos, tok, true FROM bytes
    UNION ALL
    (WITH pairs AS (
        SELECT word, pos, tok, lead(tok) OVER w AS next_tok, row_number() OVER w AS place
        FROM step WHERE open WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS (
        SELECT p.*, m.made, min(m.made) OVER (PARTITION BY word) AS best
        FROM pairs p LEFT JOIN merges m ON m.lft = p.tok AND m.rgt = p.next_tok),
    counted AS (SELECT *, coalesce(made = best, false) AS least, row_number() OVER (PARTITION BY word, coalesce(made = best, false) ORDER BY pos) AS nth FROM ranked),
    chosen AS (
        SELECT *, least AND CASE WHEN best IN (SELECT id FROM lone) THEN nth = 1 ELSE row_number() OVER (PARTITION BY word, least, place - nth ORDER BY pos) % 2 = 1 END AS hit
        FROM counted),
    marked AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM chosen)
    SELECT word, pos, CASE WHEN hit THEN best ELSE tok END, best IS NOT NULL FROM marked WHERE NOT gone))
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT open GROUP BY word
"""

#: Ids of each document, and places that tell the order they were aggregated in. The join
#: holds a second time only what the part uses, as one long text may make the store large.
ENCODE = """
SELECT doc, flatten(list(ids {order})) AS ids, list(place) AS places
FROM uses JOIN (SELECT * FROM store SEMI JOIN uses USING (code)) USING (code) GROUP BY doc ORDER BY doc
"""
#: Bytes of each document, one Latin-1 character each.
DECODE = """
SELECT doc, string_agg(t, '' {order}) AS t, list(place) AS places
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM encoded) JOIN tokens USING (id) GROUP BY doc ORDER BY doc
"""


class Engine:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ranks, self.split = ranks, splitter("tiktoken")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "autoinstall_known_extensions": False})
        self._give("given", {"id": pa.array(ranks.values(), pa.int32()), "t": [token.decode("latin-1") for token in ranks]})
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM given ORDER BY id")
        self.con.execute(f"SET disabled_optimizers = '{AS_WRITTEN}'")
        self.con.execute(MERGES)
        self.most = STORE
        self.forget()

    def _give(self, name: str, columns: dict) -> None:
        self.con.register(name, pa.table(columns))

    def _take(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table().combine_chunks()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.con.execute("CREATE OR REPLACE TABLE store (code INTEGER, ids INTEGER[])")

    def learn(self, new: list[str]) -> None:
        """Puts the ids of pieces into the store, numbered from where it ends."""
        first = len(self.code) - len(new)
        for at in range(0, len(new), WORDS):
            self._learn(first + at, [p.encode() for p in new[at : at + WORDS]])

    def _learn(self, first: int, raw: list[bytes]) -> None:
        known = [(first + k, self.ranks[b]) for k, b in enumerate(raw) if b in self.ranks]
        self._give("whole", {"code": pa.array([c for c, _ in known], pa.int32()), "id": pa.array([i for _, i in known], pa.int32())})
        self.con.execute("INSERT INTO store SELECT code, [id] FROM whole")
        for sql, wanted in ((CONTRACT, lambda b: len(b) <= LONG), (CONTRACT_LONG, lambda b: len(b) > LONG)):
            words = [(first + k, b) for k, b in enumerate(raw) if b not in self.ranks and wanted(b)]
            if words:
                size = np.array([len(b) for _, b in words])
                begin = np.cumsum(size) - size
                self._give("bytes", {
                    "word": np.repeat(np.array([c for c, _ in words], dtype=np.int32), size),
                    "pos": (np.arange(size.sum()) - np.repeat(begin, size)).astype(np.int32),
                    "tok": self.byte[np.frombuffer(b"".join(b for _, b in words), dtype=np.uint8)],
                })
                self.con.execute(f"INSERT INTO store {sql}")

    @staticmethod
    def in_parts(rows: list) -> Iterator[tuple[list[int], list]]:
        """Sequences in lists of at most PART elements, with the number of each one's row;
        longer ones are cut."""
        of: list[int] = []
        held: list = []
        size = 0
        for k, row in enumerate(rows):
            for at in range(0, max(1, len(row)), PART):
                piece = row[at : at + PART]
                if size + len(piece) > PART and held:
                    yield of, held
                    of, held, size = [], [], 0
                of.append(k)
                held.append(piece)
                size += len(piece)
        if held:
            yield of, held

    def aggregated(self, sql: str, wanted: np.ndarray) -> pa.Table:
        """The rows of an aggregation by document whose places must be 1 to wanted.
        In one thread, with joins as written, rows come in order, and sorting them is
        dear; so they are aggregated as they come, and again by place if any place was
        out of order."""
        for order in ("", "ORDER BY place"):
            found = self._take(sql.format(order=order))
            docs, places = found["doc"].combine_chunks(), found["places"].combine_chunks()
            n = np.diff(places.offsets.to_numpy())
            flat = places.flatten().to_numpy()
            expected = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
            whole = np.array_equal(n, wanted[docs.to_numpy()]) and n.sum() == wanted.sum()
            if whole and (order or np.array_equal(flat, expected)):
                return found
        raise ValueError("ids that the vocabulary does not have")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.code) > self.most:
            self.forget()
        code, new = self.code, []
        rows: list[list[int]] = []
        for text in texts:
            pieces = self.split(text or "")
            row = list(map(code.get, pieces))
            if None in row:
                for piece in dict.fromkeys(p for p, c in zip(pieces, row) if c is None):
                    code[piece] = len(code)
                    new.append(piece)
                row = list(map(code.get, pieces))
            rows.append(row)
        if new:
            self.learn(new)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for of, part in self.in_parts(rows):
            for doc, ids in zip(of, self._encode(part)):
                out[doc].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _encode(self, rows: list[list[int]]) -> list[np.ndarray]:
        size = np.array([len(r) for r in rows], dtype=np.int64)
        self._give("uses", {
            "doc": np.repeat(np.arange(len(rows), dtype=np.int32), size),
            "place": (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1).astype(np.int32),
            "code": np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(size.sum())),
        })
        found = self.aggregated(ENCODE, size)
        lists = found["ids"].combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        out = [np.zeros(0, dtype="<u4")] * len(rows)
        for k, doc in enumerate(found["doc"].to_pylist()):
            out[doc] = values[ends[k] : ends[k + 1]].astype("<u4")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out: list[list[bytes]] = [[] for _ in ids]
        for of, part in self.in_parts(ids):
            for doc, raw in zip(of, self._decode(part)):
                out[doc].append(raw)
        return [b"".join(x) for x in out]

    def _decode(self, ids: list[np.ndarray]) -> list[bytes]:
        size = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(flat))
        self._give("encoded", {"doc": np.arange(len(ids), dtype=np.int32), "ids": lists})
        found = self.aggregated(DECODE, size)
        out = [b""] * len(ids)
        for doc, text in zip(found["doc"].to_pylist(), found["t"].to_pylist()):
            out[doc] = text.encode("latin-1")
        return out


@cache
def engine(path: str) -> Engine:
    """The worker's engine for a file: made once."""
    return Engine(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: (doc_id, n_tokens, ids_sha256, decoded_sha256,
    exact), and with keep_ids the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(path)
        for batch in batches:
            at = 0
            for texts in in_chunks(batch.column(1), CHUNK):
                ids = own.encode(texts)
                decoded = own.decode(ids)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array([d == (t or "").encode() for d, t in zip(decoded, texts)]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)
            give_back()

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op13_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spread_documents(spark, sf_dir), default_path())
