"""Byte-level BPE by DuckDB recursive queries, one database a worker.

Text is cut by the tokenizer's pattern; each different piece (a word) is encoded once and kept in a bounded
table. New words go to DuckDB as rows of token and position. A recursive query joins neighbouring tokens with
the merge table, finds each word's leftmost pair of minimum rank, contracts it, and goes on until no word has a
pair left; it is cut into rounds of STEPS steps so that what a query holds is bounded. Words over LONG bytes
contract all occurrences of their minimum pair in a step, from left to right, which ends in the same tokens
since a merge never makes a pair of lower rank than its own. Decoding is an ordered aggregation of token bytes, in
DuckDB too: of the ids that were given out, never of what words are known to stand for, TOGETHER ids at a time.

Defined cases. Null or empty text: no tokens. Text of any length: worked on whole; a word of any length is
encoded, in rounds. Lone surrogates cannot occur in Arrow strings. Repeated rows and a null doc_id: as any
other. Other columns are ignored by the query and pass through `encode`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._pieces import PieceTable, gather
from ._shared import keep, map_arrow, slices

STEPS, LONG = 24, 48
#: Ids that are decoded at once.
TOGETHER = 400_000
#: Words that a worker keeps, and new words that a query takes at once (by bytes).
KEPT, BATCH_BYTES = 400_000, 500_000

# Rows are (step, k, tok) with k = word << 32 | position. A pair's mark is rank << 32 | position, so the least mark
# of a word is its leftmost pair of minimum rank.
_LEFTMOST = f"""
WITH RECURSIVE t(step, k, tok) AS (
  SELECT 0, k, tok FROM start
  UNION ALL
  SELECT step + 1, k, tok FROM (
    WITH p AS MATERIALIZED (
      SELECT x.step, x.k, x.tok, x.before, m.r, m.r << 32 | (x.k & 4294967295) AS mark
      FROM (SELECT step, k, tok, lead(tok) OVER w AS nxt, lead(k) OVER w AS after, lag(k) OVER w AS before FROM t WHERE step < {STEPS} WINDOW w AS (ORDER BY k)) x
      LEFT JOIN merges m ON m.ab = CASE WHEN after >> 32 = x.k >> 32 THEN tok << 20 | nxt END
    ), b AS (
      SELECT k >> 32 AS wid, min(mark) AS least FROM p WHERE mark IS NOT NULL GROUP BY 1
    )
    SELECT p.step, p.k, CASE WHEN p.mark = b.least THEN p.r ELSE p.tok END AS tok, p.before, b.least FROM p JOIN b ON p.k >> 32 = b.wid
  )
  WHERE before IS NULL OR before >> 32 <> k >> 32 OR before & 4294967295 <> least & 4294967295
)
SELECT t.step, t.k, t.tok FROM t JOIN (SELECT k >> 32 AS wid, max(step) AS step FROM t GROUP BY 1) e ON t.k >> 32 = e.wid AND t.step = e.step
"""
# The same for long words, with all pairs of minimum rank; of pairs that overlap (a run of one token) every second
# one, from the left.
_EVERY = """
WITH RECURSIVE t(step, k, tok) AS (
  SELECT 0, k, tok FROM start
  UNION ALL
  SELECT step + 1, k, CASE WHEN hit THEN r ELSE tok END FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY wid ORDER BY k), false) AS gone FROM (
      SELECT *, low AND (row_number() OVER (PARTITION BY wid, low, island ORDER BY k)) % 2 = 1 AS hit FROM (
        SELECT *, row_number() OVER (PARTITION BY wid ORDER BY k) - row_number() OVER (PARTITION BY wid, low ORDER BY k) AS island FROM (
          SELECT *, coalesce(r = least, false) AS low FROM (
            SELECT p.*, m.r, min(m.r) OVER (PARTITION BY p.wid) AS least
            FROM (SELECT step, k, k >> 32 AS wid, tok, lead(tok) OVER (PARTITION BY k >> 32 ORDER BY k) AS nxt FROM t WHERE step < 8) p
            LEFT JOIN merges m ON m.ab = p.tok << 20 | p.nxt)
          WHERE least IS NOT NULL))))
  WHERE NOT gone
)
SELECT step, k, tok FROM t QUALIFY step = max(step) OVER (PARTITION BY k >> 32)
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary; encode() and decode() are exact inverses for every text."""

    def __init__(self, data: bytes, pattern: str, kept: int = KEPT):
        ranks = read_ranks(data)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, np.int64) for x in zip(*rows))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": "false"})
        given = pa.table({"ab": a << 20 | b, "r": r})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        given = pa.table({"tok": pa.array(ranks.values(), pa.int64()), "hx": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.table = PieceTable(pattern, self._learn, self._forget, kept)

    def _forget(self) -> None:
        self.tok, self.tok_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def fixpoint(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word and token of each final row, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = []
        for pick, sql, steps in ((size <= LONG, _LEFTMOST, STEPS), (size > LONG, _EVERY, 8)):
            ids = np.flatnonzero(pick)
            if not len(ids):
                continue
            n = size[ids]
            wid = np.repeat(ids, n)
            k = wid << 32 | (np.arange(len(wid)) - np.repeat(np.cumsum(n) - n, n))
            tok = self.byte[np.frombuffer(b"".join(words[i] for i in ids), np.uint8)].astype(np.int64)
            while len(k):
                start = pa.table({"k": k, "tok": tok})  # noqa: F841
                got = self.db.sql(sql).to_arrow_table()
                step, k, tok = (got[c].to_numpy() for c in ("step", "k", "tok"))
                over = step < steps
                out.append((k[over], tok[over]))
                k, tok = k[~over], tok[~over]
        k, tok = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        order = np.argsort(k)
        return k[order] >> 32, tok[order].astype(np.int32)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Bytes of the ids of each list [at[k]:at[k + 1]]; an id that is none raises ValueError."""
        out: list[list[bytes]] = [[] for _ in range(len(at) - 1)]
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for a in range(0, len(ids), TOGETHER):
            part = ids[a : a + TOGETHER].astype(np.int64)
            rows = pa.table({"g": own[a : a + TOGETHER], "pos": np.arange(len(part)), "tok": part})  # noqa: F841
            found = self.db.execute("SELECT g, count(*) AS n, string_agg(hx, '' ORDER BY pos) AS hx FROM rows JOIN tokens USING (tok) GROUP BY g ORDER BY g").fetchall()
            if sum(n for _, n, _ in found) != len(part):
                raise ValueError("an id is not in the vocabulary")
            for g, _, hx in found:
                out[g].append(bytes.fromhex(hx))
        return [b"".join(x) for x in out]

    def _learn(self, raw: list[bytes]) -> None:
        """Encode new words, and keep their tokens."""
        size = np.cumsum([len(r) for r in raw])
        edge = [0, *(np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1).tolist(), len(raw)]
        toks, counts = [self.tok], [np.zeros(0, np.int64)]
        for a, b in zip(edge, edge[1:]):
            if a < b:
                wid, tok = self.fixpoint(raw[a:b])
                toks.append(tok)
                counts.append(np.bincount(wid, minlength=b - a))
        self.tok = np.concatenate(toks)
        self.tok_at = np.concatenate([self.tok_at, self.tok_at[-1] + np.cumsum(np.concatenate(counts))])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start."""
        code, edge = self.table.codes(col)  # may add to what gather() reads
        return gather(self.tok, self.tok_at, code, edge)


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec; workers outlive tasks, so its words serve the operator's next task too."""
    return keep(("codec", hashlib.sha256(data).digest(), pattern), lambda: Codec(data, pattern))


def _vocabulary(spark, path: str | None, pattern: str | None):
    import public_tokenizers as public

    with open(path or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or public.PATTERN))  # a vocabulary, whatever the data


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids, an array of int."""
    shared = _vocabulary(docs.sparkSession, path, pattern)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            for part in slices(batch):
                ids, at = own.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], [*part.schema.names, "ids"])

    return map_arrow(docs, apply, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens (with ids) with decoded, the bytes; null ids decode to none."""
    shared = _vocabulary(tokens.sparkSession, path, None)
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                lists = part.column("ids")
                at = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.decode(ids, at), pa.binary())], [*part.schema.names, "decoded"])

    return map_arrow(tokens, apply, schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, decodes the ids, and keeps the digests alone."""
    shared = _vocabulary(docs.sparkSession, path, pattern)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        for batch in batches:
            for part in slices(batch):
                ids, at = own.encode(part.column("text"))
                raw = memoryview(ids.astype("<u4").tobytes())
                cols = [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), sha(raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())), sha(own.decode(ids, at))]
                yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return map_arrow(docs.select("doc_id", "text"), apply, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
