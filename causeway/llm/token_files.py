"""Token-id files coded by a static range asymmetric numeral system (rANS).

All texts are encoded by a tokenizer, an end id is appended to each, and the ids are written in ascending doc_id
order. One frequency table, counted over all ids, is shared by all blocks. A block holds whole documents, about
BLOCK ids, and is decoded on its own: LANES interleaved coders (id i belongs to lane i mod lanes) write to one
stream of 32-bit words, so a step of all lanes is a few numpy operations. Every CHECKPOINT steps the block keeps
the lanes' states, the place in the stream and a checksum of the ids up to the next one, so a reader can start
at any of them, and check what it reads.

A folder of files holds all that a reader needs: `table` (the frequency table: one row, its bits, ids, parts and
checksum, and the type of doc_id) and `blocks`, in which a file is the rows of one task: file, block, n, payload.
Both are written by Spark's committed writer, the table first, so lost executors leave no half files.
Layout of a payload, little-endian:
  4s magic, u32 crc32 of the frequency table, u32 documents, u64 ids, u64 ids of the file before the block,
  u32 lanes, u32 steps between checkpoints, u32 checkpoints, u32 words; per document u8 what its doc_id is (0 null,
  1 number, 2 text), u32 ids, and i64 the number or the text's bytes; the bytes of such texts, end to end;
  per checkpoint u32 words read so far, u32 crc32 of its ids as u32, u64 state of each lane; the words.

`read_files` gives every document from a folder alone; `read_ids` a range of ids of the whole corpus, for which it
reads the blocks that hold it, and in them starts at the last checkpoint before it.

Defined cases. Null or empty text: the end id alone. Null doc_id: before all others. Equal doc_ids: by content;
rows alike follow each other. doc_id: whole numbers, or text of any length. An empty table gives an empty result.
Very long texts: one block each. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import PieceTable, gather
from ._shared import discard, guarded, keep, map_arrow, materialize, new_table_path, release, slices

END_ID = 2
LANES, CHECKPOINT, BLOCK = 1024, 256, 400_000
#: Ids in a file, about; the table's precision in bits; words kept by a worker.
FILE, PRECISION, KEPT = 16_000_000, 20, 500_000
#: Pieces that a call of the library takes as one text.
TOGETHER = 256
MAGIC = b"CWT2"
_HEAD = struct.Struct("<4sIIQQIIII")
_DOC = np.dtype([("what", "u1"), ("n", "<u4"), ("id", "<i8")])
_LOW = np.uint64(1 << 31)


class Frequencies:
    """Shared table: every id that occurs has at least one of 2 ** PRECISION parts."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bits: int = PRECISION):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        self.bits = max(bits, int(len(ids)).bit_length() + 2)
        whole = 1 << self.bits
        part = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * whole).astype(np.int64))
        # What rounding has left over or lacks goes to, or comes from, the most frequent ids.
        rest, by_size = whole - int(part.sum()) if len(part) else 0, np.argsort(-part, kind="stable")
        while rest < 0:
            cut = np.minimum(part[by_size] - 1, np.maximum(1, part[by_size] * -rest // part.sum()))
            cut = np.minimum(cut, np.maximum(0, -rest - (np.cumsum(cut) - cut)))
            part[by_size] -= cut
            rest += int(cut.sum())
        if len(part):
            part[by_size[0]] += rest
        self._set(part)

    def _set(self, part: np.ndarray) -> None:
        self.part = part.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(part)[:-1]]).astype(np.uint64) if len(part) else self.part
        self.crc = zlib.crc32(np.concatenate([self.ids, part]).astype("<i8").tobytes())

    @classmethod
    def stored(cls, ids: np.ndarray, part: np.ndarray, bits: int, crc: int) -> "Frequencies":
        """The table as it was written; damage raises ValueError."""
        out = cls.__new__(cls)
        out.ids, out.bits = ids.astype(np.int64), bits
        out._set(part.astype(np.int64))
        if out.crc != crc or len(part) and int(part.sum()) != 1 << bits:
            raise ValueError("the frequency table is damaged")
        return out

    def prepare(self) -> None:
        """Tables that a worker needs, not sent to it."""
        if not hasattr(self, "slot"):
            self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.part.astype(np.int64))
            self.place = np.full(int(self.ids[-1]) + 1 if len(self.ids) else 1, -1, np.int32)
            self.place[self.ids] = np.arange(len(self.ids))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "place")}


def write_block(doc_ids: list[int | str | None], lengths: np.ndarray, ids: np.ndarray, before: int, table: Frequencies, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    table.prepare()
    n = len(ids)
    while lanes > 1 and lanes * 32 > n:
        lanes //= 2
    at = table.place[ids]
    part, below, bits = table.part[at], table.below[at], np.uint64(table.bits)
    top = part << (np.uint64(63) - bits)
    x = np.full(lanes, _LOW, np.uint64)
    steps = -(-n // lanes)
    chunks, marks, words = [], [], 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y = x[: b - a]
        out = y >= top[a:b]
        if out.any():
            chunks.append((y[out] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            words += len(chunks[-1])
            y = np.where(out, y >> np.uint64(32), y)
        q, r = np.divmod(y, part[a:b])
        x[: b - a] = (q << bits) + r + below[a:b]
        if t % every == 0:
            marks.append((words, zlib.crc32(ids[a : (t + every) * lanes].astype("<u4").tobytes()), x.copy()))
    stream = b"".join(c.tobytes() for c in reversed(chunks))
    head = _HEAD.pack(MAGIC, table.crc, len(doc_ids), n, before, lanes, every, len(marks), words)
    names = [d.encode() if isinstance(d, str) else b"" for d in doc_ids]
    docs = np.zeros(len(doc_ids), _DOC)
    docs["what"] = [0 if d is None else 2 if isinstance(d, str) else 1 for d in doc_ids]
    docs["id"] = [0 if d is None else len(x) if isinstance(d, str) else d for d, x in zip(doc_ids, names)]
    docs["n"] = lengths
    docs = docs.tobytes() + b"".join(names)
    checks = b"".join(struct.pack("<II", words - w, c) + s.astype("<u8").tobytes() for w, c, s in reversed(marks))
    return head + docs + checks + stream


class Block:
    """A block's head, documents and checkpoints; ids are decoded when they are asked for. Damage raises ValueError."""

    def __init__(self, data: bytes, table: Frequencies):
        table.prepare()
        self.table = table
        try:
            magic, crc, n_docs, self.n, self.before, self.lanes, self.every, n_marks, n_words = _HEAD.unpack_from(data)
            if magic != MAGIC or crc != table.crc:
                raise ValueError("not a block of this frequency table")
            at = _HEAD.size
            docs = np.frombuffer(data, _DOC, n_docs, at)
            at += docs.nbytes
            self.doc_ids: list[int | str | None] = []
            for what, value in zip(docs["what"].tolist(), docs["id"].tolist()):
                if what == 2:
                    self.doc_ids.append(data[at : at + value].decode())
                    at += value
                else:
                    self.doc_ids.append(value if what else None)
            self.lengths = docs["n"].astype(np.int64)
            self.marks = np.frombuffer(data, np.dtype([("word", "<u4"), ("crc", "<u4"), ("x", "<u8", (self.lanes,))]), n_marks, at)
            self.words = np.frombuffer(data, "<u4", n_words, at + self.marks.nbytes)
        except struct.error as e:
            raise ValueError("a block is too short") from e
        if self.lengths.sum() != self.n or n_marks != -(-self.n // (self.lanes * self.every)):
            raise ValueError("a block's counts differ")

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first to last of the block, decoded from the last checkpoint before `first` on, and none after `last`."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int32)
        table, lanes, span = self.table, self.lanes, self.lanes * self.every
        bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
        start = first // span * span
        out = np.empty(min(self.n, -(-last // span) * span) - start, np.int32)
        for k in range(first // span, -(-last // span)):
            x, w = self.marks["x"][k].astype(np.uint64), int(self.marks["word"][k])
            lo, hi = k * span - start, min(self.n, (k + 1) * span) - start
            for a in range(lo, hi, lanes):
                b = min(hi, a + lanes)
                y = x[: b - a]
                low = y & mask
                s = table.slot[low]
                out[a:b] = s
                y = table.part[s] * (y >> bits) + low - table.below[s]
                need = np.flatnonzero(y < _LOW)
                if len(need):
                    if w + len(need) > len(self.words):
                        raise ValueError(f"checkpoint {k} runs out of words")
                    y[need] = (y[need] << np.uint64(32)) | self.words[w : w + len(need)]
                    w += len(need)
                x[: b - a] = y
            out[lo:hi] = table.ids[out[lo:hi]]
            if zlib.crc32(out[lo:hi].astype("<u4").tobytes()) != int(self.marks["crc"][k]):
                raise ValueError(f"checksum of checkpoint {k} differs")
        return out[first - start : last - start]


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer cuts text by the byte-level pattern before anything else, each different piece is encoded
    once and kept; other tokenizers, and texts that hold a special token's string, are encoded as they are.
    """

    def __init__(self, text: str, pattern: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_str(text), json.loads(text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = added
        self.table = PieceTable(pattern, self._learn, self._forget, kept)

    def _forget(self) -> None:
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        got = self.pieces([p.decode() for p in pieces])
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(g) for g in got])])

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """As whole(); pieces that start with a blank stay apart when joined, which spares a call for each."""
        lead = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and not t[1].isspace()]
        own = set(lead)
        rest = [i for i in range(len(texts)) if i not in own]
        out: list[list[int]] = [[]] * len(texts)
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        groups = [lead[a : a + TOGETHER] for a in range(0, len(lead), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids, edge = e.ids, np.searchsorted(np.array(e.word_ids), np.arange(len(group) + 1)).tolist()
            for k, i in enumerate(group):
                out[i] = ids[edge[k] : edge[k + 1]]
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start."""
        texts = col.to_pylist() if self.added or not self.by_word else []
        odd = [i for i, t in enumerate(texts) if not self.by_word or t and any(a in t for a in self.added)]
        if not self.by_word:
            got = self.whole([t or "" for t in texts])
            return np.fromiter((i for g in got for i in g), np.int32), np.cumsum([0, *map(len, got)])
        code, edge = self.table.codes(col)
        ids, at = gather(self.ids, self.at, code, edge)
        if odd:
            parts = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
            for i in odd:
                parts[i] = np.array(self.whole([texts[i]])[0], np.int32)
            ids, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, at


def _encoder(text: str, pattern: str) -> WordEncoder:
    """The worker's encoder; workers outlive tasks, so its words serve the operator's next task too."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return keep(("encoder", zlib.crc32(text.encode()), len(text), pattern), lambda: WordEncoder(text, pattern))


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, tie (a hash of the text), n and ids (u32 little-endian, u16 if the vocabulary allows)."""
    import public_tokenizers as public

    with open(path or public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), public.PATTERN))  # a vocabulary, whatever the data
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("tie", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(*shared.value)
        for batch in batches:
            for part in slices(batch):
                ids, at = own.encode(part.column("text"))
                full = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                small = full.astype("<u2" if full.max(initial=0) < 65536 else "<u4")
                cells = [small[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(np.diff(at), pa.int64()), pa.array(cells, pa.binary())], ["doc_id", "tie", "n", "ids"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), apply, schema)


def _unpack(n: np.ndarray, cells: pa.Array) -> np.ndarray:
    """Ids of some rows; a row's width is what its bytes and count say."""
    return np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(c.as_buffer(), "<u2" if len(c.as_buffer()) == 2 * k else "<u4").astype(np.int32) for k, c in zip(n.tolist(), cells)]])


def count_ids(rows: DataFrame) -> Frequencies:
    """The shared table, from counts of all ids; partial counts are added per task and per id."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                c = np.bincount(_unpack(part.column("n").to_numpy(), part.column("ids")))
                total, c = (total, c) if len(total) >= len(c) else (c, total)
                total = total.copy()
                total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "c"])

    counts = map_arrow(rows.select("n", "ids"), apply, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()  # one row an id of the vocabulary
    return Frequencies(np.array([r["id"] for r in counts], np.int64), np.array([r["c"] for r in counts], np.int64))


def write_files(docs: DataFrame, path: str | None = None, to: str | None = None, end_id: int = END_ID) -> str:
    """Write the files; the folder that they are in, which is all that a reader needs."""
    spark = docs.sparkSession
    to = (to or new_table_path(spark, "token_files")).rstrip("/")
    rows = materialize(token_ids(docs, path, end_id), "ids", compression="zstd")
    table = count_ids(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = [(kind, table.bits, table.crc, table.ids.tolist(), table.part.astype(np.int64).tolist())]
    spark.createDataFrame(stored, "kind string, bits int, crc long, ids array<long>, parts array<long>").coalesce(1).write.parquet(f"{to}/table")
    shared = spark.sparkContext.broadcast(table)  # two numbers an id of the vocabulary
    files = max(1, math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / FILE))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, before = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held, size
            doc_ids = [d for h in held for d in h.column("doc_id").to_pylist()]
            n = np.concatenate([h.column("n").to_numpy() for h in held])
            ids = np.concatenate([_unpack(h.column("n").to_numpy(), h.column("ids")) for h in held])
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([write_block(doc_ids, n, ids, before, shared.value)], pa.binary())], ["file", "block", "n", "payload"])
            block, before, held, size = block + 1, before + len(ids), [], 0
            return out

        for batch in batches:
            n = np.cumsum(batch.column("n").to_numpy())
            a = 0
            while a < len(batch):
                b = int(np.searchsorted(n, (n[a - 1] if a else 0) + BLOCK - size, "right"))
                b = max(b, a) if held else max(b, a + 1)
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(n[b - 1] - (n[a - 1] if a else 0))
                if b < len(batch):
                    yield flush()
                a = b
        if held:
            yield flush()

    order = ["doc_id", "tie"]
    dealt = map_arrow(rows.repartitionByRange(files, *order).sortWithinPartitions(*order), apply, "file int, block int, n long, payload binary")
    dealt.write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    discard(rows)
    release(spark)
    return to


def read_table(spark: SparkSession, where: str) -> tuple[Frequencies, str]:
    """The frequency table of a folder, and the type of doc_id."""
    r = spark.read.parquet(f"{where.rstrip('/')}/table").first()  # one row, two numbers an id of the vocabulary
    return Frequencies.stored(np.array(r["ids"], np.int64), np.array(r["parts"], np.int64), r["bits"], r["crc"]), r["kind"]


def _blocks(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("file int, block int, n long, payload binary").parquet(f"{where.rstrip('/')}/blocks")


def _offsets(blocks: DataFrame) -> DataFrame:
    """_file and before, the ids of the files before it: one row a file, of FILE ids or so."""
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    return materialize(sizes.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "offsets")


def read_files(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the folder alone. Damage fails the job."""
    (table, kind), blocks = read_table(spark, where), _blocks(spark, where)
    shared, text = spark.sparkContext.broadcast(table), kind == "string"  # two numbers an id of the vocabulary

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("payload")):
                block = Block(data.as_py(), shared.value)
                n, end = block.lengths, np.cumsum(block.lengths)
                raw = memoryview(block.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for k, b in zip(n.tolist(), end.tolist())]
                cols = [pa.array([file] * len(n), pa.int32()), pa.array(block.doc_ids, pa.string() if text else pa.int64()), pa.array(block.before + end - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = map_arrow(blocks.select("file", "payload"), apply, f"file int, doc_id {'string' if text else 'long'}, at long, n_tokens long, ids_crc32 long")
    joined = found.join(guarded(_offsets(blocks)), F.col("file") == F.col("_file"))
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, where: str, first: int, count: int) -> DataFrame:
    """start (an id's place in the whole corpus) and ids, an array from there on: the pieces of ids first to first + count."""
    (table, _), blocks = read_table(spark, where), _blocks(spark, where)
    shared = spark.sparkContext.broadcast(table)  # two numbers an id of the vocabulary
    at = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = blocks.select("file", "block", "n").withColumn("at", at).join(guarded(_offsets(blocks)), F.col("file") == F.col("_file"))
    places = places.withColumn("from", F.col("before") + F.col("at")).filter((F.col("from") < first + count) & (F.col("from") + F.col("n") > first))
    wanted = blocks.drop("n").join(places.select("file", "block", "from"), ["file", "block"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("from").to_pylist(), batch.column("payload")):
                lo = max(0, first - start)
                ids = Block(data.as_py(), shared.value).ids(lo, first + count - start)
                yield pa.RecordBatch.from_arrays([pa.array([start + lo], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["start", "ids"])

    return map_arrow(wanted.select("from", "payload"), apply, "start long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    return read_files(spark, write_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
