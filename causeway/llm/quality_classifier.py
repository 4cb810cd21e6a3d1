"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are hashed single words, pairs of words, word shapes, pairs of shapes and whether a word repeats the
one before, each family weighing alike whatever the length of the text. The model is fitted on the driver from a
bounded sample of labelled documents: in the order of a hash of doc_id, SAMPLE documents at most and as many as
hold SAMPLE_FEATURES different features together. Executors make the features of whole texts of any length, so
no text is too long to be learned from, and the driver gets two short numbers a feature. Every whole text is
scored as a sparse dot product in Arrow batches.

Defined cases. Null or empty text: no features, the score is the model's bias. No usable label: every score is
0.5. A null quality is no label; where a doc_id has several labels the smallest holds. A null doc_id counts as
the empty text in the hold-out rule and never joins a label. Repeated rows score alike; of rows that share a
labelled doc_id each may be in the sample. An empty table gives an empty result. Other columns pass through
`scored` and `keep_good`; in `scored`, columns named held_out, score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as words
from ._shared import as_bytes, crc_mod, fraction, map_arrow, slices

#: Bounds of the training sample: documents, and different features of all of them together (8 bytes each).
SAMPLE, SAMPLE_FEATURES = 4000, 6_000_000
SLOTS = 1 << 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.02, 0.5
#: Each family of features adds up to this.
SCALE = 12.0
HELD_OUT, THRESHOLD = 0, 0.3
OUT = ("held_out", "score", "predicted")


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, value and text of each feature occurrence; the texts do not ascend."""
    raw = np.ascontiguousarray(raw)
    start, end, doc = words.find(raw, at)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0), z
    word = words.ranges(words.prefix(words.LOWER[raw]), start, end)
    shape = words.shapes(raw, start, end)
    n = np.bincount(doc, minlength=len(at) - 1)
    pair = doc[1:] == doc[:-1]
    two = lambda x: words.mix(x[:-1] * np.uint64(0xA24BAED4963EE407) + x[1:])[pair]
    same = (word[1:] == word[:-1])[pair].astype(np.uint64)
    one, pairs = SCALE / np.maximum(n, 1), SCALE / np.maximum(n - 1, 1)
    families = [(word, doc, one), (two(word), doc[1:][pair], pairs), (shape, doc, one), (two(shape), doc[1:][pair], pairs), (same, doc[1:][pair], pairs)]
    slot = np.concatenate([((h + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18) for k, (h, _, _) in enumerate(families)]).astype(np.int64)
    return slot, np.concatenate([w[d] for _, d, w in families]), np.concatenate([d for _, d, _ in families])


def bags(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and summed values of each text's features, in order of slot, and where each text's start."""
    slot, value, doc = features(*as_bytes(col))
    key, inverse = np.unique(doc * SLOTS + slot, return_inverse=True)
    value = np.bincount(inverse, value, minlength=len(key))
    return key % SLOTS, value, np.searchsorted(key // SLOTS, np.arange(len(col) + 1))


def train(slot: np.ndarray, value: np.ndarray, edge: np.ndarray, labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, one document at a time; document k has slot and value [edge[k]:edge[k + 1]]."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    order = np.random.default_rng(7)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for k in order.permutation(len(labels)):
            i = np.append(slot[edge[k] : edge[k + 1]], SLOTS)
            x = np.append(value[edge[k] : edge[k + 1]], 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    every = weight(np.arange(SLOTS + 1))
    return every[:-1].astype(np.float32), float(every[-1])


def score_batch(col: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    raw, at = as_bytes(col)
    slot, value, doc = features(raw, at)
    dot = np.bincount(doc, weights[slot] * value, minlength=len(at) - 1) + bias
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def chosen(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, _quality and _order of the first `sample` labelled documents by a hash of doc_id, held-out ones left out."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(crc_mod("doc_id", 5) != HELD_OUT)
    # Every doc_id of labels, so few of them that a top-k of a task each will do.
    one = known.groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    return one.withColumn("_order", fraction(F.col("doc_id"), F.lit(11))).orderBy("_order", "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> tuple[np.ndarray, float]:
    """Learn from labelled documents that are not held out."""
    # `sample` rows of three numbers at most
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen(labels, sample)), "doc_id").select("_order", F.xxhash64("text").alias("tie"), F.col("_quality").cast("long").alias("label"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                slot, value, edge = bags(part.column("text"))
                pack = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("_order", "tie", "label")], pa.array(np.diff(edge), pa.int64()), pack(slot, "<u4"), pack(value, "<f4")], ["_order", "tie", "label", "n", "slot", "value"])

    made = map_arrow(rows, apply, "_order double, tie long, label long, n long, slot binary, value binary")
    slots, values, edge, marks = [], [], [0], []
    for r in made.orderBy("_order", "tie").limit(2 * sample).toLocalIterator():
        if marks and edge[-1] + r["n"] > most:
            break
        slots.append(np.frombuffer(r["slot"], "<u4"))
        values.append(np.frombuffer(r["value"], "<f4"))
        edge.append(edge[-1] + r["n"])
        marks.append(int(r["label"] > 0))
    if not marks:
        return np.zeros(SLOTS, np.float32), 0.0
    return train(np.concatenate(slots).astype(np.int64), np.concatenate(values).astype(float), np.array(edge), marks)


def scored(docs: DataFrame, labels: DataFrame, model: tuple[np.ndarray, float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with held_out, score and predicted. carry: the columns to keep, with doc_id; all by default."""
    spark = docs.sparkSession
    weights, bias = model or fit(docs, labels)
    shared = spark.sparkContext.broadcast(weights)  # SLOTS floats, whatever the input
    docs = docs.drop(*OUT)
    keep = [f for f in docs.schema.fields if carry is None or f.name in ("doc_id", *carry)]
    names = [f.name for f in keep]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = score_batch(part.column("text"), shared.value, bias)
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(s, pa.float64())], [*names, "score"])

    out = map_arrow(docs, apply, T.StructType([*keep, T.StructField("score", T.DoubleType())]))
    return out.select(*[f"`{f.name}`" for f in keep], (crc_mod("doc_id", 5) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """The documents that score THRESHOLD or more, unchanged; rejected ones never leave the workers."""
    weights, bias = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SLOTS floats, whatever the input

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(score_batch(part.column("text"), shared.value, bias) >= THRESHOLD))

    return map_arrow(docs, apply, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, carry=[]).select("doc_id", "held_out", "score", "predicted")
