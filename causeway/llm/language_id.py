"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to ORDER is counted from a bounded sample of its
documents: in the order of a hash of doc_id and text, DOCS * 5 // 4 documents at most (DOCS by expectation) and as many
as hold BYTES bytes together, but one at least, whole and however long. A byte
costs -log2(c / (n + d)) in the longest context that has seen it, where a context seen n times with d
different bytes is left by an escape of probability d / (n + d); below order 0 bytes are equally likely. The
statistics are frozen, so a byte's cost depends on it and the ORDER bytes before it alone; the exact cost of
each such string is computed once a worker and kept in a table of fixed size. The language with the shortest
code wins; the score is its share of 2 ** -length over all languages.

Defined cases. Null text, or text without a letter: `und` with score 0. No training document at all: `und`
for every text. Ties go to the language that comes first by code point. Null lang: never learned. A null
doc_id counts as the empty text in the hold-out rule. Repeated rows are predicted alike and learned from once.
Texts of any length are scored whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, crc_mod, fraction, guarded, map_arrow, materialize, slices

ORDER = 4
#: Bounds of the sample of a language.
DOCS, BYTES = 400, 4_000_000
#: Slots of a worker's table of costs.
TABLE_BITS = 20
HELD_OUT = 2
_U = np.uint64
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def strings(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it in its text (zeros before the start), the last one lowest."""
    key = raw.astype(_U)
    n = len(raw)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER + 1):
        back = np.zeros(n, _U)
        back[k:] = raw[: n - k] if n > k else raw[:0]
        back[place < k] = 0
        key |= back << _U(8 * k)
    return key


class Tree:
    """Frozen counts of one language."""

    def __init__(self, keys: np.ndarray):
        self.grams, self.contexts = [], []
        for k in range(ORDER + 1):
            gram, count = np.unique(keys & _U((1 << 8 * (k + 1)) - 1), return_counts=True)
            context, first = np.unique(gram >> _U(8), return_index=True)
            edge = np.append(first, len(gram))
            self.grams.append((gram, count))
            self.contexts.append((context, np.add.reduceat(count, first) if len(first) else count[:0], np.diff(edge)))

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each key's last byte after the bytes before it."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        for k in range(ORDER, -1, -1):
            (gram, count), (context, n, d) = self.grams[k], self.contexts[k]
            if not len(gram):
                continue
            g = keys & _U((1 << 8 * (k + 1)) - 1)
            c = g >> _U(8)
            i, j = np.minimum(np.searchsorted(gram, g), len(gram) - 1), np.minimum(np.searchsorted(context, c), len(context) - 1)
            known, seen = open_ & (context[j] == c), open_ & (gram[i] == g)
            whole = np.log2(n[j] + d[j])
            out[seen] += (whole - np.log2(count[i]))[seen]
            left = known & ~seen
            out[left] += (whole - np.log2(d[j]))[left]
            open_ &= ~seen
        out[open_] += 8
        return out


def learn(samples: dict[str, list[str]]) -> tuple[list[str], list[Tree]]:
    langs = sorted(k for k, v in samples.items() if any(v))
    return langs, [Tree(strings(*as_bytes(pa.array(samples[k], pa.large_string())))) for k in langs]


class Scorer:
    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.key = np.full(1 << TABLE_BITS, (1 << 64) - 1, _U)
        self.bits = np.zeros((1 << TABLE_BITS, len(trees)), np.float32)

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(at) - 1, len(self.trees)))
        if not len(raw):
            return out
        keys = strings(raw, at)
        slot = ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - TABLE_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != keys)
        cost = self.bits[slot]
        if len(miss):
            new, place = np.unique(keys[miss], return_inverse=True)
            bits = np.stack([t.cost(new) for t in self.trees], 1).astype(np.float32)
            cost[miss] = bits[place]
            to = ((new * _U(0x9E3779B97F4A7C15)) >> _U(64 - TABLE_BITS)).astype(np.int64)
            to, which = np.unique(to, return_index=True)
            self.key[to], self.bits[to] = new[which], bits[which]
        some = np.flatnonzero(np.diff(at))
        out[some] = np.add.reduceat(cost, at[some], axis=0, dtype=np.float64)
        return out


def has_letter(col: pa.Array, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ASCII_LETTER[raw], out=count[1:])
    out = count[at[1:]] > count[at[:-1]]
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[i] = any(map(str.isalpha, col[int(i)].as_py() or ""))
    return out


def predict(col: pa.Array, langs: list[str], scorer: Scorer) -> tuple[list[str], np.ndarray]:
    raw, at = as_bytes(col)
    if not langs:
        return ["und"] * len(col), np.zeros(len(col))
    length = scorer.lengths(raw, at)
    best = length.argmin(1)
    share = 1 / np.exp2(np.maximum(length.min(1, keepdims=True) - length, -1000)).sum(1)
    letter = has_letter(col, raw, at)
    return [langs[b] if ok else "und" for b, ok in zip(best, letter)], np.where(letter, share, 0.0)


def fit(docs: DataFrame, per_lang: int = DOCS, most: int = BYTES) -> tuple[list[str], list[Tree]]:
    """Trees from the documents that are not held out."""
    order = fraction(F.col("doc_id"), F.col("text"), F.lit(5))
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL").filter(crc_mod("doc_id", 4) != HELD_OUT).filter(F.octet_length("text") > 0)
    counts = materialize(known.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share"), F.min(order).alias("first")), "shares")
    # The first document of each language by the hash, and those below its share: about per_lang of them
    near = known.join(guarded(counts), "lang").withColumn("u", order).filter("u < share OR u = first")
    sizes = near.select("lang", "u", F.octet_length("text").alias("size"), F.xxhash64("text").alias("code")).distinct().orderBy("lang", "u", "code")
    taken: list[tuple] = []
    now, count, held = None, 0, 0
    for r in sizes.toLocalIterator():
        if r["lang"] != now:
            now, count, held = r["lang"], 0, 0
        if not count or count < per_lang * 5 // 4 and held + r["size"] <= most:
            taken.append((r["lang"], r["u"], r["code"]))
        count, held = count + 1, held + r["size"]
    if not taken:
        return [], []
    pick = docs.sparkSession.createDataFrame(taken, "lang string, u double, code long").distinct()  # some hundred rows a language
    rows = near.withColumn("code", F.xxhash64("text")).join(F.broadcast(pick), ["lang", "u", "code"], "left_semi").dropDuplicates(["lang", "u", "code"]).select("lang", "text")
    samples: dict[str, list[str]] = {}
    for r in rows.toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"])
    return learn(samples)


def identify(docs: DataFrame, model: tuple[list[str], list[Tree]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    langs, trees = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # as large as the bounded sample

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, limit=max(1, 4_000_000 // max(4, len(langs)))):
                lang, score = predict(part.column("text"), langs, scorer)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = map_arrow(docs.select("doc_id", "text"), apply, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", 4) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
