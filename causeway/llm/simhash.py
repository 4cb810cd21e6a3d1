"""SimHash near-duplicates by covering locality-sensitive hashing.

A text is lower-cased (A-Z), cut to words and shingles of SHINGLE words; the fingerprint has a bit set if more
than half of the shingles' XXH64 values have. Fingerprints within RADIUS bits are linked. Bit i of 64 gets a
non-zero vector m(i) of RADIUS + 1 bits; table v, for each non-zero v, compares the bits with <m(i), v> odd. For
up to RADIUS differing bits some v is orthogonal to all their vectors, so that every such pair agrees in some
table: no link is missed, whatever the data. The vectors span all RADIUS + 1 dimensions, so that no table compares
nothing; of fewer than 2^(RADIUS + 1) - 1 bits they are those whose tables compare most. Candidates are compared exactly within their bucket.

Equal fingerprints are one row before any table is built, so groups of copies cost nothing. A bucket of over
BUCKET different fingerprints is split by the same construction over the bits that its tables have left free;
that keeps the guarantee, and ends, as each table compares some of them. A bucket with RADIUS free bits or fewer
holds 2^RADIUS fingerprints at most and is never split. Components are found by stars, never on the
driver.

Defined cases. Null, empty or white-space text: fingerprint zero, linked like any other. Fewer than SHINGLE
words: the whole sequence is the one shingle. Repeated rows, ties: the same component; its id is the smallest
doc_id in it, null only if all of them are. Other columns are ignored by `near_duplicates` and pass through
`deduplicate`, which keeps one row of every component whatever its doc_id: null and repeated ids neither join
components nor lose rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import components, forest
from ._shared import guarded, map_arrow, materialize, slices

SHINGLE, SEED, RADIUS, BUCKET = 4, 42, 4, 256


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    hash_, out, edge = xxhash.xxh64_intdigest, [], [0]
    for raw in texts:
        words = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
        n = len(words)
        if n > shingle:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            out += [hash_(whole[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
        elif n:
            out.append(hash_(b" ".join(words), SEED))
        edge.append(len(out))
    edge = np.array(edge)
    n = np.diff(edge)
    result = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(out, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edge[:-1][some], axis=0, dtype=np.int64)
        result[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return result


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def _vectors(n: int, radius: int) -> list[int]:
    """Vectors of n bits; if n exceeds the radius they span all dimensions. The least table is made as large as can be, one vector at a time."""
    every = list(range(1, 1 << radius + 1))
    if n >= len(every):
        return [every[i % len(every)] for i in range(n)]
    out = [1 << k for k in range(radius + 1)][:n]
    size = [sum((m & v).bit_count() & 1 for m in out) for v in every]
    while len(out) < n:
        grown = {m: [a + ((m & v).bit_count() & 1) for a, v in zip(size, every)] for m in every if m not in out}
        best = max(grown, key=lambda m: (min(grown[m]), -grown[m].count(min(grown[m]))))
        out.append(best)
        size = grown[best]
    return out


def covering(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the free bits; two numbers that differ in at most `radius` of them agree under one."""
    places = [i for i in range(64) if free >> i & 1]
    vector = dict(zip(places, _vectors(len(places), radius)))
    return [sum(1 << p for p in places if (vector[p] & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints([(x or "").encode() for x in part.column("text").to_pylist()], shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), apply, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _near(buckets: DataFrame, radius: int) -> DataFrame:
    """Links within buckets of bounded size (fps: array of long)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in batch.column("fps"):
                x = np.unique(np.array(fps.as_py(), np.int64))
                i, j = np.nonzero(np.triu(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius, 1))
                if len(i):
                    a, b = forest(x[i], x[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(buckets.select("fps"), apply, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints (fp, distinct) within the radius of each other."""
    spark, found = fps.sparkSession, []
    bucket = max(bucket, 1 << radius)  # with no more free bits than the radius, no bucket holds more
    first = covering((1 << 64) - 1, radius)
    masks = F.array(*[F.struct(F.lit(v).cast("long").alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for v, m in enumerate(first)])
    rows = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.path").alias("path"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    bound = dict(enumerate(first))
    while True:
        many = materialize(rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        fit, over = many.filter(F.col("n") <= bucket), many.filter(F.col("n") > bucket)
        small = rows.join(fit, ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(materialize(_near(small, radius), "near"))
        paths = [r[0] for r in over.select("path").distinct().orderBy("path").collect()]  # table numbers, no data
        if not paths:
            break
        # Deeper tables: the bits that a path has compared stay compared, the others are covered anew.
        deeper, table = {}, []
        for p in paths:
            for m in covering(((1 << 64) - 1) & ~bound[p], radius):
                if not m:
                    raise RuntimeError("a bucket cannot be split: fingerprints repeat")
                deeper[len(deeper)] = bound[p] | m
                table.append((p, len(deeper) - 1, signed(bound[p] | m)))
        masks = F.broadcast(spark.createDataFrame(table, "path long, next long, mask long"))  # tables, whatever the data
        hot = rows.join(over.select("path", "key"), ["path", "key"], "left_semi")
        rows = materialize(hot.join(masks, "path").select("fp", F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")), "deeper")
        bound = deeper
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    thin = materialize(with_fingerprint(docs, shingle), "fingerprints")
    fps = materialize(thin.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), radius, bucket))
    # Components of several fingerprints only; any other fingerprint is its own.
    tree = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    linked = tree.join(fps, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root").select(F.col("fp").alias("_fp"), "component")
    every = materialize(fps.join(named, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id")), "components")
    out = thin.join(every, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _content(docs: DataFrame) -> "F.Column":
    """A hash of a whole row; maps, which cannot be hashed, count by their JSON text."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*map(plain, docs.schema.fields))


def _with_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """doc (doc_id), code (a hash of the row), fp and the columns of docs as c0, c1 .., so that no name can clash."""
    fields = docs.schema.fields
    names = [f"c{k}" for k in range(len(fields))]
    text = names[[f.name for f in fields].index("text")]
    rows = docs.select(F.col("doc_id").alias("doc"), _content(docs).alias("code"), *[F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                fp = fingerprints([(x or "").encode() for x in part.column(text).to_pylist()], shingle)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))], [*part.schema.names, "fp"])

    return map_arrow(rows, apply, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null last), of several the first by content.

    A row is known by its place in the table that is written with the fingerprints, never by its doc_id alone. Of a
    component only the places of rows that go are joined back; texts are not shuffled if those are few.
    """
    rows = materialize(_with_rows(docs, shingle), "rows")
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    thin = materialize(rows.select("fp", F.col("doc").isNull().alias("none"), "doc", "code", *place), "places")
    fps = materialize(thin.select("fp").distinct(), "distinct")
    roots = components(links(fps, radius, bucket)).toDF("fp", "root")
    named = thin.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct("none", "doc", "code", "file", "at"))
    kept = named.groupBy("root").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Of a large component one row is met by many: AQE splits such a join, as the one row is on its other side.
    gone = named.join(kept.select("root", F.col("first.file").alias("_file"), F.col("first.at").alias("_at")), "root").filter("file <> _file OR at <> _at")
    gone = materialize(gone.select(F.col("file").alias("_file"), F.col("at").alias("_at")), "gone")
    own = rows.select(*place, *[f"c{k}" for k in range(len(docs.columns))])
    left = own.join(guarded(gone), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at")), "left_anti")
    return left.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
